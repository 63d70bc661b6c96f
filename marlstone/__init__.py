"""marlstone: batch retrieval, ranking and text analytics over document corpora on Spark."""
