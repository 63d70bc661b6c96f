"""Named queries against their SQL, over the whole of the smallest tables."""

import pytest
from oracle import connect, rows_of, sql_rows

from marlstone.plans import catalog

@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = connect(sf_dir)
    assert rows_of(catalog.QUERIES[name](spark, sf_dir)) == sql_rows(con, catalog.ORACLE_SQL[name])


def test_every_sql_has_its_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES


def test_questions_without_a_vector_are_asked(spark):
    """At this scale half of the questions have no vector."""
    sf_dir, name = "/root/testdata/sf0.01", "hybrid_all_questions"
    con = connect(sf_dir)
    got = catalog.QUERIES[name](spark, sf_dir).cache()
    assert rows_of(got) == sql_rows(con, catalog.ORACLE_SQL[name])
    asked = {i for (i,) in con.execute("select doc_id from documents where doc_id % 20 = 0").fetchall()}
    vectors = {i for (i,) in con.execute("select vec_id from embeddings").fetchall()}
    assert {r.query_id for r in got.collect()} == asked and asked - vectors
