"""All named queries of the library; importing a module registers its own."""

from marlstone.plans import answering, composed, details, maintenance, retrieval, textual  # noqa: F401
from marlstone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "hybrid_flagship"
