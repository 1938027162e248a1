"""The registered queries of the notebook engine and their DuckDB SQL."""

from fieldbook.plans import nested, notebook  # noqa: F401  register their queries
from fieldbook.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "gate_summary"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
