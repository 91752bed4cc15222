"""All registered queries (``QUERIES``) and their DuckDB oracles (``ORACLE``).

Importing the query modules registers them; see ``registry.py`` for the conventions.
"""

from ridelens.plans import queries_forecast  # noqa: F401
from ridelens.plans import queries_clean  # noqa: F401
from ridelens.plans import queries_segment  # noqa: F401
from ridelens.plans import queries_io  # noqa: F401
from ridelens.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
