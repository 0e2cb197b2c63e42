"""Registered queries and the SQL that another engine runs on the same tables."""

from . import code_queries, feature_queries, model_queries, tree_queries  # noqa: F401  they register theirs
from .queries import ORACLES, QUERIES  # noqa: F401
