"""Queries over the driver's tables, bound to operators."""

from . import bindings, registry_queries, session_queries  # noqa: F401  (the others add to the first's tables)
