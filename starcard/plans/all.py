"""Importing this module fills the registry."""

from starcard.plans import sql_surface  # noqa: F401
from starcard.plans import catalog_queries  # noqa: F401
from starcard.plans import search_queries  # noqa: F401
from starcard.plans import io_queries, runlog_queries  # noqa: F401
