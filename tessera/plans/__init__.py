"""Importing this package registers all queries."""

from . import q_events, q_graph, q_rank, q_reduce, q_search  # noqa: F401
