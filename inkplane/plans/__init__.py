"""Registered queries; importing this package registers all of them."""

from inkplane.plans import composite_queries, dictionary_queries, geometry_queries, layout_queries, page_queries, scalar_queries, service_queries, source_queries  # noqa: F401
from inkplane.plans.registry import ORACLES, QUERIES  # noqa: F401
