"""Imports every module that registers queries."""

from settlegrid.plans import corpus_queries, curve_queries, graph_queries, kernel_queries, raster_queries, spatial_queries, store_queries  # noqa: F401
