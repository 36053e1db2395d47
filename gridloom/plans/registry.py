"""All registered queries of the gridded-data library and their SQL oracles."""

from . import field_queries, grid_queries, run_queries, tile_queries

QUERIES = {**grid_queries.QUERIES, **field_queries.QUERIES, **run_queries.QUERIES, **tile_queries.QUERIES}
ORACLES = {**grid_queries.ORACLES, **field_queries.ORACLES, **run_queries.ORACLES, **tile_queries.ORACLES}
