"""The catalogue of queries and of their DuckDB SQL."""

from . import compare, entities, misc, sources, store, streams, texts, writes

_MODULES = (compare, entities, store, texts, sources, misc, writes, streams)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
