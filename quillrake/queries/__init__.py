"""All registered queries but those of the training-data operators, which register themselves."""

from . import dsl_queries, graphs, relational, surface, tables, vectors

_ALL = [m.R for m in (relational, vectors, graphs, dsl_queries, tables, surface)]
QUERIES = {k: v for r in _ALL for k, v in r.queries.items()}
ORACLE_SQL = {k: v for r in _ALL for k, v in r.oracle.items()}
