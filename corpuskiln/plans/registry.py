"""All registered queries of the engine and their SQL."""

from corpuskiln.plans import lookup_queries, relational_queries, search_queries, text_queries

_PARTS = (search_queries, relational_queries, text_queries, lookup_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
