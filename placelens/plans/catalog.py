"""All queries and their checking SQL."""

from . import recommend_queries, review_queries, text_queries

_MODULES = [review_queries, text_queries, recommend_queries]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
FLAGSHIP = "e14_recommend"
