"""All queries of the core library and their SQL."""

from . import detail_queries, problems, record_queries

# the queries of detail_queries are registered with those of record_queries
assert detail_queries.query is record_queries.query
QUERIES: dict = {**record_queries.QUERIES, **problems.QUERIES}
SQL: dict = {**record_queries.SQL, **problems.SQL}
