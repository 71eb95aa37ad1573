"""All queries of the library by name, with their SQL."""

from .plans import chain_queries, procedures, reports

QUERIES = {name: reports.spark_query(name) for name in reports.REPORTS} | procedures.QUERIES | chain_queries.QUERIES
ORACLE_SQL = {name: reports.duckdb_sql(name) for name in reports.REPORTS} | procedures.ORACLE_SQL | chain_queries.ORACLE_SQL
FLAGSHIP = "motif_geometry_counts"
