"""rivulet: topic and partitioned-table analytics expressed as Spark jobs.

Subpackages
-----------
sources    partitioned Parquet tables and tab-separated topics
streaming  standing queries, micro-batch union, sinks and drainable results
operators  rules, dataset idioms, series and sampling
functions  column-expression helpers shared by the above
plans      the registered query catalogue, DuckDB oracles and plan checks
"""

from rivulet.session import get_session, table, work_dir

__all__ = ["get_session", "table", "work_dir"]
