"""Sources and sinks: partitioned Parquet tables and TAB-separated topics."""
