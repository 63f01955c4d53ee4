"""loomline: a Spark-first engine for dialect queries, ordered tables and source-code analytics."""
