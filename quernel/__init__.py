"""A Spark-first analytics engine for a distributed-SQL dialect."""
