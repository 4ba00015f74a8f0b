"""Named queries over named tables: shared steps, and how an operator's text becomes a Spark plan or DuckDB SQL."""
