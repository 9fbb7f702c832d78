"""Every operator as a query over the driver's tables, with its equivalent in DuckDB's SQL."""
