"""Writers: report tables as CSV, JSON and parquet."""
