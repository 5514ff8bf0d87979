"""Sources (ping tables, fixture adapters, CSV/JSON/parquet readers) and sinks."""
