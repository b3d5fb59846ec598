"""Sources and sinks: binned trials from event tables, draws to Parquet."""
