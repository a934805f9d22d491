"""Sources: raw session CSVs, the named-dataset registry, the Parquet tables
and the shots fixture view over the driver's tables."""
