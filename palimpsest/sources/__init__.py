"""The versioned Parquet store, its transactions and its data source."""
