"""DataFrame builders: sales, targets, field force, inventory, coverage,
data quality, ingest and the read-only SQL entry point."""
