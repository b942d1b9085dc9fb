"""Reading and writing indexes, logs, records and manifests."""
