"""treediff: PySpark-native analytics over file-tree indexes and replication event logs."""
