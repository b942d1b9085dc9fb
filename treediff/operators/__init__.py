"""Operators over file-tree indexes, event logs and their records: DataFrames in, DataFrames out."""
