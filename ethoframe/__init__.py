"""Operators on frame-indexed, entity-partitioned tables, as plans of Spark DataFrames."""
