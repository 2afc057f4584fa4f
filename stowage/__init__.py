"""Storage catalog analytics on Spark.

File listings, usage snapshots, access rules and audit events are plain
DataFrames; every operator takes DataFrames and returns a DataFrame.
"""
