"""Declared schemas of the tables that cross a file boundary."""

from pyspark.sql import types as T

EDGES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("incoming_cell", T.LongType()),
    T.StructField("outgoing_cell", T.LongType()),
    T.StructField("lca_res", T.IntegerType()),
    T.StructField("length", T.DoubleType()),
    T.StructField("maxspeed", T.DoubleType()),
])

ARCS = T.StructType([
    T.StructField("incoming_edge", T.LongType()),
    T.StructField("outgoing_edge", T.LongType()),
])

SHORTCUTS = T.StructType([
    T.StructField("incoming_edge", T.LongType()),
    T.StructField("outgoing_edge", T.LongType()),
    T.StructField("via_edge", T.LongType()),
    T.StructField("cost", T.DoubleType()),
])

FINAL_SHORTCUTS = T.StructType([
    *SHORTCUTS.fields,
    T.StructField("inside", T.ByteType()),
    T.StructField("cell", T.LongType()),
])

LEDGER = T.StructType([
    T.StructField("pass_name", T.StringType()),
    T.StructField("resolution", T.IntegerType()),
    T.StructField("method", T.StringType()),
    T.StructField("rows_in", T.LongType()),
    T.StructField("rows_out", T.LongType()),
    T.StructField("table_rows", T.LongType()),
])
