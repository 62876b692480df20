"""Loading edges and arcs, and the shortcut table a run starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom import schemas
from roadloom.durable import durable
from roadloom.functions.cells import from_text
from roadloom.functions.costs import travel_cost
from roadloom.operators.quality import cell_fault

CELL_COLUMNS = ("incoming_cell", "outgoing_cell")


def _read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file by its header, all columns as text: only the header is read up front."""
    return spark.read.option("header", True).csv(path)


def read_edge_file(spark: SparkSession, path: str) -> DataFrame:
    """The edge file with declared types, found by column name.

    Cells may be hexadecimal or decimal. A value that does not parse becomes
    NULL and shows up in the quality report.
    """
    raw = _read_text_csv(spark, path)
    return raw.select(*[
        (from_text(field.name) if field.name in CELL_COLUMNS
         else F.trim(F.col(field.name)).try_cast(field.dataType)).alias(field.name)
        for field in schemas.EDGES if field.name in raw.columns
    ])


def read_checked(
    spark: SparkSession, path: str, schema: T.StructType = schemas.EDGES, required: tuple[str, ...] = ("id",), cells: tuple[str, ...] = CELL_COLUMNS
) -> tuple[DataFrame, DataFrame]:
    """The sound rows of text files with a header, and a table of the lines that are not.

    Files hold a row per line, columns in the order of the header. Rejected lines are
    ``(line, column_name, reason)``, each once, for its first fault in this order, columns as in
    ``schema``:

    ``header``   the header again, behind the first line of a file
    ``fields``   more or fewer values than the header has names
    ``missing``  no value in a ``required`` column
    ``number``   a value that is no number of its column's type
    ``cell``     a value that is neither decimal nor hexadecimal
    ``layout``   a cell that breaks the index layout

    Values may be quoted, and white space around them doesn't count; an empty value that is
    not required is NULL. Lines are read and judged once and stored; both tables read that.
    """
    names = _read_text_csv(spark, path).columns
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"))
    as_text = T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(len(names))), T.StructField("_bad", T.StringType())])
    parsed = F.from_csv("line", as_text.simpleString()[len("struct<") : -1].replace(":", " "), {"columnNameOfCorruptRecord": "_bad"})
    split = lines.where(F.trim("line") != "").select("line", "_file", parsed.alias("_v"))
    split = split.select("line", "_file", F.col("_v._bad").alias("_bad"), *[F.nullif(F.trim(F.col(f"_v.c{i}")), F.lit("")).alias(name) for i, name in enumerate(names)])
    wanted = [field for field in schema if field.name in names]
    values, faults = [], [F.when(F.col("_bad").isNotNull(), F.struct(F.lit(None).cast("string").alias("column_name"), F.lit("fields").alias("reason")))]
    for field in wanted:
        is_cell = field.name in cells
        value = from_text(field.name) if is_cell else F.col(field.name).try_cast(field.dataType)
        values.append(value.alias(field.name))
        reason = F.when(F.col(field.name).isNull(), F.lit("missing" if field.name in required else None)).when(
            value.isNull(), F.lit("cell" if is_cell else "number"))
        faults.append(F.when(reason.isNotNull(), F.struct(F.lit(field.name).alias("column_name"), reason.alias("reason"))))
    is_header = F.lit(True)
    for name in names:
        is_header = is_header & F.col(name).eqNullSafe(F.lit(name))
    judged = split.select("line", "_file", is_header.alias("_header"), F.coalesce(*faults).alias("_fault"), *values)
    stored = durable(judged, "lines")
    # A cell's layout is looked at in its number.
    for name in [f.name for f in wanted if f.name in cells]:
        broken = F.struct(F.lit(name).alias("column_name"), F.lit("layout").alias("reason"))
        stored = stored.withColumn("_fault", F.when(F.col("_fault").isNull() & F.col(name).isNotNull() & cell_fault(name).isNotNull(), broken).otherwise(F.col("_fault")))
    accepted = stored.where("NOT _header AND _fault IS NULL").select(*[f.name for f in wanted])
    rejected = stored.where("NOT _header AND _fault IS NOT NULL").select("line", "_fault.column_name", "_fault.reason")
    # Header lines of a file are alike, so it doesn't matter which of them came first.
    again = stored.where("_header").groupBy("_file").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        "line", F.lit(None).cast("string").alias("column_name"), F.lit("header").alias("reason"), F.explode(F.expr("sequence(2, CAST(_n AS INT))")).alias("_k")
    ).drop("_k")
    return accepted, rejected.unionByName(again)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges without their cost inputs: ``id``, the two cells and ``lca_res``."""
    return read_edge_file(spark, path).select("id", *CELL_COLUMNS, "lca_res")


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """The edge graph: which edge can follow which."""
    raw = _read_text_csv(spark, path)
    return raw.select(*[
        F.trim(F.col(field.name)).try_cast(field.dataType).alias(field.name) for field in schemas.ARCS
    ])


def with_cost(edges: DataFrame, cost: Column | None = None) -> DataFrame:
    """Edges with a ``cost`` column in place of an older one.

    The default rule is length over speed; any column expression will do.
    """
    rule = travel_cost("length", "maxspeed") if cost is None else cost
    return edges.withColumn("cost", rule)


def update_costs(edges: DataFrame, cost_inputs: DataFrame, cost: Column | None = None) -> DataFrame:
    """Edges joined to costs computed from a separate table of cost inputs."""
    costs = with_cost(cost_inputs, cost).select("id", "cost")
    return edges.drop("cost").join(costs, "id", "left")


def initial_shortcuts(
    arcs: DataFrame, edge_costs: DataFrame, cost_of: str = "incoming_edge", hop: str = "via_edge"
) -> DataFrame:
    """One direct shortcut per arc, priced by its incoming (or outgoing) edge.

    Arcs of unknown edges stay, with NULL cost.
    """
    costs = edge_costs.select(F.col("id").alias(cost_of), "cost")
    return (
        arcs.select("incoming_edge", "outgoing_edge", F.col("outgoing_edge").alias(hop))
        .join(costs, cost_of, "left")
        .select("incoming_edge", "outgoing_edge", hop, "cost")
    )


def load_network(spark: SparkSession, edge_path: str, arc_path: str) -> tuple[DataFrame, DataFrame]:
    """Edges with cells and costs, and the initial shortcuts, from the two input files."""
    edges = with_cost(read_edge_file(spark, edge_path))
    return edges, initial_shortcuts(read_arcs(spark, arc_path), edges)
