"""Networks derived from the given tables, as DataFrames.

``trade``      nations; an arc per customer nation and supplier nation.
``lines``      order lines; arcs to the next and the next but one line of the
               same order, and from the last one back to the first. One cell
               per order, so cells are many and small, and hold cycles.
``suppliers``  every supplier is an edge between two nodes that lie in a
               three-level cell hierarchy.
``parts``      parts; an edge per pair of consecutive lines of an order.
``visits``     events with text ids, each leading to its visitor's next one.

Costs are whole numbers, so sums do not depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.durable import durable
from roadloom.functions.cells import common_ancestor, resolution
from roadloom.operators.paths import PathColumns
from roadloom.sources.network import initial_shortcuts, with_cost

#: A total order of the lines of an order; line numbers may repeat.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
#: Line ids are the order's key times this, plus the place in the order.
LINE_NUMBERS = 1000
#: Lines of a partition whose orders are closed where they lie, and the most partitions of that kind.
LINES_AT_ONCE = 100_000
MOST_PARTITIONS = 10_000

ORDER = PathColumns(groups=("l_orderkey",))
REGION = PathColumns(
    source="src", target="dst", hop="next_node", groups=("l_orderkey", "l_returnflag")
)

VISIT = PathColumns(source="src", target="dst", hop="next_node", groups=("visitor", "lane"))


def _numbered(lineitem: DataFrame) -> DataFrame:
    in_order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    whole = Window.partitionBy("l_orderkey")
    line = F.col("l_orderkey") * LINE_NUMBERS + F.row_number().over(in_order)
    # Each column is shuffled once; names are given behind the window.
    numbered = lineitem.select("l_orderkey", *LINE_ORDER, line.alias("line"))
    here = F.struct("line", F.col("l_partkey").alias("part"))
    return numbered.select(
        "l_orderkey", "l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_partkey").alias("part"), "line",
        F.lead(here, 1).over(in_order).alias("following"), F.lead(here, 2).over(in_order).alias("next_but_one"),
        F.min(here).over(whole).alias("opening"), F.count(F.lit(1)).over(whole).alias("lines"),
    )


def _steps(order_lines: DataFrame) -> DataFrame:
    step = lambda gap, line: F.struct(F.lit(gap).alias("gap"), F.col(line).alias("to"))
    last = F.col("following").isNull() & (F.col("lines") > 1)
    steps = F.array(step(1, "following"), step(2, "next_but_one"), F.when(last, step(1, "opening")))
    return order_lines.select("l_orderkey", "l_returnflag", "quantity", "part", "line", F.explode(steps).alias("step")).where(
        "step.to IS NOT NULL"
    ).select(
        "l_orderkey", "l_returnflag", "quantity", "part", "line",
        F.col("step.gap").alias("gap"), F.col("step.to.line").alias("next_line"), F.col("step.to.part").alias("next_part"),
    )


def _line_arcs(consecutive: DataFrame) -> DataFrame:
    return consecutive.select(
        F.col("line").alias("incoming_edge"),
        F.col("next_line").alias("outgoing_edge"),
        F.col("next_line").alias("via_edge"),
        (F.col("quantity") * F.col("gap")).alias("cost"),
        "l_orderkey",
    )


@dataclass
class Tables:
    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass
class Networks:
    spark: SparkSession
    folder: str

    @cached_property
    def tables(self) -> Tables:
        return Tables(self.spark, self.folder)

    # -- trade ----------------------------------------------------------------

    @cached_property
    def trade(self) -> DataFrame:
        t = self.tables
        buyers = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            "o_orderkey", F.col("c_nationkey").cast("long").alias("incoming_edge")
        )
        sold = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "l_orderkey", F.col("s_nationkey").cast("long").alias("outgoing_edge")
        )
        return (
            sold.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
            .where(F.col("incoming_edge") != F.col("outgoing_edge"))
            .groupBy("incoming_edge", "outgoing_edge")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(
                "incoming_edge",
                "outgoing_edge",
                F.col("outgoing_edge").alias("via_edge"),
                (F.col("n") % 50 + 1).cast("double").alias("cost"),
            )
        )

    @property
    def nations(self) -> DataFrame:
        return self.tables.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))

    # -- order lines ----------------------------------------------------------

    @property
    def order_lines(self) -> DataFrame:
        """Every order line, numbered within its order, with the lines it leads to."""
        return _numbered(self.tables.lineitem)

    @property
    def consecutive(self) -> DataFrame:
        """Lines with the next and the next but one line of their order; the last one leads back to the first."""
        return _steps(self.order_lines)

    @property
    def lines(self) -> DataFrame:
        return _line_arcs(self.consecutive)

    @property
    def dealt_lines(self) -> DataFrame:
        """``lines`` in partitions of whole orders, of about ``LINES_AT_ONCE`` lines: closing is much work for few bytes, so none are put together."""
        lineitem = self.tables.lineitem.select("l_orderkey", *LINE_ORDER)
        partitions = int(min(lineitem.count() // LINES_AT_ONCE + 1, MOST_PARTITIONS))
        return _line_arcs(_steps(_numbered(lineitem.repartition(partitions, "l_orderkey"))))

    @cached_property
    def placed_lines(self) -> DataFrame:
        """The line arcs stored, and placed by their order: queries that read them several times number the lines once."""
        return durable(self.lines, "lines").repartition(*ORDER.groups)

    @property
    def regions(self) -> DataFrame:
        """The line arcs with a two-column region: order and return flag."""
        return self.consecutive.select(
            F.col("line").alias("src"),
            F.col("next_line").alias("dst"),
            (F.col("quantity") * F.col("gap")).alias("cost"),
            F.col("next_line").alias("next_node"),
            "l_orderkey",
            "l_returnflag",
        )

    @property
    def line_edges(self) -> DataFrame:
        return self.consecutive.where("gap = 1").select(F.col("line").alias("src"), F.col("next_line").alias("dst"))

    @property
    def line_vertices(self) -> DataFrame:
        return self.order_lines.select(F.col("line").alias("id"))

    # -- parts ----------------------------------------------------------------

    @property
    def part_edges(self) -> DataFrame:
        return self.consecutive.where((F.col("gap") == 1) & (F.col("part") != F.col("next_part"))).select(
            F.col("part").alias("src"), F.col("next_part").alias("dst")
        )

    @property
    def part_vertices(self) -> DataFrame:
        return self.tables.part.select(F.col("p_partkey").alias("id"))

    # -- suppliers ------------------------------------------------------------

    @property
    def supplier_nodes(self) -> DataFrame:
        """Start and end node of every supplier edge."""
        nodes = self.tables.supplier.selectExpr("max(s_suppkey) div 4 + 1").first()[0] or 1
        return self.tables.supplier.selectExpr(
            "s_suppkey AS id", "s_suppkey div 4 AS u", "s_suppkey % 4 AS kind", "s_suppkey % 17 > 0 AS open"
        ).selectExpr(
            "id", "u", "open",
            f"""CASE kind WHEN 0 THEN u div 5 * 5 + (u + 1) % 5 WHEN 1 THEN u div 5 * 5 + (u + 3) % 5
                WHEN 2 THEN u + 5 ELSE u + 11 END % {nodes} AS v""",
        )

    @staticmethod
    def _cell(node: str) -> str:
        """Resolution-2 cell of a node: 25 nodes per base cell, 5 per middle cell."""
        return (
            f"({(1 << 59) | (2 << 52) | ((1 << 39) - 1)}L | shiftleft({node} div 25 % 122, 45) "
            f"| shiftleft({node} div 5 % 5, 42) | shiftleft({node} % 5, 39))"
        )

    @property
    def supplier_inputs(self) -> DataFrame:
        """The edge table as it would arrive in a file."""
        lengths = self.tables.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(
            F.sum("l_quantity").alias("length")
        )
        cells = self.supplier_nodes.selectExpr(
            "id", f"{self._cell('u')} AS incoming_cell", f"{self._cell('v')} AS outgoing_cell",
            "IF(open, 1.0D, 0.0D) AS maxspeed",
        )
        shared = common_ancestor("incoming_cell", "outgoing_cell")
        return (
            cells.join(lengths, "id", "left")
            .withColumn("shared", shared)
            .withColumn("lca_res", resolution("shared"))
            .select("id", "incoming_cell", "outgoing_cell", "lca_res", "length", "maxspeed")
        )

    @property
    def supplier_edges(self) -> DataFrame:
        return with_cost(self.supplier_inputs)

    @property
    def supplier_arcs(self) -> DataFrame:
        nodes = self.supplier_nodes
        before = nodes.select(F.col("id").alias("incoming_edge"), F.col("v").alias("node"))
        after = nodes.select(F.col("id").alias("outgoing_edge"), F.col("u").alias("node"))
        return before.join(after, "node").where("incoming_edge <> outgoing_edge").drop("node")

    @property
    def supplier_shortcuts(self) -> DataFrame:
        return initial_shortcuts(self.supplier_arcs, self.supplier_edges)

    # -- events ---------------------------------------------------------------

    @property
    def visits(self) -> DataFrame:
        """Arcs between consecutive events of a visitor's lane; ids and visitors are text."""
        lane = Window.partitionBy("visitor", "lane").orderBy("ts", "event_id")
        events = self.tables.events.select(
            F.concat(F.lit("visitor "), F.col("user_id").cast("string")).alias("visitor"), (F.col("event_id") % 8).alias("lane"), "ts", "event_id",
            F.concat("event_type", F.lit(" "), "props", F.lit(" "), F.col("user_id").cast("string")).alias("here"),
            (F.floor("value") + 1).cast("double").alias("cost"),
        )
        return events.select(
            F.col("here").alias("src"), F.lead("here").over(lane).alias("dst"), "cost", "visitor", "lane"
        ).where("src IS NOT NULL AND dst IS NOT NULL AND visitor IS NOT NULL AND lane IS NOT NULL").select(
            "src", "dst", "cost", F.col("dst").alias("next_node"), "visitor", "lane"
        )

    # -- customers ------------------------------------------------------------

    @property
    def customer_edges(self) -> DataFrame:
        """Customers as edges; the length is missing where there are no orders."""
        spent = self.tables.orders.groupBy(F.col("o_custkey").alias("id")).agg(
            F.sum("o_totalprice").alias("length")
        )
        return self.tables.customer.select(
            F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("maxspeed")
        ).join(spent, "id", "left")
