"""Every registered query with its SQL counterpart.

Closures, passes and loops are computed by the queries that carry their name.
Reports read the closed tables from storage, as an analyst would; the first
report of a session writes them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.durable import durable, fresh_path, path_exists, stored_at
from roadloom.functions import cells
from roadloom.functions.costs import travel_cost
from roadloom.operators import celled, dictionary, graph, merge, paths, quality, reports, sampling, sketches
from roadloom.operators.closure import closure
from roadloom.operators.paths import SHORTCUT
from roadloom.plans import bounded, hierarchy
from roadloom.sources import network, store
from workloads import oracle as o
from workloads.networks import ORDER, REGION, VISIT, Networks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str):
    def add(build):
        QUERIES[name] = lambda spark, folder: build(Networks(spark, folder))
        ORACLE[name] = sql
        return build

    return add


# -- closed tables kept for the reports ---------------------------------------

_stored: dict[tuple[str, str, str], tuple[str, object]] = {}


def stored(n: Networks, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per session and input folder."""
    key = (n.spark.sparkContext.applicationId, n.folder, name)
    if key not in _stored or not path_exists(n.spark, _stored[key][0]):
        df = build()
        # A closing may have stored its result already.
        path = stored_at(df)
        if path is None:
            path = fresh_path(n.spark, name)
            store.write_shortcuts(df, path)
        _stored[key] = (path, df.schema)
    path, schema = _stored[key]
    return store.read_shortcuts(n.spark, path, schema)


def write_stored(spark: SparkSession, folder: str) -> None:
    """Write the closed tables the reports read, before anything is timed."""
    networks = Networks(spark, folder)
    closed_trade(networks)
    closed_lines(networks)


def closed_trade(n: Networks) -> DataFrame:
    return stored(n, "closed-trade", lambda: closure(n.trade, SHORTCUT))


def closed_lines(n: Networks) -> DataFrame:
    return stored(n, "closed-lines", lambda: closure(n.dealt_lines, ORDER, placed=True))


def placed_suppliers(n: Networks) -> DataFrame:
    return stored(n, "placed-suppliers", lambda: celled.add_info(n.supplier_shortcuts, n.supplier_edges))


_runs: dict[tuple[str, str], hierarchy.Run] = {}


def final_suppliers(n: Networks) -> DataFrame:
    """The published table of one run per session and input folder, read from what the run has stored."""
    key = (n.spark.sparkContext.applicationId, n.folder)
    if key not in _runs or not _runs[key].is_stored():
        _runs[key] = three_passes(n)
    return _runs[key].final()


def three_passes(n: Networks) -> hierarchy.Run:
    return hierarchy.three_passes(n.supplier_shortcuts, n.supplier_edges)


def start_run(n: Networks) -> hierarchy.Run:
    return hierarchy.Run.start(n.supplier_shortcuts, n.supplier_edges)


# -- A. sources and sinks -----------------------------------------------------

EDGES_SQL = "SELECT id, incoming_cell, outgoing_cell, lca_res, length, maxspeed FROM supplier_inputs"


@register("edges_csv_roundtrip", o.query(o.SUPPLIERS, select=EDGES_SQL))
def edges_csv_roundtrip(n):
    path = fresh_path(n.spark, "edges-csv")
    store.write_csv(n.supplier_inputs, path)
    return network.read_edge_file(n.spark, path)


@register("edges_load", o.query(o.SUPPLIERS, select="SELECT id, incoming_cell, outgoing_cell, lca_res FROM supplier_inputs"))
def edges_load(n):
    path = fresh_path(n.spark, "edges-csv")
    as_text = n.supplier_inputs.withColumns(
        {name: cells.to_text(name) for name in ("incoming_cell", "outgoing_cell")}
    )
    store.write_csv(as_text, path)
    return network.read_edges(n.spark, path)


@register("initial_shortcuts", o.query(o.SUPPLIERS, select=f"SELECT {o.PAIR} FROM supplier_shortcuts"))
def initial_shortcuts(n):
    edge_path, arc_path = fresh_path(n.spark, "edges-csv"), fresh_path(n.spark, "arcs-csv")
    store.write_csv(n.supplier_inputs, edge_path)
    store.write_csv(n.supplier_arcs, arc_path)
    return network.load_network(n.spark, edge_path, arc_path)[1]


@register("initial_shortcuts_outgoing", o.query(o.SUPPLIERS, select="""
SELECT incoming_edge, outgoing_edge, outgoing_edge AS next_edge, cost
FROM supplier_arcs LEFT JOIN supplier_edges ON id = outgoing_edge"""))
def initial_shortcuts_outgoing(n):
    return network.initial_shortcuts(n.supplier_arcs, n.supplier_edges, "outgoing_edge", "next_edge")


@register("edge_costs", o.query(o.SUPPLIERS, select="SELECT id, incoming_cell, outgoing_cell, lca_res, cost FROM supplier_edges"))
def edge_costs(n):
    edges = n.supplier_inputs.select("id", "incoming_cell", "outgoing_cell", "lca_res")
    return network.update_costs(edges, n.supplier_inputs.select("id", "length", "maxspeed"))


@register("edge_costs_minutes", o.query(o.SUPPLIERS, select="SELECT id, round(cost / 60, 9) AS cost FROM supplier_edges"))
def edge_costs_minutes(n):
    cost = travel_cost(seconds_per_unit=60)
    return network.with_cost(n.supplier_inputs, cost).select("id", F.round("cost", 9).alias("cost"))


FINAL_COLUMNS = "incoming_edge, outgoing_edge, via_edge, cost, inside, cell"
ALL_PASSES, ALL_STEPS = o.passes([*o.DOWN, *o.GLOBAL, *o.UP])
LAST = ALL_STEPS[-1][0]


def final_sql(table: str) -> str:
    return f"""
final AS MATERIALIZED (
  SELECT t.incoming_edge, t.outgoing_edge, via_edge, cost,
    CAST(CASE WHEN source_res = target_res THEN 0 WHEN source_res < target_res THEN -1 ELSE 1 END AS TINYINT) AS inside,
    {o.ancestor("via_cell", "lca_res")} AS cell
  FROM {table} t JOIN pair_places p USING (incoming_edge, outgoing_edge))"""


@register("shortcuts_write_read", o.query(o.SUPPLIERS, o.PLACES, final_sql("supplier_shortcuts"), select=f"SELECT {FINAL_COLUMNS}, CAST({o.resolution('cell')} AS INTEGER) AS cell_res FROM final"))
def shortcuts_write_read(n):
    path = fresh_path(n.spark, "shortcuts")
    final = celled.add_final_info(n.supplier_shortcuts, n.supplier_edges)
    store.write_shortcuts(final.withColumn("cell_res", cells.resolution("cell")), path, ("cell_res",))
    return store.read_shortcuts(n.spark, path).withColumn("cell_res", cells.resolution("cell"))


DOWN_PASSES, DOWN_STEPS = o.passes(o.DOWN)


@register("resolution_snapshots", o.query(o.SUPPLIERS, o.PLACES, DOWN_PASSES, select=" UNION ALL ".join(
    f"SELECT {o.PAIR}, 'down' AS pass_name, {res} AS resolution FROM {name}_closed" for name, res in DOWN_STEPS)))
def resolution_snapshots(n):
    path = fresh_path(n.spark, "snapshots")
    options = hierarchy.Options(snapshots=path)
    hierarchy.Run.start(n.supplier_shortcuts, n.supplier_edges, options).downward()
    return n.spark.read.parquet(path)


# -- B. filters ---------------------------------------------------------------

PLACED = (o.SUPPLIERS, o.PLACES, o.placed("placed", "supplier_shortcuts"))
PLACED_COLUMNS = "incoming_edge, outgoing_edge, via_edge, cost, lca_res, via_cell, via_res"


@register("enrich_shortcuts", o.query(*PLACED, select=f"SELECT {PLACED_COLUMNS} FROM placed"))
def enrich_shortcuts(n):
    return celled.add_info(n.supplier_shortcuts, n.supplier_edges)


@register("filter_resolution", o.query(*PLACED, select=f"SELECT {PLACED_COLUMNS} FROM placed WHERE lca_res <= 1 AND via_res >= 1"))
def filter_resolution(n):
    return celled.at_resolution(placed_suppliers(n), 1)


@register("filter_global", o.query(*PLACED, select=f"SELECT {PLACED_COLUMNS} FROM placed WHERE lca_res <= 0"))
def filter_global(n):
    return celled.at_resolution(placed_suppliers(n), celled.GLOBAL_RESOLUTION)


LINES_CLOSED = o.closure("closed", "lines", o.LINE_ROUNDS, ("l_orderkey",))
LINE_COLUMNS = "incoming_edge, outgoing_edge, via_edge, cost, l_orderkey"


@register("filter_cost_ceiling", o.query(o.LINES, LINES_CLOSED, select=f"SELECT {LINE_COLUMNS} FROM closed WHERE cost < 10"))
def filter_cost_ceiling(n):
    return paths.below_cost(closed_lines(n), 10)


@register("one_region_paths", o.query(o.REGIONS, select="SELECT src, dst, cost, next_node, l_orderkey, l_returnflag FROM regions WHERE l_returnflag = 'R'"))
def one_region_paths(n):
    return paths.one_region(n.regions, l_returnflag="R")


# -- C. joins and merges ------------------------------------------------------

@register("extend_paths_once", o.query(o.LINES, o.improved_once("better", "lines", ("l_orderkey",)), select=f"SELECT {LINE_COLUMNS} FROM better_chains"))
def extend_paths_once(n):
    return paths.extend(n.placed_lines, n.placed_lines, ORDER)


@register("extend_paths_uncelled", o.query(o.TRADE, o.improved_once("better", "trade"), select=f"SELECT {o.PAIR} FROM better_chains"))
def extend_paths_uncelled(n):
    return paths.extend(n.trade, n.trade, SHORTCUT)


@register("changed_rows", o.query(o.LINES, o.improved_once("better", "lines", ("l_orderkey",)), select=f"""
SELECT {LINE_COLUMNS} FROM better b WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.incoming_edge = b.incoming_edge
 AND l.outgoing_edge = b.outgoing_edge AND l.cost = b.cost AND l.l_orderkey = b.l_orderkey)"""))
def changed_rows(n):
    newer = paths.improve_once(n.placed_lines, ORDER)
    return paths.changed_rows(newer, n.placed_lines, [*ORDER.keys, "cost"])


@register("changed_rows_3key", o.query(o.TRADE, o.improved_once("better", "trade"), select=f"""
SELECT {o.PAIR} FROM better b WHERE NOT EXISTS (SELECT 1 FROM trade l WHERE l.incoming_edge = b.incoming_edge
 AND l.outgoing_edge = b.outgoing_edge AND l.cost = b.cost)"""))
def changed_rows_3key(n):
    newer = paths.improve_once(n.trade, SHORTCUT)
    return paths.changed_rows(newer, n.trade, ["incoming_edge", "outgoing_edge", "cost"])


@register("merge_shortcuts", o.query(o.TRADE, o.improved_once("better", "trade"), """
cheap AS (SELECT * FROM better WHERE cost < 20)""", select=f"""
SELECT {o.PAIR} FROM trade WHERE (incoming_edge, outgoing_edge) NOT IN (SELECT (incoming_edge, outgoing_edge) FROM cheap)
UNION ALL SELECT {o.PAIR} FROM cheap"""))
def merge_shortcuts(n):
    return merge.merge_shortcuts(n.trade, paths.below_cost(paths.improve_once(n.trade, SHORTCUT), 20))


RETURNED = "l_orderkey IN (SELECT l_orderkey FROM order_lines WHERE l_returnflag = 'R')"


@register("merge_by_partition", o.query(o.LINES, f"returned AS MATERIALIZED (SELECT * FROM lines WHERE {RETURNED})",
    o.closure("closed", "returned", o.LINE_ROUNDS, ("l_orderkey",)), select=f"""
SELECT {LINE_COLUMNS} FROM lines WHERE NOT {RETURNED} UNION ALL SELECT {LINE_COLUMNS} FROM closed"""))
def merge_by_partition(n):
    """Orders with a returned line are closed and replace their former rows in a stored table."""
    returned = n.order_lines.where("l_returnflag = 'R'").select("l_orderkey")
    table = store.VersionedTable(n.spark, fresh_path(n.spark, "orders"), ["l_orderkey"]).create(n.lines)
    closed = closure(table.read().join(returned, "l_orderkey", "left_semi"), ORDER, method="grouped")
    return table.replace(closed).read()


FLAGGED = """
flagged AS MATERIALIZED (
  SELECT *, l_orderkey NOT IN (SELECT l_orderkey FROM better b WHERE NOT EXISTS (SELECT 1 FROM lines l
    WHERE l.incoming_edge = b.incoming_edge AND l.outgoing_edge = b.outgoing_edge AND l.cost = b.cost)) AS is_converged
  FROM better)"""


def flagged_lines(n):
    return paths.flag_converged(paths.improve_once(n.placed_lines, ORDER), n.placed_lines, ORDER)


@register("cell_convergence_flags", o.query(o.LINES, o.improved_once("better", "lines", ("l_orderkey",)), FLAGGED, select=f"SELECT {LINE_COLUMNS}, is_converged FROM flagged"))
def cell_convergence_flags(n):
    return flagged_lines(n)


@register("all_cells_converged", o.query(o.LINES, o.improved_once("better", "lines", ("l_orderkey",)), FLAGGED, select="SELECT bool_and(is_converged) AS all_converged FROM flagged"))
def all_cells_converged(n):
    return paths.all_converged(flagged_lines(n))


@register("best_path_joinback", o.query(o.LINES, o.improved_once("better", "lines", ("l_orderkey",)), select=f"""
SELECT DISTINCT {LINE_COLUMNS} FROM better_all
QUALIFY cost = min(cost) OVER (PARTITION BY incoming_edge, outgoing_edge, l_orderkey)"""))
def best_path_joinback(n):
    both = n.placed_lines.unionByName(paths.extend(n.placed_lines, n.placed_lines, ORDER))
    return paths.cheapest_with_ties(both, ORDER)


@register("motif_two_hop", o.query(o.TRADE, """
named AS (SELECT incoming_edge AS src, outgoing_edge AS dst, cost FROM trade),
nations AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation)""", select="""
SELECT a.id AS a_id, a.name AS a_name, e.cost AS e_cost, b.id AS b_id, b.name AS b_name, e2.cost AS e2_cost,
       c.id AS c_id, c.name AS c_name
FROM named e JOIN named e2 ON e.dst = e2.src JOIN nations a ON a.id = e.src JOIN nations b ON b.id = e.dst
JOIN nations c ON c.id = e2.dst"""))
def motif_two_hop(n):
    edges = n.trade.select(F.col("incoming_edge").alias("src"), F.col("outgoing_edge").alias("dst"), "cost")
    found = graph.two_step_paths(n.nations, edges)
    return found.select(
        F.col("a.id").alias("a_id"), F.col("a.name").alias("a_name"), F.col("e.cost").alias("e_cost"),
        F.col("b.id").alias("b_id"), F.col("b.name").alias("b_name"), F.col("e2.cost").alias("e2_cost"),
        F.col("c.id").alias("c_id"), F.col("c.name").alias("c_name"),
    )


# -- D, E. cheapest rows ------------------------------------------------------

@register("min_cost_per_pair", o.query(o.LINES, o.improved_once("better", "lines", ("l_orderkey",)), select="""
SELECT incoming_edge, outgoing_edge, l_orderkey, min(cost) AS cost FROM better_all GROUP BY ALL"""))
def min_cost_per_pair(n):
    return paths.lowest_costs(n.placed_lines.unionByName(paths.extend(n.placed_lines, n.placed_lines, ORDER)), ORDER)


@register("best_arc_per_pair", o.query(o.LINES, o.improved_once("better", "lines", ("l_orderkey",)), select=f"SELECT {LINE_COLUMNS} FROM better"))
def best_arc_per_pair(n):
    return paths.cheapest(n.placed_lines.unionByName(paths.extend(n.placed_lines, n.placed_lines, ORDER)), ORDER)


@register("best_path_window", o.query(o.LINES, o.improved_once("better", "lines", ("l_orderkey",)), select=f"SELECT {LINE_COLUMNS} FROM better"))
def best_path_window(n):
    return paths.cheapest_by_rank(n.placed_lines.unionByName(paths.extend(n.placed_lines, n.placed_lines, ORDER)), ORDER)


@register("best_path_uncelled", o.query(o.TRADE, o.improved_once("better", "trade"), select=f"SELECT {o.PAIR} FROM better"))
def best_path_uncelled(n):
    return paths.cheapest_by_rank(n.trade.unionByName(paths.extend(n.trade, n.trade, SHORTCUT)), SHORTCUT)


@register("path_set_difference", o.query(o.LINES, o.improved_once("better", "lines", ("l_orderkey",)), select=f"""
SELECT {LINE_COLUMNS} FROM better EXCEPT SELECT {LINE_COLUMNS} FROM lines"""))
def path_set_difference(n):
    return paths.path_difference(paths.improve_once(n.placed_lines, ORDER), n.placed_lines, ORDER)


@register("region_list", o.query(o.REGIONS, select="SELECT DISTINCT l_orderkey::VARCHAR || '_' || l_returnflag AS region_key FROM regions"))
def region_list(n):
    return paths.region_list(n.regions, REGION.groups)


# -- D. reports ---------------------------------------------------------------

VALUES = o.cumulative("ranked", "closed", "cost")


@register("cost_stats", o.query(o.LINES, LINES_CLOSED, VALUES, select=f"""
SELECT count(*) AS total_paths, min(cost) AS min_cost, max(cost) AS max_cost, round(avg(cost), 6) AS avg_cost,
  round(stddev_samp(cost), 6) AS stddev_cost, {o.percentile("ranked", 0.5)} AS median_cost,
  {o.percentile("ranked", 0.95)} AS p95_cost FROM closed"""))
def cost_stats(n):
    return reports.cost_stats(closed_lines(n), exact=True).withColumns(
        {name: F.round(name, 6) for name in ("avg_cost", "stddev_cost")}
    )


@register("cost_stats_minutes", o.query(o.TRADE, o.closure("closed", "trade", 4), VALUES, select=f"""
SELECT count(*) AS total_paths, round(min(cost) / 60, 6) AS min_cost, round(max(cost) / 60, 6) AS max_cost,
  round(avg(cost) / 60, 6) AS avg_cost, round(stddev_samp(cost) / 60, 6) AS stddev_cost,
  round({o.percentile("ranked", 0.5)} / 60, 6) AS median_cost,
  round({o.percentile("ranked", 0.95)} / 60, 6) AS p95_cost FROM closed"""))
def cost_stats_minutes(n):
    stats = reports.cost_stats(closed_trade(n), exact=True, unit=60)
    return stats.select("total_paths", *[F.round(name, 6).alias(name) for name in stats.columns[1:]])


@register("distinct_edges", o.query(o.LINES, LINES_CLOSED, select="""
SELECT count(DISTINCT incoming_edge) AS unique_incoming, count(DISTINCT outgoing_edge) AS unique_outgoing,
  count(DISTINCT via_edge) AS unique_via FROM closed"""))
def distinct_edges(n):
    return reports.distinct_edges(closed_lines(n))


@register("reach_out", o.query(o.LINES, LINES_CLOSED, select="""
SELECT incoming_edge, count(*) AS num_destinations, round(avg(cost), 6) AS avg_cost_to_destinations
FROM closed GROUP BY incoming_edge"""))
def reach_out(n):
    return reports.reach_out(closed_lines(n)).withColumn(
        "avg_cost_to_destinations", F.round("avg_cost_to_destinations", 6))


@register("reach_in", o.query(o.LINES, LINES_CLOSED, select="""
SELECT outgoing_edge, count(*) AS num_sources, round(avg(cost), 6) AS avg_cost_from_sources
FROM closed GROUP BY outgoing_edge"""))
def reach_in(n):
    return reports.reach_in(closed_lines(n)).withColumn(
        "avg_cost_from_sources", F.round("avg_cost_from_sources", 6))


@register("top_sources", o.query(o.LINES, LINES_CLOSED, select="""
SELECT incoming_edge, count(*) AS num_destinations FROM closed GROUP BY incoming_edge
ORDER BY num_destinations DESC, incoming_edge LIMIT 10"""))
def top_sources(n):
    return reports.top(
        reports.reach_out(closed_lines(n)).select("incoming_edge", "num_destinations"), 10,
        F.desc("num_destinations"), F.asc("incoming_edge"))


@register("degree_summary", o.query(o.LINES, LINES_CLOSED, """
degrees AS (SELECT incoming_edge, count(*) AS n FROM closed GROUP BY incoming_edge)""", select="""
SELECT round(avg(n), 6) AS mean_destinations, round(quantile_cont(n, 0.5), 6) AS median_destinations FROM degrees"""))
def degree_summary(n):
    return reports.degree_summary(closed_lines(n)).select(
        F.round("mean_destinations", 6).alias("mean_destinations"),
        F.round("median_destinations", 6).alias("median_destinations"))


@register("direct_vs_multihop", o.query(o.LINES, LINES_CLOSED, select="""
SELECT CASE WHEN via_edge = outgoing_edge THEN 'direct' ELSE 'multi_hop' END AS path_type, count(*) AS paths,
  round(avg(cost), 6) AS avg_cost, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM closed), 6) AS share_percent
FROM closed GROUP BY 1"""))
def direct_vs_multihop(n):
    return reports.direct_vs_multihop(closed_lines(n)).withColumns(
        {name: F.round(name, 6) for name in ("avg_cost", "share_percent")})


@register("via_usage", o.query(o.LINES, LINES_CLOSED, select="SELECT via_edge, count(*) AS usage_count FROM closed GROUP BY via_edge"))
def via_usage(n):
    return reports.via_usage(closed_lines(n))


@register("via_usage_top20", o.query(o.LINES, LINES_CLOSED, select="""
SELECT via_edge, count(*) AS usage_count FROM closed GROUP BY via_edge ORDER BY usage_count DESC, via_edge LIMIT 20"""))
def via_usage_top20(n):
    return reports.most_used(closed_lines(n), 20)


@register("cost_percentiles", o.query(o.LINES, LINES_CLOSED, VALUES, select="SELECT " + ", ".join(
    f"{o.percentile('ranked', p)} AS {reports.percentile_name(p)}" for p in reports.PERCENTILES)))
def cost_percentiles(n):
    return reports.percentiles(closed_lines(n), "cost")


def bins_sql(table: str, column: str) -> str:
    return f"""
limits AS (SELECT min({column})::DOUBLE AS low, max({column})::DOUBLE AS high FROM {table}),
counted AS (SELECT least(floor(({column} - low) * 50 / (high - low)), 49)::BIGINT AS bin, count(*) AS n
            FROM {table}, limits GROUP BY 1)"""


BINS_SELECT = """
SELECT b.bin, round(low + b.bin * ((high - low) / 50), 6) AS bin_start,
  round(low + (b.bin + 1) * ((high - low) / 50), 6) AS bin_end, coalesce(n, 0) AS rows
FROM (SELECT unnest(range(50)) AS bin) b CROSS JOIN limits LEFT JOIN counted USING (bin)"""


def rounded_bins(df):
    return df.withColumns({name: F.round(name, 6) for name in ("bin_start", "bin_end")})


@register("cost_histogram", o.query(o.LINES, LINES_CLOSED, bins_sql("closed", "cost"), select=BINS_SELECT))
def cost_histogram(n):
    return rounded_bins(reports.histogram(closed_lines(n), "cost"))


@register("degree_histogram", o.query(o.LINES, LINES_CLOSED, """
degrees AS (SELECT incoming_edge, count(*) AS degree FROM closed GROUP BY incoming_edge)""",
    bins_sql("degrees", "degree"), select=BINS_SELECT))
def degree_histogram(n):
    # The bins need the degrees twice.
    degrees = durable(reports.reach_out(closed_lines(n)).select("num_destinations"), "degrees")
    return rounded_bins(reports.histogram(degrees, "num_destinations"))


@register("cost_box_summary", o.query(o.LINES, LINES_CLOSED, """
quartiles AS (SELECT quantile_cont(cost, 0.25) AS q1, quantile_cont(cost, 0.5) AS median,
  quantile_cont(cost, 0.75) AS q3 FROM closed),
fences AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS low, q3 + 1.5::DOUBLE * (q3 - q1) AS high FROM quartiles)""", select="""
SELECT any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
  min(cost) FILTER (cost BETWEEN low AND high) AS whisker_low,
  max(cost) FILTER (cost BETWEEN low AND high) AS whisker_high,
  count(*) FILTER (cost < low OR cost > high) AS outliers FROM closed, fences"""))
def cost_box_summary(n):
    return reports.box_summary(closed_lines(n), "cost")


@register("summary_report", o.query(o.LINES, LINES_CLOSED, VALUES, select=f"""
SELECT 'Total Shortcuts' AS figure, count(*)::DOUBLE AS value FROM closed
UNION ALL SELECT 'Unique Edges', count(DISTINCT incoming_edge)::DOUBLE FROM closed
UNION ALL SELECT 'Direct Paths', count(*) FILTER (via_edge = outgoing_edge)::DOUBLE FROM closed
UNION ALL SELECT 'Multi-hop Paths', count(*) FILTER (via_edge <> outgoing_edge)::DOUBLE FROM closed
UNION ALL SELECT 'Min Cost (sec)', min(cost) FROM closed
UNION ALL SELECT 'Max Cost (sec)', max(cost) FROM closed
UNION ALL SELECT 'Avg Cost (sec)', round(avg(cost), 6) FROM closed
UNION ALL SELECT 'Median Cost (sec)', {o.percentile("ranked", 0.5)}
UNION ALL SELECT 'P95 Cost (sec)', {o.percentile("ranked", 0.95)}"""))
def summary_report(n):
    path = fresh_path(n.spark, "summary-csv")
    report = reports.summary_report(closed_lines(n), exact=True)
    store.write_csv(report.withColumn("value", F.round("value", 6)), path)
    return store.read_csv(n.spark, path, report.schema)


@register("shortcuts_by_resolution", o.query(*PLACED, select='SELECT via_res, count(*) AS "count" FROM placed GROUP BY via_res'))
def shortcuts_by_resolution(n):
    return reports.by_resolution(placed_suppliers(n))


FINAL = (o.SUPPLIERS, o.PLACES, ALL_PASSES, final_sql(LAST))


@register("cell_stats", o.query(*FINAL, select="""
SELECT cell, count(*) AS shortcut_count, round(avg(cost), 6) AS avg_cost, min(cost) AS min_cost, max(cost) AS max_cost
FROM final GROUP BY cell"""))
def cell_stats(n):
    return reports.cell_stats(final_suppliers(n)).withColumn("avg_cost", F.round("avg_cost", 6))


def ledger_sql() -> str:
    """Steps that hold rows count them; the finer levels are empty."""
    rows, before = [], "supplier_shortcuts"
    kinds = ["down"] * len(o.DOWN) + ["global"] + ["up"] * len(o.UP)
    for kind, (name, res) in zip(kinds, ALL_STEPS):
        seen = f"SELECT count(*) FROM {name}_placed WHERE {o.level_condition(res)}"
        after = f"SELECT count(*) FROM {name} t JOIN pair_places p USING (incoming_edge, outgoing_edge)"
        placed_now = o.level_condition(res).replace("via_res", o.resolution("p.via_cell"))
        after += f" WHERE {placed_now} AND cost < 'inf'::DOUBLE"
        rows.append(f"SELECT '{kind}' AS pass_name, {res} AS resolution, ({seen}) AS rows_in, ({after}) AS rows_out, "
                    f"(SELECT count(*) FROM {name}) AS table_rows")
    first, last = "supplier_shortcuts", LAST
    rows.append(f"SELECT 'down', unnest(range(3, 16))::INTEGER, 0, 0, (SELECT count(*) FROM {first})")
    rows.append(f"SELECT 'up', unnest(range(3, 16))::INTEGER, 0, 0, (SELECT count(*) FROM {last})")
    return " UNION ALL ".join(rows)


@register("run_ledger", o.query(o.SUPPLIERS, o.PLACES, ALL_PASSES, select=ledger_sql()))
def run_ledger(n):
    return three_passes(n).ledger_table().select("pass_name", "resolution", "rows_in", "rows_out", "table_rows")


# -- F. top, sample -----------------------------------------------------------

@register("top_cheapest", o.query(o.LINES, LINES_CLOSED, select=f"SELECT {o.PAIR} FROM closed ORDER BY cost, incoming_edge, outgoing_edge LIMIT 10"))
def top_cheapest(n):
    return reports.cheapest_paths(closed_lines(n), 10)


@register("top_dearest", o.query(o.LINES, LINES_CLOSED, select=f"SELECT {o.PAIR} FROM closed ORDER BY cost DESC, incoming_edge, outgoing_edge LIMIT 10"))
def top_dearest(n):
    return reports.dearest_paths(closed_lines(n), 10)


def hash_sql(columns: str, seed: int) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {columns}, '{seed}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@register("sample_fraction", o.query(o.LINES, LINES_CLOSED, select=f"SELECT {LINE_COLUMNS} FROM closed WHERE {hash_sql('incoming_edge, outgoing_edge', 42)} < 0.01"))
def sample_fraction(n):
    return sampling.sample_fraction(closed_lines(n), 0.01, 42, ["incoming_edge", "outgoing_edge"])


@register("sample_to_size", o.query(o.LINES, LINES_CLOSED, select=f"""
SELECT {LINE_COLUMNS} FROM closed
WHERE {hash_sql('incoming_edge, outgoing_edge', 7)} < least(10000::DOUBLE / (SELECT count(*) FROM closed), 1.0)"""))
def sample_to_size(n):
    return sampling.sample_to_size(closed_lines(n), 10_000, 7, ["incoming_edge", "outgoing_edge"])


# -- H. cells -----------------------------------------------------------------

@register("cell_resolution", o.query(*PLACED, select=f"SELECT incoming_edge, outgoing_edge, via_cell, CAST({o.resolution('via_cell')} AS INTEGER) AS resolution FROM placed"))
def cell_resolution(n):
    return placed_suppliers(n).select(
        "incoming_edge", "outgoing_edge", "via_cell", cells.resolution("via_cell").alias("resolution"))


@register("cell_ancestor", o.query(o.SUPPLIERS, """
wanted AS (SELECT id, incoming_cell, unnest(range(-1, 16))::INTEGER AS res FROM supplier_inputs)""",
    select=f"SELECT id, res, {o.ancestor('incoming_cell', 'res')} AS ancestor FROM wanted"))
def cell_ancestor(n):
    wanted = n.supplier_inputs.select("id", "incoming_cell", F.explode(F.sequence(F.lit(-1), F.lit(15))).alias("res"))
    return wanted.select("id", "res", cells.ancestor("incoming_cell", "res").alias("ancestor"))


@register("cell_lca", o.query(o.SUPPLIERS, select=f"SELECT id, {o.common_ancestor('incoming_cell', 'outgoing_cell')} AS common FROM supplier_inputs"))
def cell_lca(n):
    return n.supplier_inputs.select(
        "id", cells.common_ancestor("incoming_cell", "outgoing_cell").alias("common"))


@register("current_cell", o.query(*PLACED, select=f"SELECT {o.PAIR}, {o.ancestor('via_cell', 1)} AS current_cell FROM placed"))
def current_cell(n):
    return celled.with_current_cell(placed_suppliers(n), 1)


def text_sql(cell: str) -> str:
    return f"CASE WHEN {cell} <> 0 THEN lower(hex({cell})) END"


@register("cell_string_forms", o.query(o.SUPPLIERS, select=f"""
SELECT id, {text_sql('incoming_cell')} AS incoming_text,
  {text_sql(o.ancestor('incoming_cell', 0))} AS base_text,
  {text_sql(o.common_ancestor('incoming_cell', 'outgoing_cell'))} AS common_text,
  CAST({o.resolution(o.common_ancestor('incoming_cell', 'outgoing_cell'))} AS INTEGER) AS common_res
FROM supplier_inputs"""))
def cell_string_forms(n):
    text = n.supplier_inputs.select(
        "id", cells.to_text("incoming_cell").alias("a"), cells.to_text("outgoing_cell").alias("b"))
    return text.select(
        "id", F.col("a").alias("incoming_text"), cells.text_ancestor("a", 0).alias("base_text"),
        cells.text_common_ancestor("a", "b").alias("common_text"),
    ).withColumn("common_res", cells.text_resolution("common_text"))


@register("base_cells", o.query(o.SUPPLIERS, select=f"""
SELECT DISTINCT {o.ancestor('cell', 0)} AS cell FROM
(SELECT incoming_cell AS cell FROM supplier_inputs UNION ALL SELECT outgoing_cell FROM supplier_inputs)"""))
def base_cells(n):
    return cells.base_cells(n.supplier_inputs, "incoming_cell", "outgoing_cell")


@register("final_info", o.query(o.SUPPLIERS, o.PLACES, final_sql("supplier_shortcuts"), select=f"SELECT {FINAL_COLUMNS} FROM final"))
def final_info(n):
    return celled.add_final_info(n.supplier_shortcuts, n.supplier_edges)


# -- G. closures --------------------------------------------------------------

@register("cell_closure", o.query(o.LINES, o.closure("closed", "lines", o.LINE_ROUNDS, ("l_orderkey",), "middle"), select=f"SELECT {LINE_COLUMNS} FROM closed"))
def cell_closure(n):
    return closure(n.dealt_lines, ORDER, method="doubling", hop_rule="middle", placed=True)


@register("cell_closure_delta", o.query(o.LINES, LINES_CLOSED, select=f"SELECT {LINE_COLUMNS} FROM closed"))
def cell_closure_delta(n):
    return closure(n.dealt_lines, ORDER, method="stepwise", placed=True)


@register("cell_closure_grouped", o.query(o.LINES, LINES_CLOSED, select=f"SELECT {LINE_COLUMNS} FROM closed"))
def cell_closure_grouped(n):
    return closure(n.dealt_lines, ORDER, method="grouped", placed=True)


VISIT_COLUMNS = "src, dst, cost, next_node, visitor, lane"


@register("closure_of_text_ids", o.query(o.VISITS, o.closure("closed", "visits", o.LINE_ROUNDS, ("visitor", "lane"), "last", "src", "dst", "next_node"), select=f"SELECT {VISIT_COLUMNS} FROM closed"))
def closure_of_text_ids(n):
    """Text ids and text groups, closed as dense numbers."""
    return dictionary.closure_by_numbers(n.visits, VISIT)


@register("id_numbers", o.query(o.VISITS, select="""
SELECT id, row_number() OVER (ORDER BY id) - 1 AS number FROM (SELECT src AS id FROM visits UNION SELECT dst FROM visits)"""))
def id_numbers(n):
    return dictionary.numbered(n.visits.select("src"), n.visits.select("dst"))


FAR = 1 << 60  # ids that a double cannot tell apart


@register("closure_of_odd_ids", o.query(o.LINES, f"""
far AS MATERIALIZED (SELECT incoming_edge + {FAR} AS incoming_edge, outgoing_edge + {FAR} AS outgoing_edge,
  via_edge + {FAR} AS via_edge, cost, l_orderkey FROM lines)""", o.closure("closed", "far", o.LINE_ROUNDS, ("l_orderkey",)), select=f"""
SELECT {LINE_COLUMNS} FROM closed UNION ALL
SELECT NULL::BIGINT AS incoming_edge, outgoing_edge, min(via_edge) AS via_edge, min(cost) AS cost, l_orderkey FROM far WHERE cost > 40
GROUP BY outgoing_edge, l_orderkey"""))
def closure_of_odd_ids(n):
    """Ids beyond 2^53 in small cells, beside rows whose id could not be read."""
    far = n.lines.withColumns({c: F.col(c) + FAR for c in ("incoming_edge", "outgoing_edge", "via_edge")})
    # Both kinds of rows come from one pass over the lines.
    both = far.withColumn("read", F.explode(F.expr("IF(cost > 40, array(true, false), array(true))")))
    both = both.withColumn("incoming_edge", F.expr("IF(read, incoming_edge, NULL)")).drop("read")
    return closure(both, ORDER, method="grouped", keep_unusable=True)


@register("closure_first_hop", o.query(o.TRADE, o.closure("closed", "trade", 4, (), "first"), select=f"SELECT {o.PAIR} FROM closed"))
def closure_first_hop(n):
    return closure(n.trade, SHORTCUT, hop_rule="first")


@register("all_pairs_exact", o.query(o.TRADE, o.closure("closed", "trade", 4), select=f"SELECT {o.PAIR} FROM closed"))
def all_pairs_exact(n):
    return closure(n.trade, SHORTCUT)


REGION_COLUMNS = "src, dst, cost, next_node, l_orderkey, l_returnflag"


def region_closure_sql(name: str, table: str) -> str:
    return o.closure(name, table, o.LINE_ROUNDS, REGION.groups, "first", "src", "dst", "next_node")


@register("region_closure", o.query(o.REGIONS, region_closure_sql("closed", "regions"), select=f"SELECT {REGION_COLUMNS} FROM closed"))
def region_closure(n):
    return bounded.region_closure(n.regions, REGION, hop_rule="first")


def bounded_sql(ceiling: int, rounds: int = 3) -> str:
    ctes, table = [], "regions"
    for i in range(rounds):
        ctes.append(f"below_{i} AS MATERIALIZED (SELECT {REGION_COLUMNS} FROM {table} WHERE cost < {ceiling})")
        ctes.append(region_closure_sql(f"closed_{i}", f"below_{i}"))
        ctes.append(
            f"merged_{i} AS MATERIALIZED (SELECT {REGION_COLUMNS} FROM {table} WHERE (l_orderkey, l_returnflag) NOT IN "
            f"(SELECT (l_orderkey, l_returnflag) FROM closed_{i}) UNION ALL SELECT {REGION_COLUMNS} FROM closed_{i})")
        table = f"merged_{i}"
    return ",\n".join(ctes)


@register("bounded_cost_pipeline", o.query(o.REGIONS, bounded_sql(10), select=f"SELECT {REGION_COLUMNS} FROM merged_2"))
def bounded_cost_pipeline(n):
    return bounded.bounded_cost_pipeline(n.regions, REGION, ceiling=10, hop_rule="first")


ONE_STEP, _ = o.passes([1])


@register("resolution_step", o.query(o.SUPPLIERS, o.PLACES, ONE_STEP, select=f"SELECT {o.PAIR} FROM s0"))
def resolution_step(n):
    return hierarchy.resolution_step(n.supplier_shortcuts, n.supplier_edges, 1)


@register("single_resolution", o.query(o.SUPPLIERS, o.PLACES, ONE_STEP, select=f"""
SELECT {o.PAIR} FROM s0_closed UNION ALL SELECT {o.PAIR} FROM s0_level
WHERE NOT coalesce(cost < 'inf'::DOUBLE, false) AND (incoming_edge, outgoing_edge) NOT IN (SELECT (incoming_edge, outgoing_edge) FROM s0_closed)"""))
def single_resolution(n):
    return hierarchy.single_resolution(n.supplier_shortcuts, n.supplier_edges, 1)


@register("downward_pass", o.query(o.SUPPLIERS, o.PLACES, DOWN_PASSES, select=f"SELECT {o.PAIR} FROM {DOWN_STEPS[-1][0]}"))
def downward_pass(n):
    return start_run(n).downward().shortcuts()


GLOBAL_PASS, _ = o.passes(o.GLOBAL)


@register("global_step", o.query(o.SUPPLIERS, o.PLACES, GLOBAL_PASS, select=f"SELECT {o.PAIR} FROM s0"))
def global_step(n):
    return start_run(n).global_step().shortcuts()


UP_PASSES, UP_STEPS = o.passes(o.UP)


@register("upward_pass", o.query(o.SUPPLIERS, o.PLACES, UP_PASSES, select=f"SELECT {o.PAIR} FROM {UP_STEPS[-1][0]}"))
def upward_pass(n):
    return start_run(n).upward().shortcuts()


@register("hierarchical_shortcuts", o.query(*FINAL, select=f"SELECT {FINAL_COLUMNS} FROM final"))
def hierarchical_shortcuts(n):
    return three_passes(n).final()


@register("forced_methods", o.query(*FINAL, select=f"SELECT {FINAL_COLUMNS} FROM final"))
def forced_methods(n):
    """The whole job with the way of closing cells fixed for every resolution that holds rows."""
    options = hierarchy.Options(grouped_resolutions=(2, 0), distributed_resolutions=(1, -1))
    return hierarchy.three_passes(n.supplier_shortcuts, n.supplier_edges, options).final()


@register("method_by_cell_size", o.query(*PLACED, "levels AS (" + " UNION ALL ".join(
    f"SELECT {res} AS resolution, {o.ancestor('via_cell', res)} AS current_cell FROM placed WHERE {o.level_condition(res)}"
    for res in range(-1, 16)) + ")", select="""
SELECT resolution, current_cell, count(*) AS rows,
  CASE WHEN count(*) <= 1000 THEN 'grouped' ELSE 'distributed' END AS method FROM levels GROUP BY ALL"""))
def method_by_cell_size(n):
    return hierarchy.cell_methods(placed_suppliers(n), range(-1, 16))


# -- G. whole graphs ----------------------------------------------------------

LANDMARKS = (1, 2)


@register("landmark_distances", "WITH RECURSIVE " + o.PARTS.strip() + f""",
links AS MATERIALIZED (SELECT DISTINCT src, dst FROM part_edges),
reached AS (
  SELECT p_partkey AS id, p_partkey AS landmark, 0 AS distance FROM part WHERE p_partkey IN {LANDMARKS}
  UNION SELECT src, landmark, distance + 1 FROM reached JOIN links ON dst = id WHERE distance < 12)
SELECT id, landmark, CAST(min(distance) AS INTEGER) AS distance FROM reached GROUP BY id, landmark""")
def landmark_distances(n):
    return graph.landmark_distances(n.part_vertices, n.part_edges, LANDMARKS)


def pagerank_sql(rounds: int = 5) -> str:
    ctes = ["""
links AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE / any_value(degree) AS weight FROM part_edges
  JOIN (SELECT src, count(*) AS degree FROM part_edges GROUP BY src) USING (src) GROUP BY src, dst),
rank_0 AS MATERIALIZED (SELECT p_partkey AS id, 1.0::DOUBLE AS rank FROM part)""".strip()]
    for i in range(rounds):
        ctes.append(
            f"rank_{i + 1} AS MATERIALIZED (SELECT id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(received, 0) AS rank "
            f"FROM rank_0 LEFT JOIN (SELECT dst AS id, sum(rank * weight) AS received FROM links "
            f"JOIN rank_{i} ON src = id GROUP BY dst) USING (id))")
    return ",\n".join(ctes)


@register("pagerank_5", o.query(o.PARTS, pagerank_sql(), select="""
SELECT id, round(rank * (SELECT count(*) / sum(rank) FROM rank_5), 6) AS pagerank FROM rank_5"""))
def pagerank_5(n):
    return graph.pagerank(n.part_vertices, n.part_edges).withColumn("pagerank", F.round("pagerank", 6))


def components_sql(edges: str, vertices: str, rounds: int) -> str:
    ctes = [f"both_ways AS MATERIALIZED (SELECT src AS id, dst AS other FROM {edges} UNION SELECT dst, src FROM {edges})",
            f"label_0 AS MATERIALIZED (SELECT id, id AS component FROM {vertices})"]
    for i in range(rounds):
        ctes.append(
            f"label_{i + 1} AS MATERIALIZED (SELECT l.id, least(any_value(l.component), coalesce(min(r.component), any_value(l.component))) AS component "
            f"FROM label_{i} l LEFT JOIN both_ways b ON l.id = b.id LEFT JOIN label_{i} r ON b.other = r.id GROUP BY l.id)")
    return ",\n".join(ctes)


@register("connected_components", o.query(o.CONSECUTIVE, """
line_edges AS (SELECT line AS src, next_line AS dst FROM consecutive WHERE gap = 1),
line_vertices AS (SELECT line AS id FROM order_lines)""", components_sql("line_edges", "line_vertices", 9),
    select="SELECT id, component FROM label_9"))
def connected_components(n):
    return graph.connected_components(n.line_vertices, n.line_edges)


@register("connected_components_dense", o.query(o.PARTS, "part_vertices AS (SELECT p_partkey AS id FROM part)",
    components_sql("part_edges", "part_vertices", 10), select="SELECT id, component FROM label_10"))
def connected_components_dense(n):
    return graph.connected_components(n.part_vertices, n.part_edges)


@register("graph_vertices", o.query(o.PARTS, select="SELECT src AS id FROM part_edges UNION SELECT dst FROM part_edges"))
def graph_vertices(n):
    return graph.vertices_of(n.part_edges)


# -- K. quality ---------------------------------------------------------------

@register("missing_share", """
WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS length FROM orders GROUP BY o_custkey),
edges AS (SELECT c_custkey AS id, c_acctbal AS maxspeed, length FROM customer LEFT JOIN spent ON c_custkey = o_custkey),
shares AS (
  SELECT 'id' AS column_name, avg(CASE WHEN id IS NULL THEN 1 ELSE 0 END) * 100 AS missing_percent FROM edges
  UNION ALL SELECT 'maxspeed', avg(CASE WHEN maxspeed IS NULL THEN 1 ELSE 0 END) * 100 FROM edges
  UNION ALL SELECT 'length', avg(CASE WHEN length IS NULL THEN 1 ELSE 0 END) * 100 FROM edges)
SELECT column_name, round(missing_percent, 6) AS missing_percent, missing_percent <= 5 AS within_limit FROM shares""")
def missing_share(n):
    return quality.missing_share(n.customer_edges, ["id", "maxspeed", "length"]).withColumn(
        "missing_percent", F.round("missing_percent", 6))


@register("duplicate_keys", o.query(o.PARTS, select="SELECT src, dst, count(*) AS occurrences FROM part_edges GROUP BY src, dst HAVING count(*) > 1"))
def duplicate_keys(n):
    return quality.duplicate_keys(n.part_edges, ["src", "dst"])


@register("orphan_arcs", """
WITH arcs AS (SELECT o_custkey AS incoming_edge, l_suppkey AS outgoing_edge FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT incoming_edge, outgoing_edge, i.s_suppkey IS NULL AS unknown_incoming, u.s_suppkey IS NULL AS unknown_outgoing
FROM arcs LEFT JOIN supplier i ON i.s_suppkey = incoming_edge LEFT JOIN supplier u ON u.s_suppkey = outgoing_edge
WHERE i.s_suppkey IS NULL OR u.s_suppkey IS NULL""")
def orphan_arcs(n):
    # Customer numbers beyond the last supplier are unknown edges.
    t = n.tables
    arcs = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("incoming_edge"), F.col("l_suppkey").alias("outgoing_edge"))
    return quality.orphan_arcs(arcs, t.supplier.select(F.col("s_suppkey").alias("id")))


@register("invalid_cells", o.query(o.SUPPLIERS, select="""
SELECT id, incoming_cell, CASE WHEN maxspeed > 0 THEN outgoing_cell ELSE outgoing_cell - 1 END AS outgoing_cell
FROM supplier_inputs WHERE maxspeed <= 0"""))
def invalid_cells(n):
    # One off the cell of every closed road breaks its last digit.
    broken = n.supplier_inputs.withColumn(
        "outgoing_cell", F.when(F.col("maxspeed") > 0, F.col("outgoing_cell")).otherwise(F.col("outgoing_cell") - 1))
    return quality.invalid_cells(broken)


# Ways to break a resolution-2 cell, as expressions that both engines read.
BASE, DIGITS = 127 << 45, 63 << 39
BREAKS = [
    ("NULL", "missing"),
    ("{cell} | (-9223372036854775807 - 1)", "top bit"),
    (f"{{cell}} | {1 << 60}", "mode"),
    (f"{{cell}} | {1 << 56}", "reserved bits"),
    (f"{{cell}} | {BASE}", "base cell"),
    (f"{{cell}} | {7 << 42}", "digit"),
    ("{cell} - 1", "finer digit"),
    (f"({{cell}} & ~{BASE} & ~{DIGITS}) | {(14 << 45) | (1 << 39)}", "deleted subsequence"),
    # No faults: no cell, and a part of a pentagon that exists.
    ("0", None),
    (f"({{cell}} & ~{BASE} & ~{DIGITS}) | {(14 << 45) | (2 << 39)}", None),
]
#: Each column's cells are broken by the edge's number plus this, modulo 12; two in twelve stay as they are.
BREAK_BY = {"incoming_cell": 0, "outgoing_cell": 3}


def broken_cells(n: Networks) -> DataFrame:
    def broken(name: str, shift: int):
        cases = " ".join(f"WHEN {k} THEN {rule.format(cell=name)}" for k, (rule, _) in enumerate(BREAKS))
        return F.expr(f"CASE (id + {shift}) % 12 {cases} ELSE {name} END").cast("long").alias(name)

    return n.supplier_inputs.select("id", *[broken(name, shift) for name, shift in BREAK_BY.items()])


def faults_sql() -> str:
    told = " ".join(f"WHEN {k} THEN {reason!r}" if reason else f"WHEN {k} THEN NULL" for k, (_, reason) in enumerate(BREAKS))
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, CASE (id + {shift}) % 12 {told} "
        f"ELSE CASE WHEN {o.in_deleted_part(name)} THEN 'deleted subsequence' END END AS reason FROM supplier_inputs"
        for name, shift in BREAK_BY.items())
    return f"SELECT column_name, reason, count(*) AS rows FROM ({rows}) WHERE reason IS NOT NULL GROUP BY ALL"


@register("cell_fault_counts", o.query(o.SUPPLIERS, select=faults_sql()))
def cell_fault_counts(n):
    """Every part of the layout broken on a share of all rows, counted by reason."""
    return quality.fault_counts(broken_cells(n))


# Lines of an edge file, broken by the edge's number; every 13th line is followed by the header once more.
FILE_HEADER = "id,incoming_cell,outgoing_cell,lca_res,length,maxspeed"
FILE_LINES = """
WHEN 0 THEN {id} || ',' || {a} || ',' || {b}
WHEN 1 THEN {id} || ',' || {a} || ',' || {b} || ',' || {rest} || ',9'
WHEN 2 THEN 'x' || {id} || ',' || {a} || ',' || {b} || ',' || {rest}
WHEN 3 THEN ',' || {a} || ',' || {b} || ',' || {rest}
WHEN 4 THEN {id} || ',' || {a} || '9,' || {b} || ',' || {rest}
WHEN 5 THEN {id} || ',' || {a} || ',no cell,' || {rest}
WHEN 6 THEN {id} || ', ' || {hex_a} || ' ,"' || {hex_b} || '",' || {rest}
WHEN 7 THEN {id} || ',' || {hex_a} || 'g,' || {b} || ',' || {rest}
WHEN 8 THEN {id} || ',' || {a} || ',' || {b} || ',' || {rest} || 'm'
WHEN 9 THEN {id} || ',' || {a} || ',' || {broken_b} || ',' || {rest}
WHEN 10 THEN {id} || ',' || {a} || ',,' || {rest}
ELSE {id} || ',' || {a} || ',' || {b} || ',' || {rest} END"""


def edge_lines(text: str, hexadecimal: str) -> str:
    """The expression of an edge's line; ``text`` and ``hexadecimal`` turn a number into text."""
    rest = " || ',' || ".join([text.format("lca_res"), f"coalesce({text.format('CAST(length AS BIGINT)')}, '')", text.format("CAST(maxspeed AS BIGINT)")])
    return "CASE id % 13 " + FILE_LINES.format(
        id=text.format("id"), a=text.format("incoming_cell"), b=text.format("outgoing_cell"), rest=rest,
        hex_a=hexadecimal.format("incoming_cell"), hex_b=hexadecimal.format("outgoing_cell"), broken_b=text.format("(outgoing_cell - 1)"))


LINES_SQL = f"edge_lines AS (SELECT *, {edge_lines('({0})::VARCHAR', 'lower(hex({0}))')} AS line FROM supplier_inputs)"
IN_PENTAGON = f"({o.in_deleted_part('incoming_cell')} OR {o.in_deleted_part('outgoing_cell')})"


def checked_edge_file(n: Networks):
    """An edge file of good and bad lines, read again."""
    lines = n.supplier_inputs.selectExpr("id", f"{edge_lines('CAST({0} AS STRING)', 'lower(hex({0}))')} AS line")
    again = F.when(F.col("id") % 13 == 12, F.array("line", F.lit(FILE_HEADER))).otherwise(F.array("line"))
    path = fresh_path(n.spark, "edge-lines")
    # One text column whose name is the header: every file begins with it.
    lines.select(F.explode(again).alias(FILE_HEADER)).write.options(header=True, sep="\x01", quote="\x02", escapeQuotes=False).csv(path)
    return network.read_checked(n.spark, path)


@register("edges_accepted", o.query(o.SUPPLIERS, LINES_SQL, select=f"""
SELECT id, incoming_cell, CASE WHEN id % 13 <> 10 THEN outgoing_cell END AS outgoing_cell, lca_res, length, maxspeed FROM edge_lines
WHERE id % 13 IN (6, 10, 11, 12) AND NOT {o.in_deleted_part('incoming_cell')} AND (id % 13 = 10 OR NOT {o.in_deleted_part('outgoing_cell')})"""))
def edges_accepted(n):
    return checked_edge_file(n)[0]


@register("edges_rejected", o.query(o.SUPPLIERS, LINES_SQL, f"""
told AS (SELECT id, line, CASE WHEN id % 13 < 2 THEN 'fields' WHEN id % 13 = 3 THEN 'missing' WHEN id % 13 IN (2, 8) THEN 'number'
    WHEN id % 13 IN (5, 7) THEN 'cell' WHEN id % 13 IN (4, 9) OR {o.in_deleted_part('incoming_cell')}
      OR (id % 13 <> 10 AND {o.in_deleted_part('outgoing_cell')}) THEN 'layout' END AS reason,
  CASE WHEN id % 13 < 2 THEN NULL WHEN id % 13 IN (2, 3) THEN 'id' WHEN id % 13 IN (4, 7) THEN 'incoming_cell' WHEN id % 13 = 8 THEN 'maxspeed'
    WHEN id % 13 <> 5 AND {o.in_deleted_part('incoming_cell')} THEN 'incoming_cell' ELSE 'outgoing_cell' END AS column_name FROM edge_lines)""", select=f"""
SELECT line, column_name, reason FROM told WHERE reason IS NOT NULL
UNION ALL SELECT '{FILE_HEADER}', NULL, 'header' FROM edge_lines WHERE id % 13 = 12"""))
def edges_rejected(n):
    return checked_edge_file(n)[1]


# -- sketches and bounds --------------------------------------------------------

SKETCH_LEVELS = (1, 0, -1)


def supplier_sketches(n: Networks) -> DataFrame:
    return stored(n, "supplier-sketches", lambda: sketches.cell_sketches(final_suppliers(n)))


def supplier_edge_sets(n: Networks) -> DataFrame:
    return stored(n, "supplier-edge-sets", lambda: sketches.edge_sets(final_suppliers(n)))


SKETCHED = "sketched AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT {res} AS resolution, {o.ancestor('cell', res)} AS cell, incoming_edge, outgoing_edge, via_edge, cost FROM final" for res in SKETCH_LEVELS) + ")"


@register("sketch_ranks", o.query(*FINAL, SKETCHED, select=f"""
SELECT resolution, cell, share, count(*) AS rows, TRUE AS within_bound
FROM (SELECT *, unnest({list(reports.PERCENTILES)}::DOUBLE[]) AS share FROM sketched WHERE cost IS NOT NULL) GROUP BY ALL"""))
def sketch_ranks(n):
    """Cost percentiles of each cell, merged up from sketches, held against the ranks they have in the rows."""
    checked = []
    for res in SKETCH_LEVELS:
        found = sketches.quantiles(sketches.merged_up(supplier_sketches(n), res))
        ranks = sketches.rank_check(final_suppliers(n), found, cells.ancestor("cell", res))
        checked.append(ranks.select(F.lit(res).alias("resolution"), "cell", "share", "rows", "within_bound"))
    return reduce(DataFrame.unionByName, checked)


@register("sketch_distincts", o.query(*FINAL, SKETCHED, select=" UNION ALL ".join(
    f"SELECT resolution, cell, '{role}' AS role, count(*) AS rows, count(DISTINCT {role}) AS \"distinct\", TRUE AS within_bound FROM sketched GROUP BY ALL"
    for role in sketches.EDGES)))
def sketch_distincts(n):
    """Distinct edges of each cell, merged up from sketches, held against exact counts."""
    checked = []
    for res in SKETCH_LEVELS:
        found = sketches.distinct_counts(sketches.merged_up(supplier_sketches(n), res))
        counts = sketches.distinct_check(supplier_edge_sets(n), found, cells.ancestor("cell", res))
        checked.append(counts.select(F.lit(res).alias("resolution"), "cell", "role", "rows", "distinct", "within_bound"))
    return reduce(DataFrame.unionByName, checked)


@register("approximate_ranks", o.query(o.LINES, LINES_CLOSED, select=f"""
SELECT share, count(*) AS rows, TRUE AS within_bound
FROM (SELECT unnest({list(reports.PERCENTILES)}::DOUBLE[]) AS share FROM closed WHERE cost IS NOT NULL) GROUP BY share"""))
def approximate_ranks(n):
    """The approximate percentiles of all closed paths, held against the ranks they have in the rows."""
    shares = [F.lit(share) for share in reports.PERCENTILES]
    found = reports.approximate_percentiles(closed_lines(n), "cost")
    values = F.arrays_zip(F.array(*shares).alias("share"), F.array(*map(F.col, found.columns)).alias("estimate"))
    nowhere = F.lit(None).cast("long")
    asked = found.select(nowhere.alias("cell"), F.explode(values).alias("_v")).select("cell", "_v.share", "_v.estimate")
    bound = 1 / reports.DEFAULT_ACCURACY
    return sketches.rank_check(closed_lines(n), asked, nowhere, bound=bound, few_costs=True).select("share", "rows", "within_bound")


TARGETS = (3, 7, 11)


@register("landmark_bounds", "WITH RECURSIVE " + o.PARTS.strip() + f""",
links AS MATERIALIZED (SELECT DISTINCT src, dst FROM part_edges),
reached AS (
  SELECT p_partkey AS id, p_partkey AS landmark, 0 AS distance FROM part WHERE p_partkey IN {LANDMARKS + TARGETS}
  UNION SELECT src, landmark, distance + 1 FROM reached JOIN links ON dst = id WHERE distance < 12),
known AS MATERIALIZED (SELECT id, landmark, min(distance) AS distance FROM reached GROUP BY id, landmark),
maps AS (SELECT * FROM known WHERE landmark IN {LANDMARKS})
SELECT t.id, t.landmark AS target, t.distance::INTEGER AS distance,
  count(b.landmark) = count(a.landmark) AS reachable, greatest(0, coalesce(max(a.distance - b.distance), 0))::INTEGER AS bound
FROM known t LEFT JOIN maps b ON b.id = t.landmark LEFT JOIN maps a ON a.id = t.id AND a.landmark = b.landmark
WHERE t.landmark IN {TARGETS} GROUP BY t.id, t.landmark, t.distance""")
def landmark_bounds(n):
    """The bound that landmark maps give for each distance to some other vertices."""
    maps = graph.distance_maps(graph.landmark_distances(n.part_vertices, n.part_edges, LANDMARKS))
    true = graph.landmark_distances(n.part_vertices, n.part_edges, TARGETS).withColumnRenamed("landmark", "target")
    return graph.distance_bounds(true.select("id", "target", "distance"), maps)
