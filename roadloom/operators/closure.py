"""Closing a path table: cheapest paths between all pairs a group connects.

Three ways to the same costs:

``doubling``  chains paths with paths, so h hops need about log2(h) rounds, at
              the price of many candidates once the table is large.
``stepwise``  doubles as long as the table stays within ``growth`` times the
              input, then extends only the paths the last round improved, by
              the paths known at that point. Work grows with result rows times
              steps per node. The default.
``grouped``   solves small groups inside grouped-map tasks of bounded size, deals
              the sources of larger ones out to tasks and leaves the largest to
              ``stepwise``.

From ``IN_TASK_FROM`` rows on the rounds of ``stepwise`` and ``doubling`` are joins only
for groups too large for one task: a small group's rows are placed together once and its
rounds run there, so nothing is shuffled or written between them. With the last hop a
larger group is dealt out by source: the paths from one source need the group's paths but
no path from another source, so each task closes its own sources over a copy of them, however
many pairs that makes. Groups with more rows than a task may hold go through the joins.

The loop carries costs only, as primitive hash aggregates; hops are found in
one pass at the end. A round joins what changed with all paths and all paths with
what changed, never all with all again. Rows that an earlier closing has already
closed with each other say so (``Closed``) and are not joined with each other at
all, so closing a table again costs about its changed rows times their degree.
The table is kept in buckets of its key, in layers: a round shuffles its
candidates to where the known costs lie and adds the better ones as a layer.
Nodes where very many pairs meet are split on both sides of the join. Rows of NULL or infinite cost and rows that lead an edge to
itself never take part in a path.
With equal costs the lowest hop wins; on cycles of zero-cost arcs the hops of
equally cheap pairs may refer to each other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.durable import durable, fresh_path, read_stored, write_and_read
from roadloom.functions.costs import usable_sql
from roadloom.keyed import BUCKET_ROWS, MOST_LAYERS, Layers, write_in_buckets
from roadloom.operators.paths import CELLED, PathColumns, cheapest, cost_order_sql
from roadloom.operators.skew import GRID_SIDE, meeting_join

GROWTH = 8.0
#: Rounds that can't make more pairs than this always double: fewer rounds are worth more then.
DOUBLING_PAIRS = 200_000_000
GROUPED_ROWS = 1_000
#: A group solved by one task among others has no more rows than this, whatever is asked for: it takes a cell per possible pair.
MOST_GROUPED_ROWS = 3_000
#: Of the groups solved in one call: possible pairs and rows, about.
BUCKET_PAIRS = 2_000_000
BUCKET_ARCS = 200_000
#: Rounds that join all paths with all, as doubling and the middle hop do, make up to the cube of a group's rows.
DOUBLED_ROWS = 100
IN_TASK_FROM = BUCKET_ROWS
#: Groups dealt out by source: most rows, as each slice has a copy of them.
SLICED_ROWS = 3_000_000
#: A slice's share of the pairs of a source and a target, as long as the slices are few and then, and of the chains that one look
#: at all arcs makes; and the most slices of a group.
SLICE_PAIRS = 500_000
FEW_SLICES = 64
LARGE_SLICE_PAIRS = 16_000_000
SLICE_CHAINS = 1_000_000_000
MOST_SLICES = 1_000
#: Closing by source: costs kept at once, a source's row of them at least; chains looked at together; rows returned together.
SOURCE_CELLS = 16_000_000
SWEEP_CHAINS = 250_000
RETURNED_ROWS = 500_000
MOST_PARTITIONS = 10_000
ROWS = "count(*)"
#: True for rows that a closing of placed groups has left as they were.
OPEN = "_open"
#: True for rows that are no part of any path and stay unless a path replaces them.
BESIDE = "_beside"


class NotConverged(RuntimeError):
    """The round limit was reached while paths were still improving."""


@dataclass(frozen=True)
class Closed:
    """Two columns that tell what an earlier closing has done for the rows.

    Rows with the same value in ``group`` were closed with each other and have not changed
    since. ``stepped`` has the same value where the row was as it is now when that closing
    began, so that hops over it are known as well; else it is NULL. Both are NULL in rows
    the closing knows nothing about.
    """

    group: str
    stepped: str


def closure(
    paths: DataFrame,
    columns: PathColumns = CELLED,
    *,
    method: str = "stepwise",
    hop_rule: str = "last",
    about_source: Sequence[str] = (),
    about_target: Sequence[str] = (),
    closed_before: Sequence[Closed] = (),
    carried: Sequence[str] = (),
    max_rounds: int | None = None,
    allow_partial: bool = False,
    keep_unusable: bool = False,
    growth: float = GROWTH,
    hot_rows: int = GRID_SIDE,
    most_layers: int = MOST_LAYERS,
    grouped_rows: int = GROUPED_ROWS,
    in_task_from: int | None = IN_TASK_FROM,
    sliced_rows: int = SLICED_ROWS,
    placed: bool = False,
) -> DataFrame:
    """Cheapest path per (source, target, groups) over the given paths.

    ``hop_rule`` names the edge stored as hop of a composed path: the ``last``
    one before the target, the ``first`` one after the source as stored in the
    input, or the lowest ``middle`` one. An input row that is not beaten keeps
    its own hop unless an equally cheap path has a lower one.

    ``about_source`` and ``about_target`` are columns that depend on the source
    or the target alone; composed paths inherit them, which saves joining them
    on again. ``carried`` columns stay with the rows whose cost does not change and
    are NULL in all others. ``keep_unusable`` keeps input rows that cannot take part
    as long as no path replaces them. ``max_rounds`` limits the rounds of the joins;
    reaching it raises ``NotConverged`` unless ``allow_partial``.

    ``closed_before`` names what earlier closings have done; such tables have one row per
    key, and hops are found with the ``last`` rule. A node where more than ``hot_rows``
    squared pairs meet is split. Tables of ``in_task_from`` rows or more run the rounds of their
    small groups inside tasks; with None, or with a limit on rounds, all rounds are joins.
    Groups of more than ``grouped_rows`` and up to ``sliced_rows`` rows are dealt out by source
    where the last hop is stored and paths do not double.

    ``placed`` tells that a group's rows lie in one partition, as a window over the groups leaves
    them. Small groups are then closed where they lie: nothing is shuffled or stored before, and the
    closed rows are stored instead. It changes no row, and does nothing with ``closed_before``,
    ``keep_unusable`` or a limit on rounds.
    """
    if closed_before and hop_rule != "last":
        raise ValueError("closings are remembered for the last hop only")
    if method == "grouped":
        if hop_rule != "last":
            raise ValueError("the grouped method stores the last hop")
        return _by_group_size(
            paths, columns, grouped_rows, sliced_rows=sliced_rows, placed=placed, about_source=about_source, about_target=about_target,
            closed_before=closed_before, carried=carried,
            keep_unusable=keep_unusable, max_rounds=max_rounds, allow_partial=allow_partial,
            growth=growth, hot_rows=hot_rows, most_layers=most_layers,
        )
    if in_task_from is not None and columns.groups and max_rounds is None:
        return _by_group_size(
            paths, columns, grouped_rows, method, hop_rule, in_task_from, sliced_rows=sliced_rows, placed=placed, about_source=about_source, about_target=about_target,
            closed_before=closed_before, carried=carried,
            keep_unusable=keep_unusable, max_rounds=None, allow_partial=allow_partial,
            growth=growth, hot_rows=hot_rows, most_layers=most_layers,
        )
    about, marks = [*about_source, *about_target], [name for c in closed_before for name in (c.group, c.stepped)]
    arcs = paths.select(*columns.all, *about, *marks, *carried)
    if not keep_unusable:
        arcs = arcs.where(_live(columns))
    arcs, seen = write_and_read(
        cheapest(arcs, columns, [*about, *marks], carried), fresh_path(paths.sparkSession, "arcs"), rows=F.expr(ROWS)
    )
    if allow_partial and max_rounds == 0:
        return arcs.drop(*marks)
    loop = _Relaxation(arcs, seen["rows"], columns, about_source, about_target, closed_before, carried, hot_rows, most_layers)
    # Finding the hops extends the paths once more: it is the last round.
    limit = max_rounds - 1 if allow_partial and max_rounds else max_rounds
    costs = loop.closed_costs(float("inf") if method == "doubling" else growth, limit, allow_partial)
    return loop.with_hops(costs, hop_rule)


def _live(columns: PathColumns) -> str:
    """True for rows a path may be built from: usable cost, ends apart."""
    return f"({usable_sql(columns.cost)} AND {columns.source} <> {columns.target})"


class _Relaxation:
    """The rounds of one closure over a stored table of arcs."""

    def __init__(self, arcs, rows, columns, about_source, about_target, closed_before, carried, hot_rows, most_layers):
        self.arcs = arcs
        self.rows = rows
        self.columns = columns
        self.about_source = list(about_source)
        self.about_target = list(about_target)
        self.about = [*about_source, *about_target]
        self.groups_before = [c.group for c in closed_before]
        self.stepped_before = [c.stepped for c in closed_before]
        self.carried = list(carried)
        self.hot_rows = hot_rows
        self.most_layers = most_layers
        self.closed_rows = rows
        self._most_nodes: int | None = None
        self.live_arcs = arcs.where(_live(columns))

    def _costs_only(self, paths: DataFrame) -> DataFrame:
        return paths.select(*self.columns.keys, self.columns.cost, *self.about, *self.groups_before)

    def chain(self, left: DataFrame, right: DataFrame, *extra: str, pairs: int | None = None, unless: str = "false") -> DataFrame:
        """Left paths joined to the right paths that start where they end.

        Columns named ``_left_*`` and ``_right_*`` go along for ``extra`` and ``unless``;
        ``pairs`` is the most that can meet in one node.
        """
        c = self.columns
        left = left.selectExpr(
            c.source, *c.groups, f"{c.target} AS _mid", f"{c.cost} AS _left_cost", *self.about_source,
            *[name for name in left.columns if name.startswith("_left_")],
        )
        right = right.selectExpr(
            c.target, *c.groups, f"{c.source} AS _mid", f"{c.cost} AS _right_cost", *self.about_target,
            *[name for name in right.columns if name.startswith("_right_")],
        )
        met = meeting_join(left, right, ["_mid", *c.groups], [c.source], [c.target], self.hot_rows, pairs)
        return met.where(f"{c.source} <> {c.target} AND NOT ({unless})").selectExpr(
            *c.keys, f"_left_cost + _right_cost AS {c.cost}", *self.about, *extra
        )

    def _unmet(self, left: DataFrame, right: DataFrame, left_marks: list[str], right_marks: list[str], *extra: str, pairs: int) -> DataFrame:
        """Chains of all pairs but those that an earlier closing has met.

        Rows without marks meet all others. Of the rest, only nodes whose rows do not all
        come from one group are joined.
        """
        c = self.columns
        if not left_marks:
            return self.chain(left, right, *extra, pairs=pairs)
        new_left, new_right = (f"coalesce({', '.join(marks)}) IS NULL" for marks in (left_marks, right_marks))
        met = self.chain(left.where(new_left), right, *extra, pairs=pairs).unionByName(
            self.chain(left.where(f"NOT ({new_left})"), right.where(new_right), *extra, pairs=pairs)
        )
        left, right = left.where(f"NOT ({new_left})"), right.where(f"NOT ({new_right})")
        numbered = range(len(left_marks))
        ends = left.selectExpr(f"{c.target} AS _node", *c.groups, *[f"{m} AS _mark{i}" for i, m in zip(numbered, left_marks)]).unionByName(
            right.selectExpr(f"{c.source} AS _node", *c.groups, *[f"{m} AS _mark{i}" for i, m in zip(numbered, right_marks)])
        )
        told = [f"{f}(_mark{i}) AS _{f}{i}" for i in numbered for f in ("min", "max", "count")]
        one_group = " OR ".join(f"(_count{i} = _rows AND _min{i} = _max{i})" for i in numbered)
        mixed, seen = write_and_read(
            ends.groupBy("_node", *c.groups).agg(F.expr("count(*) AS _rows"), *map(F.expr, told)).where(f"NOT ({one_group})").select("_node", *c.groups),
            fresh_path(left.sparkSession, "mixed"), rows=F.expr("count(*)"),
        )
        if not seen["rows"]:
            return met
        left = left.join(mixed.withColumnRenamed("_node", c.target), [c.target, *c.groups], "left_semi").withColumnsRenamed(
            {m: f"_left_mark{i}" for i, m in zip(numbered, left_marks)})
        right = right.join(mixed.withColumnRenamed("_node", c.source), [c.source, *c.groups], "left_semi").withColumnsRenamed(
            {m: f"_right_mark{i}" for i, m in zip(numbered, right_marks)})
        known = " OR ".join(f"coalesce(_left_mark{i} = _right_mark{i}, false)" for i in numbered)
        return met.unionByName(self.chain(left, right, *extra, pairs=pairs, unless=known))

    def _lowest(self, rows: DataFrame) -> DataFrame:
        """One row per key: the lowest cost, and the marks that go with it."""
        c = self.columns
        return rows.groupBy(*c.keys).agg(
            *[F.expr(f"min({name}) AS {name}") for name in (c.cost, *self.about)],
            *[F.expr(f"min_by({name}, {cost_order_sql(c.cost)}) AS {name}") for name in self.groups_before],
        ).select(*c.keys, c.cost, *self.about, *self.groups_before)

    def better(self, candidates: DataFrame, table: Layers) -> DataFrame:
        """The lowest candidate of each key that no known row matches, without marks.

        Known rows lie in buckets of their key: the candidates alone are shuffled.
        """
        c = self.columns
        lowest = candidates.groupBy(*c.keys).agg(*[F.expr(f"min({name}) AS {name}") for name in (c.cost, *self.about)])
        unmarked = [F.lit(None).cast(self.arcs.schema[name].dataType).alias(name) for name in self.groups_before]
        return table.without_matched(lowest, c.cost).select(*c.keys, c.cost, *self.about, *unmarked)

    def closed_costs(self, growth: float, limit: int | None, allow_partial: bool) -> DataFrame:
        """Rounds until no cost improves.

        While the table stays within ``growth`` times the arcs, paths double: what the last
        round improved is joined with all paths on both sides. The last table within it then
        serves as steps: a path that improved is extended by each of them. Whatever did not
        improve met them a round ago. Rows that a later layer beats may still be met; what
        they make is beaten as well.
        """
        table = Layers(self.arcs.sparkSession, "paths", self.columns.keys, self._lowest)
        costs = self._costs_only(self.arcs)
        if self.rows >= BUCKET_ROWS:
            costs, _ = write_in_buckets(costs, fresh_path(self.arcs.sparkSession, "costs"), self.columns.keys)
        table.put(costs, self.rows)
        live = _live(self.columns)
        frontier, changed, steps, done = table.all().where(live), self.rows, None, 0
        while limit is None or done < limit:
            known = table.all().where(live)
            if steps is not None:
                candidates = self.chain(frontier, steps, pairs=changed * most)
            else:
                pairs = changed * self._most_at_a_node(known, changed, table.rows)
                if done == 0:
                    candidates = self._unmet(known, known, self.groups_before, self.groups_before, pairs=pairs)
                else:
                    candidates = self.chain(frontier, known, pairs=pairs).unionByName(self.chain(older, frontier, pairs=pairs))
            older = known
            frontier, seen = table.add(self.better(candidates, table), F.expr(ROWS))
            done, changed = done + 1, seen["rows"]
            if changed == 0:
                table.layers.pop()
                break
            # A caller who asks for less growth than usual gets steps as soon as it is passed.
            few = growth >= GROWTH and changed * min(table.rows, self.most_nodes()) <= DOUBLING_PAIRS
            if steps is None and table.rows > growth * self.rows and not few:
                steps = older
                most = self._most_at_a_node(steps, float("inf"), table.rows)
            table.compact(F.expr(ROWS), self.most_layers)
        else:
            if not allow_partial:
                raise NotConverged(f"paths still improved in round {done}")
        self.closed_rows = table.rows
        return table.merged() if len(table.layers) == 1 else durable(table.merged(), "paths")

    def most_nodes(self) -> int:
        """A bound on the nodes of one group: each of its arcs brings two at most."""
        if self._most_nodes is None:
            c = self.columns
            largest = self.arcs.groupBy(*c.groups).count().agg(F.max("count")).first()[0] if c.groups and self.rows > self.hot_rows else self.rows
            self._most_nodes = 2 * (largest or 0)
        return self._most_nodes

    def _most_at_a_node(self, table: DataFrame, others: float, rows: int) -> int:
        """The most rows that begin or end in one node, or a bound that is good enough for ``others`` rows."""
        if others * rows <= self.hot_rows**2 or rows <= self.hot_rows:
            return rows
        if others * self.most_nodes() <= self.hot_rows**2:
            return self.most_nodes()
        c = self.columns
        ends = table.selectExpr(f"{c.source} AS _node", *c.groups, "1 AS _out", "0 AS _in").unionByName(
            table.selectExpr(f"{c.target} AS _node", *c.groups, "0 AS _out", "1 AS _in")
        )
        counts = ends.groupBy("_node", *c.groups).agg(F.greatest(F.sum("_out"), F.sum("_in")).alias("_rows"))
        return counts.agg(F.max("_rows")).first()[0] or 0

    def _appended(self, path, state, steps, most, changed, done, limit, allow_partial) -> DataFrame:
        """Further rounds that only add their improvements to the stored table.

        A candidate counts unless a stored row of its pair costs no more. Few
        candidates are broadcast by the planner, and the table is then scanned
        without being shuffled or written again until the end.
        """
        c, spark = self.columns, state.sparkSession
        paths, frontier = [path], state.where(CHANGED)
        # What is known of a pair from before only holds for its first cost.
        lowest = [F.expr(f"min({name}) AS {name}") for name in [c.cost, *self.about]]
        unmarked = [F.lit(None).cast(state.schema[name].dataType).alias(name) for name in self.groups_before]
        while limit is None or done < limit:
            candidates = self.chain(frontier, steps, pairs=changed * most)
            found = durable(candidates.groupBy(*c.keys).agg(*lowest), "found")
            known = spark.read.schema(state.schema).parquet(*paths)
            beaten = (
                known.join(found.selectExpr(*c.keys, f"{c.cost} AS _found"), c.keys)
                .where(f"{c.cost} <= _found")
                .select(*c.keys)
            )
            better = found.join(beaten, c.keys, "left_anti").select("*", *unmarked, F.lit(True).alias(CHANGED)).select(*state.columns)
            paths.append(fresh_path(spark, "improved"))
            frontier, seen = write_and_read(better, paths[-1], rows=F.expr("count(*)"))
            done, changed = done + 1, seen["rows"]
            self.closed_rows += changed
            if changed == 0:
                break
        else:
            if not allow_partial:
                raise NotConverged(f"paths still improved in round {done}")
        known = spark.read.schema(state.schema).parquet(*paths)
        marks = [F.expr(f"min_by({name}, {c.cost}) AS {name}") for name in self.groups_before]
        return durable(known.groupBy(*c.keys).agg(*lowest, *marks), "paths")

    def with_hops(self, costs: DataFrame, hop_rule: str) -> DataFrame:
        """The closed costs with the lowest hop among all equally cheap last joins."""
        c = self.columns
        known = self._costs_only(costs.where(_live(c)))
        middle = f"_mid AS {c.hop}"
        if hop_rule == "middle":
            composed = self.chain(known, known, middle, pairs=self.closed_rows * self._most_at_a_node(known, self.closed_rows, self.closed_rows))
        else:
            pairs = self.closed_rows * self._most_at_a_node(self.live_arcs, self.closed_rows, self.rows)
            if hop_rule == "last":
                composed = self._unmet(known, self.live_arcs, self.groups_before, self.stepped_before, middle, pairs=pairs)
            elif hop_rule == "first":
                composed = self.chain(self.live_arcs.withColumnRenamed(c.hop, "_left_hop"), known, f"_left_hop AS {c.hop}", pairs=pairs)
            else:
                raise ValueError(f"unknown hop rule {hop_rule!r}")
        names = [*c.all, *self.about, *self.carried]
        nothing = [f"CAST(NULL AS {self.arcs.schema[name].dataType.simpleString()}) AS {name}" for name in self.carried]
        # A key has one candidate per node before its target at most, so placing
        # the rows by key first lets both aggregations run without a shuffle.
        rows = self.arcs.select(*names).unionByName(composed.selectExpr("*", *nothing).select(*names)).repartition(*c.keys)
        return cheapest(rows, c, self.about, self.carried).select(*names)


def _by_group_size(
    paths, columns, grouped_rows, method="stepwise", hop_rule="last", in_task_from=0, *, sliced_rows, placed=False, about_source, about_target, closed_before, carried, keep_unusable, max_rounds, **joins
) -> DataFrame:
    """Small groups in grouped-map tasks, groups beyond ``grouped_rows`` by source, the largest by joins.

    The rounds are those of ``method``, wherever they run. A table below ``in_task_from`` rows is
    closed by joins as a whole, unless its rows are ``placed``.

    Only rows that can be part of a path are grouped; the others stay beside as they are
    unless a path replaces them. Rounds belong to the joins, so with a limit on them all
    groups are closed by joins.
    """
    groups = list(columns.groups)
    if not groups:
        raise ValueError("the grouped method needs group columns")
    by_joins = dict(
        method=method, hop_rule=hop_rule, about_source=about_source, about_target=about_target, closed_before=closed_before,
        carried=carried, in_task_from=None, **joins,
    )
    if max_rounds is not None:
        return closure(paths, columns, keep_unusable=keep_unusable, max_rounds=max_rounds, **by_joins)
    about, marks = [*about_source, *about_target], [name for c in closed_before for name in (c.group, c.stepped)]
    names = [*columns.all, *about, *carried]
    chained = " AND ".join([f"coalesce({_live(columns)}, false)", *(f"{name} IS NOT NULL" for name in groups)])
    given = paths.select(*columns.all, *about, *marks, *carried)
    if not keep_unusable:
        given = given.where(_live(columns))
    solver = _Solver(columns, about_source, about_target, closed_before, carried, method, hop_rule)
    grouped_rows, pairs_of_row = min(grouped_rows, MOST_GROUPED_ROWS), "_rows"
    if method == "doubling" or hop_rule == "middle":
        grouped_rows, pairs_of_row = min(grouped_rows, DOUBLED_ROWS), "_rows * _rows"
    if placed and not closed_before and not keep_unusable:
        path = fresh_path(paths.sparkSession, "closed")
        stored, seen = write_and_read(solver.solved_in_place(given, chained, grouped_rows, pairs_of_row), path, open=F.expr(f"count_if({OPEN})"))
        if not seen["open"]:
            return read_stored(paths.sparkSession, path, given.schema)
        others = _by_group_size(
            stored.where(OPEN).drop(OPEN), columns, grouped_rows, method, hop_rule, sliced_rows=sliced_rows, about_source=about_source,
            about_target=about_target, closed_before=closed_before, carried=carried, keep_unusable=keep_unusable, max_rounds=None, **joins,
        )
        return stored.where(f"NOT {OPEN}").select(*names).unionByName(others.select(*names))
    keyed = " AND ".join(f"{name} IS NOT NULL" for name in columns.keys)
    stored, seen = write_and_read(
        given, fresh_path(paths.sparkSession, "paths"), rows=F.expr(ROWS),
        beside=F.expr(f"count_if(NOT ({chained}))"), replaceable=F.expr(f"count_if(NOT ({chained}) AND {keyed})"),
    )
    if seen["rows"] < in_task_from:
        return closure(stored, columns, keep_unusable=keep_unusable, **by_joins)
    rows = stored.where(chained) if seen["beside"] else stored
    sizes = rows.groupBy(*groups).agg(F.expr("count(*) AS _rows"))
    measured = sizes.selectExpr(
        f"count_if(_rows > {grouped_rows}) AS large", f"count_if(_rows <= {grouped_rows}) AS small",
        f"coalesce(sum(IF(_rows > {grouped_rows}, 0, _rows * {pairs_of_row})), 0) AS pairs",
        f"coalesce(sum(IF(_rows > {grouped_rows}, 0, _rows)), 0) AS rows",
    ).first()
    buckets = max(measured["pairs"] // BUCKET_PAIRS, measured["rows"] // BUCKET_ARCS) + 1
    within = None
    if seen["replaceable"]:
        within = durable(cheapest(stored.where(f"NOT ({chained}) AND {keyed}"), columns, about, carried).select(*names), "beside")
    if not measured["large"]:
        closed = solver.solved(rows, buckets, within)
    else:
        sliced_rows = sliced_rows if method == "stepwise" and hop_rule == "last" else 0
        large, seen_large = _slices(rows, sizes.where(f"_rows > {grouped_rows}"), columns, sliced_rows)
        parts = []
        # Tasks say which rows beside are replaced, joins do not.
        told, asked = (None, within) if seen_large["joined"] else (within, None)
        if seen_large["sliced"]:
            parts.append(solver.solved_by_source(rows, large.where("_slices > 0"), seen_large["slices"], told))
        if seen_large["joined"]:
            by_joins = closure(rows.join(large.where("_slices = 0"), groups, "left_semi"), columns, **by_joins)
            parts.append(by_joins.select(*names))
        if measured["small"] or told is not None:
            small = rows.join(large, groups, "left_anti").select(*rows.columns)
            told = told and told.join(large, groups, "left_anti").select(*names)
            parts.append(solver.solved(small, buckets, told).select(*names))
        closed = reduce(DataFrame.unionByName, parts)
        if asked is not None:
            # The rows beside may be few and the closed ones many: the closed keys are asked for theirs, not sent to them.
            closed = durable(closed, "closed")
            replaced = closed.select(*columns.keys).join(asked.select(*columns.keys), columns.keys, "left_semi")
            closed = closed.unionByName(asked.join(replaced, columns.keys, "left_anti").select(*names))
    if seen["beside"] == seen["replaceable"]:
        return closed
    # Closed rows have whole keys: they replace no row in whose key something is missing.
    without = stored.where(f"NOT ({chained}) AND NOT ({keyed})")
    return closed.unionByName(cheapest(without, columns, about, carried).select(*names))


def _with_beside(rows: DataFrame, beside: DataFrame | None) -> DataFrame:
    """The rows of a solver's calls, with those that stay unless a path replaces them, marked."""
    if beside is None:
        return rows
    return rows.withColumn(BESIDE, F.lit(False)).unionByName(beside.withColumn(BESIDE, F.lit(True)), allowMissingColumns=True)


def _slices(rows: DataFrame, large: DataFrame, columns: PathColumns, sliced_rows: int) -> tuple[DataFrame, dict]:
    """The slices each large group's sources are dealt out to, stored; 0 for groups that are closed by joins."""
    groups = list(columns.groups)
    if not sliced_rows:
        counted = large.selectExpr(*groups, "0 AS _slices")
    else:
        pairs = "_sources * _targets"
        asked = f"ceil(greatest(least({pairs} / {SLICE_PAIRS}, {FEW_SLICES}), {pairs} / {LARGE_SLICE_PAIRS}, _sources * _rows / {SLICE_CHAINS}))"
        counted = rows.join(large.select(*groups), groups, "left_semi").groupBy(*groups).agg(
            F.expr("count(*) AS _rows"),
            *[F.approx_count_distinct(end).cast("double").alias(name) for end, name in ((columns.source, "_sources"), (columns.target, "_targets"))],
        ).selectExpr(*groups, f"CAST(IF(_rows > {sliced_rows}, 0, greatest(1, least({asked}, _sources, {MOST_SLICES}))) AS INT) AS _slices")
    return write_and_read(
        counted, fresh_path(rows.sparkSession, "large-groups"),
        sliced=F.expr("count_if(_slices > 0)"), joined=F.expr("count_if(_slices = 0)"), slices=F.expr("coalesce(sum(_slices), 0)"),
    )


def _codes(values: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct ones in order, and these; null comes last."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    encoded = values.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(encoded.dictionary, null_placement="at_end")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[encoded.indices.to_numpy()], encoded.dictionary.take(order)


def _first_of_each(key, *tie_breaks):
    """Positions of the lowest row per key, in key order."""
    order = np.argsort(key)
    if len(order) and (key[order[1:]] == key[order[:-1]]).any():
        order = np.lexsort((*reversed(tie_breaks), key))
    return order[np.append(True, key[order][1:] != key[order][:-1])] if len(order) else order


def _told(table: pa.Table, is_open: bool) -> list[pa.RecordBatch]:
    return table.append_column(OPEN, pa.repeat(is_open, table.num_rows)).to_batches()


def _cuts(group: np.ndarray, load: np.ndarray) -> Iterator[int]:
    """Where to cut rows that come group by group, so that the load between two cuts is about 1; never behind the last group."""
    starts = np.flatnonzero(group[1:] != group[:-1]) + 1
    upto, begin = np.append(0.0, np.cumsum(load)), 0
    while upto[-1] - upto[begin] >= 1 and len(starts):
        fitting = max(int(np.searchsorted(upto[starts], upto[begin] + 1, side="right")), 1)
        begin, starts = int(starts[fitting - 1]), starts[fitting:]
        yield begin


def _lowered(best: np.ndarray, cell: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Puts the prices below the best ones in their cells; these cells, in order."""
    lower = price < best[cell]
    cell = cell[lower]
    np.minimum.at(best, cell, price[lower])
    if len(cell) * 16 < len(best):
        return np.unique(cell)
    improved = np.zeros(len(best), bool)
    improved[cell] = True
    return np.flatnonzero(improved)


def _lowest_hops(cells: int, ids: int, direct, direct_cost, direct_hop, made, price, hop) -> np.ndarray:
    """Per cell the lowest hop among the cheapest of its arc and the paths made for it."""
    lowest = np.full(cells, np.inf)
    lowest[direct] = direct_cost
    np.minimum.at(lowest, made, price)
    via = np.full(cells, ids)
    kept = direct_cost == lowest[direct]
    via[direct[kept]] = direct_hop[kept]
    kept = price == lowest[made]
    np.minimum.at(via, made[kept], hop[kept])
    return via


class _Numbered:
    """The rows of a table as arcs between numbered nodes: one arc per key, in key order.

    Ids and (group, id) nodes become positions in sorted lists, so the lower position is the lower id.
    """

    def __init__(self, table: pa.Table, c: PathColumns):
        group = np.zeros(table.num_rows, np.int64)
        for name in c.groups:
            code, values = _codes(table[name])
            group = np.unique(group * len(values) + code, return_inverse=True)[1]
        ends = pa.concat_arrays([table[name].combine_chunks() for name in (c.source, c.target, c.hop)])
        codes, self.ids = _codes(ends)
        source_id, target_id, hop_id = codes.reshape(3, -1)
        node_keys = np.concatenate([group * len(self.ids) + source_id, group * len(self.ids) + target_id])
        nodes, positions = np.unique(node_keys, return_inverse=True)
        self.start, end = positions.reshape(2, -1)
        self.id_of, self.n = nodes % len(self.ids), len(nodes)
        self.group_of = nodes // len(self.ids)
        costs = table[c.cost].to_numpy()
        self.row_of_start, self.row_of_end = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.row_of_start[self.start] = self.row_of_end[end] = np.arange(len(end))
        key = self.start * self.n + end
        live = np.arange(table.num_rows)
        self.beside = live[:0]
        if BESIDE in table.column_names:
            beside = table[BESIDE].to_numpy()
            live, self.beside = np.flatnonzero(~beside), np.flatnonzero(beside)
        self.beside_start, self.beside_end = self.start[self.beside], end[self.beside]
        self.arcs = live[_first_of_each(key[live], costs[live], hop_id[live])]
        self.arc_key, self.arc_cost, self.arc_hop = key[self.arcs], costs[self.arcs], hop_id[self.arcs]
        self.start, self.end = self.start[live], end[live]

    def number_cells(self) -> None:
        """A cell per pair of a source and a target of one group, in the order of the paths' keys."""
        begins, ends = np.zeros(self.n, bool), np.zeros(self.n, bool)
        begins[self.start], ends[self.end] = True, True
        first = np.flatnonzero(np.append(True, self.group_of[1:] != self.group_of[:-1]))
        size = np.diff(np.append(first, self.n))
        targets = np.add.reduceat(ends.astype(np.int64), first)
        width = np.where(begins, np.repeat(targets, size), 0)
        self.place_of_end, self.targets = np.cumsum(ends) - 1, np.flatnonzero(ends)
        self.cells_before = np.cumsum(width) - width - np.repeat(np.cumsum(targets) - targets, size)
        self.start_of_cell = np.repeat(np.arange(self.n), width)

    def cell_of(self, key: np.ndarray) -> np.ndarray:
        start = key // self.n
        return self.cells_before[start] + self.place_of_end[key - start * self.n]

    def key_of(self, cell: np.ndarray) -> np.ndarray:
        start = self.start_of_cell[cell]
        return start * self.n + self.targets[cell - self.cells_before[start]]

    def arcs_of(self, key: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each path among the arcs, and whether the path is that arc at its cost."""
        place = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
        return place, (self.arc_key[place] == key) & (self.arc_cost[place] == cost)


class _Solver:
    """Closes groups of bounded size, many small ones per grouped-map call.

    All rows can be part of a path. Groups are dealt out to buckets whose pairs stay near
    ``BUCKET_PAIRS`` and rows near ``BUCKET_ARCS``. A call runs the rounds of ``stepwise`` or
    ``doubling`` on arrays, for all its groups at once, with a cost per possible pair. Ids and groups may have any type: they are numbered in their order, never
    turned into other numbers.
    """

    def __init__(self, columns: PathColumns, about_source, about_target, closed_before, carried, method="stepwise", hop_rule="last"):
        if hop_rule not in ("last", "first", "middle"):
            raise ValueError(f"unknown hop rule {hop_rule!r}")
        self.columns, self.closed_before, self.carried = columns, list(closed_before), list(carried)
        self.method, self.hop_rule = method, hop_rule
        self.with_source = [columns.source, *about_source, *columns.groups]
        self.with_target = [columns.target, *about_target]

    def solved(self, rows: DataFrame, buckets: int, beside: DataFrame | None = None) -> DataFrame:
        marks = [name for c in self.closed_before for name in (c.group, c.stepped)]
        bucket = F.expr(f"pmod(hash({', '.join(self.columns.groups)}), {buckets})")
        wanted = rows.drop(*marks).schema
        # A partition per bucket, about: few bytes stand for much work, so none are put together.
        dealt = _with_beside(rows, beside).withColumn("_bucket", bucket).repartition(int(min(buckets, MOST_PARTITIONS)), "_bucket")
        return dealt.groupBy("_bucket").applyInArrow(lambda table: self._solve(table, wanted.names), wanted)

    def solved_in_place(self, rows: DataFrame, chained: str, most: int, pairs_of_row: str) -> DataFrame:
        """Groups of up to ``most`` rows closed in the partition they lie in, the other rows as they are and marked ``OPEN``.

        The window keeps rows that lie by their groups where they are, and gives others a place.
        """
        groups, wanted = ", ".join(self.columns.groups), rows.schema
        sized = rows.withColumn("_rows", F.expr(f"CAST(count(IF({chained}, 1, NULL)) OVER (PARTITION BY {groups}) AS DOUBLE)"))
        dealt = sized.selectExpr(
            *wanted.names, f"xxhash64({groups}) AS _group",
            f"IF({chained} AND _rows <= {most}, {pairs_of_row} / {float(BUCKET_PAIRS)}D + {1 / BUCKET_ARCS}D, NULL) AS _load",
        )
        return dealt.mapInArrow(lambda batches: self._solve_in_turn(batches, wanted.names), T.StructType([*wanted.fields, T.StructField(OPEN, T.BooleanType())]))

    def solved_by_source(self, rows: DataFrame, slices: DataFrame, total: int, beside: DataFrame | None = None) -> DataFrame:
        """The groups of ``slices``, each closed in that many calls: a call has the group's rows and its own sources, and what is beside of these."""
        c = self.columns
        marks = [name for before in self.closed_before for name in (before.group, before.stepped)]
        rows = rows.drop(*marks)
        wanted = rows.schema
        names = wanted.names

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in self._solve_sources(pa.Table.from_batches(batches), names):
                yield from block.to_batches()

        own = f"pmod(hash({c.source}), _slices)"
        to = "sequence(0, _slices - 1)" if beside is None else f"IF({BESIDE}, array({own}), sequence(0, _slices - 1))"
        dealt = _with_beside(rows, beside).join(slices, list(c.groups)).withColumn("_slice", F.expr(f"explode({to})"))
        dealt = dealt.withColumn("_own", F.expr(f"{own} = _slice")).drop("_slices")
        # As many partitions as slices: few bytes stand for much work, so none are put together.
        keys = [*c.groups, "_slice"]
        return dealt.repartition(int(min(total, MOST_SLICES)), *keys).groupBy(*keys).applyInArrow(solve, wanted)

    def _solve(self, table: pa.Table, names: list[str]) -> pa.Table:
        g = _Numbered(table, self.columns)
        n, arc_key, arc_cost = g.n, g.arc_key, g.arc_cost
        if not len(arc_key):
            return table.select(names)
        grouped, stepped = self._marks(table, g.arcs)
        chains = _Chains(arc_key, arc_cost, n)
        g.number_cells()
        direct = g.cell_of(arc_key)
        best = np.full(len(g.start_of_cell), np.inf)
        best[direct] = arc_cost
        known, paid = arc_key, arc_cost
        key, price, _ = chains.unmet(known, paid, grouped, grouped)
        while len(key):
            cell = _lowered(best, g.cell_of(key), price)
            key, price = g.key_of(cell), best[cell]
            if self.method == "doubling":
                # What improved meets all paths, and what was known meets what improved.
                older, then = known, paid
                cell = np.flatnonzero(best < np.inf)
                known, paid = g.key_of(cell), best[cell]
                before, after = _Chains(known, paid, n).extended(key, price), _Chains(key, price, n).extended(older, then)
                key, price, _ = (np.concatenate(both) for both in zip(before, after))
            else:
                key, price, _ = chains.extended(key, price)

        cell = np.flatnonzero(best < np.inf)
        known, best = g.key_of(cell), best[cell]
        place, unchanged = g.arcs_of(known, best)
        if self.hop_rule == "first":
            key, price, arc = _Chains(known, best, n).continued(arc_key, arc_cost)
            via = g.arc_hop[arc]
        elif self.hop_rule == "middle":
            key, price, middle = _Chains(known, best, n).extended(known, best)
            via = g.id_of[middle]
        else:
            left = [np.where(unchanged, mark[place], -1) for mark in grouped]
            key, price, middle = chains.unmet(known, best, left, stepped)
            via = g.id_of[middle]
        via = _lowest_hops(len(g.start_of_cell), len(g.ids), direct, arc_cost, g.arc_hop, g.cell_of(key), price, via)[cell]
        solved = self._rows(table, names, g, known, best, via, place, unchanged)
        if not len(g.beside):
            return solved
        stays = ~np.isin(g.beside_start * n + g.beside_end, known)
        return pa.concat_tables([solved, table.select(names).take(g.beside[stays])])

    def _solve_in_turn(self, batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        """The groups of a partition, one behind the other, as many in a call as make its load; rows without a load stay open."""
        held, load = [], 0.0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table["_load"].null_count:
                yield from _told(table.filter(table["_load"].is_null()).select(names), True)
                table = table.filter(table["_load"].is_valid())
            held.append(table)
            load += pc.sum(table["_load"]).as_py() or 0.0
            if load >= 1:
                # The last group may go on in the next batch.
                table = pa.concat_tables(held).combine_chunks()
                begin = 0
                for end in _cuts(table["_group"].to_numpy(), table["_load"].to_numpy()):
                    yield from _told(self._solve(table.slice(begin, end - begin), names), False)
                    begin = end
                held = [table.slice(begin)]
                load = pc.sum(held[0]["_load"]).as_py()
        if load:
            yield from _told(self._solve(pa.concat_tables(held).combine_chunks(), names), False)

    def _solve_sources(self, table: pa.Table, names: list[str]) -> Iterator[pa.Table]:
        """The closed paths from the slice's own sources, a block of sources at a time.

        What an earlier closing has met is met again: for whole blocks that is less work than telling it apart.
        """
        g = _Numbered(table, self.columns)
        of_arcs = table["_own"].to_numpy()
        if len(g.beside):
            of_arcs = of_arcs[~table[BESIDE].to_numpy()]
        sources, stays = np.unique(g.start[of_arcs]), np.ones(len(g.beside), bool)
        if not len(sources):
            yield table.select(names).take(g.beside)
            return
        at_once = max(1, SOURCE_CELLS // g.n)
        sweeps = _Sweeps(g, min(at_once, len(sources)))
        for begin in range(0, len(sources), at_once):
            block = sources[begin : begin + at_once]
            best = sweeps.closed(block)
            via = sweeps.hops(best, block)
            stays &= ~sweeps.reached(best, block, g.beside_start, g.beside_end)
            together = max(1, RETURNED_ROWS // g.n)
            for first in range(0, len(block), together):
                some = slice(first, first + together)
                known, costs, hops, place = sweeps.paths(best[:, some], via[:, some], block[some])
                yield self._rows(table, names, g, known, costs, hops, np.maximum(place, 0), place >= 0)
        if stays.any():
            yield table.select(names).take(g.beside[stays])

    def _rows(self, table, names, g, known, best, via, place, unchanged) -> pa.Table:
        c, n = self.columns, g.n
        solved = {name: table[name].take(g.row_of_start[known // n]) for name in self.with_source}
        solved |= {name: table[name].take(g.row_of_end[known % n]) for name in self.with_target}
        solved |= {name: table[name].take(pa.array(g.arcs[place], mask=~unchanged)) for name in self.carried}
        solved[c.cost] = pa.array(best)
        solved[c.hop] = g.ids.take(pa.array(via))
        return pa.table({name: solved[name].cast(table.schema.field(name).type) for name in names})

    def _marks(self, table: pa.Table, arcs: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The arcs' marks as numbers, -1 for none."""
        grouped, stepped = [], []
        for c in self.closed_before:
            both = pa.concat_arrays([table[name].combine_chunks() for name in (c.group, c.stepped)])
            codes = np.where(both.is_null().to_numpy(zero_copy_only=False), -1, _codes(both)[0]).reshape(2, -1)
            grouped.append(codes[0][arcs])
            stepped.append(codes[1][arcs])
        return grouped, stepped


class _Sweeps:
    """The arcs of one group, laid out so that the paths from many sources are closed at once.

    A block has a row per node and a column per source. The nodes are ordered along the arcs as far as
    cycles allow and cut into batches between which arcs mostly lead on: one sweep over the batches then
    carries a cost through all of them, and further sweeps only look at batches that an arc back has reached.
    A batch's arcs in are a matrix, filled up with a row that no path reaches.
    """

    def __init__(self, g: _Numbered, at_once: int):
        self.g, self.n = g, g.n
        start, end = g.arc_key // g.n, g.arc_key % g.n
        order, level = _along(start, end, g.n)
        arcs_in = np.bincount(end, minlength=g.n)
        # Nodes with about as many arcs in share a matrix.
        width = np.ceil(np.log2(np.maximum(arcs_in, 1))).astype(np.int64)
        place = np.empty(g.n, np.int64)
        place[order] = np.arange(g.n)
        self.node_at = np.lexsort((place, width, level))
        self.row_of = np.empty(g.n, np.int64)
        self.row_of[self.node_at] = np.arange(g.n)
        self.start, self.end = self.row_of[start], self.row_of[end]
        kind = (level * 64 + width)[self.node_at]
        into = np.lexsort((start, self.end))
        upto = np.append(0, np.cumsum(arcs_in[self.node_at]))
        self.batches, batch_of = [], np.empty(g.n, np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, kind[1:] != kind[:-1])), g.n)
        for low, high in zip(cuts[:-1], cuts[1:]):
            slots = int(arcs_in[self.node_at[low:high]].max())
            if not slots:
                batch_of[low:high] = -1
                continue
            nodes = max(1, SWEEP_CHAINS // (slots * at_once))
            for first in range(low, high, nodes):
                last = min(first + nodes, high)
                batch_of[first:last] = len(self.batches)
                begins, ends = upto[first:last, None], upto[first + 1 : last + 1, None]
                slot = begins + np.arange(slots)
                arc = into[np.minimum(slot, ends - 1)]
                filled = slot < ends
                before = np.where(filled, self.start[arc], g.n)
                self.batches.append((first, last, before, np.where(filled, g.arc_cost[arc], 0.0)[:, :, None]))
        self.batch_of = batch_of
        leads = np.unique(np.maximum(batch_of[self.start], -1) * len(self.batches) + batch_of[self.end]) if len(start) else np.zeros(0, np.int64)
        self.leads_to: list[list[int]] = [[] for _ in self.batches]
        for key in leads[leads >= 0].tolist():
            self.leads_to[key // len(self.batches)].append(key % len(self.batches))

    def _chains(self, best: np.ndarray, batch: int) -> np.ndarray:
        """The cost of every path to a batch's nodes by each of their arcs in."""
        _, _, before, cost = self.batches[batch]
        return best[before] + cost

    def _own(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sources' column by row, -1 for other rows; the arcs that begin in a source, and their columns."""
        column = np.full(self.n + 1, -1)
        column[self.row_of[block]] = np.arange(len(block))
        arcs = np.flatnonzero(column[self.start] >= 0)
        return column, arcs, column[self.start[arcs]]

    def closed(self, block: np.ndarray) -> np.ndarray:
        """The lowest cost from each source of the block to each node; infinite where there is no path and at the source itself."""
        column, own, own_column = self._own(block)
        best = np.full((self.n + 1, len(block)), np.inf)
        best[self.end[own], own_column] = self.g.arc_cost[own]
        to_look_at = bytearray(len(self.batches))
        for reached in np.unique(self.batch_of[self.end[own]]).tolist():
            for batch in self.leads_to[reached]:
                to_look_at[batch] = 1
        has_source = np.zeros(len(self.batches), bool)
        of_sources = self.batch_of[self.row_of[block]]
        has_source[of_sources[of_sources >= 0]] = True
        while (batch := to_look_at.find(1)) >= 0:
            while batch >= 0:
                to_look_at[batch] = 0
                first, last, _, _ = self.batches[batch]
                price = self._chains(best, batch).min(axis=1)
                if has_source[batch]:
                    at = np.flatnonzero(column[first:last] >= 0)
                    price[at, column[first:last][at]] = np.inf
                rows = best[first:last]
                if (price < rows).any():
                    np.minimum(price, rows, out=rows)
                    for after in self.leads_to[batch]:
                        to_look_at[after] = 1
                batch = to_look_at.find(1, batch)
        return best

    def hops(self, best: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The number of the lowest hop among the cheapest of each pair's arc and the paths made for it."""
        none = len(self.g.ids)
        via = np.full(best.shape, none, np.int32)
        id_of_row = np.append(self.g.id_of[self.node_at], none).astype(np.int32)
        for batch, (first, last, before, _) in enumerate(self.batches):
            cheapest_ones = self._chains(best, batch) == best[first:last, None]
            via[first:last] = np.where(cheapest_ones, id_of_row[before][:, :, None], np.int32(none)).min(axis=1)
        _, own, column = self._own(block)
        kept = self.g.arc_cost[own] == best[self.end[own], column]
        own, column = own[kept], column[kept]
        # One arc per pair: no cell occurs twice.
        via[self.end[own], column] = np.minimum(via[self.end[own], column], self.g.arc_hop[own])
        return via

    def reached(self, best: np.ndarray, block: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether there is a path for each pair of nodes; False for pairs that do not begin in the block."""
        column = np.full(self.n, -1)
        column[block] = np.arange(len(block))
        column = column[start]
        return (column >= 0) & (best[self.row_of[end], column] < np.inf)

    def paths(self, best: np.ndarray, via: np.ndarray, block: np.ndarray):
        """Keys, costs, hops of the paths from these sources, and the place of those that are an arc at its cost, else -1."""
        by_source = np.ascontiguousarray(best[: self.n].T).ravel()
        found = np.flatnonzero(by_source < np.inf)
        _, own, column = self._own(block)
        arc = np.full(len(by_source), -1)
        cell = column * self.n + self.end[own]
        kept = by_source[cell] == self.g.arc_cost[own]
        arc[cell[kept]] = own[kept]
        key = (block[:, None] * self.n + self.node_at).ravel()[found]
        return key, by_source[found], via[: self.n].T.ravel()[found], arc[found]


def _along(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the nodes in which few arcs lead back, and levels: every arc that leads on leads to a later level.

    A node is next when all its arcs in come from nodes that were taken; if there is none, the one that has been
    reached for the longest time is taken. Nothing depends on how the nodes are numbered but which one is first.
    """
    waits_for = np.bincount(end, minlength=n).tolist()
    begins = np.append(0, np.cumsum(np.bincount(start, minlength=n))).tolist()
    # The arcs come by their start.
    ends = end.tolist()
    level, taken, order = [0] * n, bytearray(n), []
    ready, reached = [node for node in range(n) if not waits_for[node]], deque()
    others = iter(range(n))
    while len(order) < n:
        if ready:
            node = ready.pop()
        elif reached:
            node = reached.popleft()
        else:
            node = next(others)
        if taken[node]:
            continue
        taken[node] = 1
        order.append(node)
        after = level[node] + 1
        for other in ends[begins[node] : begins[node + 1]]:
            if not taken[other]:
                if level[other] < after:
                    level[other] = after
                waits_for[other] -= 1
                if waits_for[other]:
                    reached.append(other)
                else:
                    ready.append(other)
    return np.array(order, np.int64), np.array(level, np.int64)


class _Chains:
    """Paths continued by arcs, on arrays; a key is the start times the number of nodes, plus the end."""

    def __init__(self, arc_key: np.ndarray, arc_cost: np.ndarray, nodes: int):
        self.n, self.key, self.cost = nodes, arc_key, arc_cost
        self.begins = self._begins(np.arange(len(arc_key)))

    def _begins(self, arcs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key[arcs] // self.n, np.arange(self.n + 1))

    def _pairs(self, key, arcs=None):
        """Positions of paths and arcs that meet and do not return to the path's start."""
        begins = self.begins if arcs is None else self._begins(arcs)
        middle = key % self.n
        degree = begins[middle + 1] - begins[middle]
        path = np.repeat(np.arange(len(key)), degree)
        arc = np.arange(len(path)) - np.repeat(np.cumsum(degree) - degree, degree) + begins[middle[path]]
        arc = arc if arcs is None else arcs[arc]
        ok = key[path] // self.n != self.key[arc] % self.n
        return path[ok], arc[ok]

    def _made(self, key, price, path, arc):
        return key[path] // self.n * self.n + self.key[arc] % self.n, price[path] + self.cost[arc], key[path] % self.n

    def extended(self, key, price):
        """Every path continued by every arc: key, cost and meeting node."""
        return self._made(key, price, *self._pairs(key))

    def continued(self, key, price):
        """As ``extended``, with the place of the path that each one begins with."""
        path, arc = self._pairs(key)
        key, price, _ = self._made(key, price, path, arc)
        return key, price, path

    def unmet(self, key, price, left, right):
        """As ``extended``, without the pairs that an earlier closing has met."""
        if not left:
            return self.extended(key, price)
        new_path, new_arc = np.max(left, axis=0) < 0, np.max(right, axis=0) < 0
        low, high = (np.full((len(left), self.n), value) for value in (np.iinfo(np.int64).max, -1))
        for i, (path_marks, arc_marks) in enumerate(zip(left, right)):
            for nodes, marks in ((key[~new_path] % self.n, path_marks[~new_path]), (self.key[~new_arc] // self.n, arc_marks[~new_arc])):
                np.minimum.at(low[i], nodes, marks)
                np.maximum.at(high[i], nodes, marks)
        mixed = ~((low == high) & (low >= 0)).any(axis=0)
        parts = []
        for paths, arcs in (
            (new_path, None),
            (~new_path, np.flatnonzero(new_arc)),
            (~new_path & mixed[key % self.n], np.flatnonzero(~new_arc & mixed[self.key // self.n])),
        ):
            paths = np.flatnonzero(paths)
            path, arc = self._pairs(key[paths], arcs)
            parts.append((paths[path], arc))
        path, arc = parts[2]
        met = np.zeros(len(path), bool)
        for path_marks, arc_marks in zip(left, right):
            met |= (path_marks[path] == arc_marks[arc]) & (path_marks[path] >= 0)
        parts[2] = path[~met], arc[~met]
        return self._made(key, price, *(np.concatenate(x) for x in zip(*parts)))
