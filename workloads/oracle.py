"""The same networks, rules and passes as plain SQL.

Loops become a fixed number of unrolled rounds; closures double their reach
per round, so ``rounds`` of them cover paths of 2**rounds arcs. ``LINE_ROUNDS``
cover orders of up to 33 lines; the tables have at most 17 at any scale.
"""

from __future__ import annotations

LINE_ROUNDS = 5

# -- networks -----------------------------------------------------------------

TRADE = """
trade AS MATERIALIZED (
  SELECT CAST(c_nationkey AS BIGINT) AS incoming_edge, CAST(s_nationkey AS BIGINT) AS outgoing_edge,
         CAST(s_nationkey AS BIGINT) AS via_edge, CAST(count(*) % 50 + 1 AS DOUBLE) AS cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey
  GROUP BY c_nationkey, s_nationkey)"""

CONSECUTIVE = """
order_lines AS MATERIALIZED (
  SELECT l_orderkey, l_quantity AS quantity, l_returnflag, l_partkey AS part,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
           l_extendedprice, l_returnflag) AS place,
         count(*) OVER (PARTITION BY l_orderkey) AS places, l_orderkey * 1000 + place AS line
  FROM lineitem),
consecutive AS MATERIALIZED (
  SELECT a.l_orderkey, a.l_returnflag, a.quantity, a.part, a.line, b.line AS next_line, b.part AS next_part,
         CASE WHEN b.place > a.place THEN b.place - a.place ELSE 1 END AS gap
  FROM order_lines a JOIN order_lines b ON a.l_orderkey = b.l_orderkey
   AND (b.place - a.place IN (1, 2) OR (a.place = a.places AND b.place = 1 AND a.places > 1)))"""

LINES = CONSECUTIVE + """,
lines AS MATERIALIZED (
  SELECT line AS incoming_edge, next_line AS outgoing_edge, next_line AS via_edge,
         quantity * gap AS cost, l_orderkey FROM consecutive)"""

REGIONS = CONSECUTIVE + """,
regions AS MATERIALIZED (
  SELECT line AS src, next_line AS dst, quantity * gap AS cost, next_line AS next_node,
         l_orderkey, l_returnflag FROM consecutive)"""

VISITS = """
visit_events AS (
  SELECT 'visitor ' || user_id::VARCHAR AS visitor, event_id % 8 AS lane, ts, event_id,
         event_type || ' ' || props || ' ' || user_id::VARCHAR AS here, (floor(value) + 1)::DOUBLE AS cost FROM events),
visits AS MATERIALIZED (
  SELECT here AS src, following AS dst, cost, following AS next_node, visitor, lane
  FROM (SELECT *, lead(here) OVER (PARTITION BY visitor, lane ORDER BY ts, event_id) AS following FROM visit_events)
  WHERE here IS NOT NULL AND following IS NOT NULL AND visitor IS NOT NULL AND lane IS NOT NULL)"""

PARTS = CONSECUTIVE + """,
part_edges AS MATERIALIZED (
  SELECT part AS src, next_part AS dst FROM consecutive WHERE gap = 1 AND part <> next_part)"""

SUPPLIERS = """
numbered AS (
  SELECT s_suppkey AS id, s_suppkey // 4 AS u, s_suppkey % 4 AS kind,
         (SELECT max(s_suppkey) // 4 + 1 FROM supplier) AS nodes FROM supplier),
supplier_nodes AS MATERIALIZED (
  SELECT id, u, (CASE kind WHEN 0 THEN u // 5 * 5 + (u + 1) % 5 WHEN 1 THEN u // 5 * 5 + (u + 3) % 5
                 WHEN 2 THEN u + 5 ELSE u + 11 END) % nodes AS v FROM numbered),
supplier_inputs AS MATERIALIZED (
  SELECT id,
    (1::BIGINT << 59) | (2::BIGINT << 52) | ((u // 25 % 122) << 45) | ((u // 5 % 5) << 42) | ((u % 5) << 39)
      | ((1::BIGINT << 39) - 1) AS incoming_cell,
    (1::BIGINT << 59) | (2::BIGINT << 52) | ((v // 25 % 122) << 45) | ((v // 5 % 5) << 42) | ((v % 5) << 39)
      | ((1::BIGINT << 39) - 1) AS outgoing_cell,
    CAST(CASE WHEN u // 25 % 122 <> v // 25 % 122 THEN -1 WHEN u // 5 % 5 <> v // 5 % 5 THEN 0
         WHEN u % 5 <> v % 5 THEN 1 ELSE 2 END AS INTEGER) AS lca_res,
    length, CASE WHEN id % 17 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS maxspeed
  FROM supplier_nodes LEFT JOIN
    (SELECT l_suppkey, sum(l_quantity) AS length FROM lineitem GROUP BY l_suppkey) ON id = l_suppkey),
supplier_edges AS MATERIALIZED (
  SELECT *, CASE WHEN maxspeed <= 0 THEN 'inf'::DOUBLE ELSE length / maxspeed END AS cost FROM supplier_inputs),
supplier_arcs AS (
  SELECT a.id AS incoming_edge, b.id AS outgoing_edge
  FROM supplier_nodes a JOIN supplier_nodes b ON a.v = b.u AND a.id <> b.id),
supplier_shortcuts AS MATERIALIZED (
  SELECT incoming_edge, outgoing_edge, outgoing_edge AS via_edge, cost
  FROM supplier_arcs LEFT JOIN supplier_edges ON id = incoming_edge)"""


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(cte.strip() for cte in ctes if cte) + "\n" + select.strip()


# -- cells --------------------------------------------------------------------

def resolution(cell: str) -> str:
    return f"(CASE WHEN {cell} = 0 THEN -1 ELSE ({cell} >> 52) & 15 END)"


def ancestor(cell: str, res) -> str:
    return (
        f"(CASE WHEN {cell} = 0 OR {res} < 0 THEN 0 WHEN {res} >= (({cell} >> 52) & 15) THEN {cell} "
        f"ELSE (({cell} & ~(15::BIGINT << 52)) | (({res})::BIGINT << 52)) "
        f"| ((1::BIGINT << (45 - 3 * CAST(greatest({res}, 0) AS INTEGER))) - 1) END)"
    )


PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def in_deleted_part(cell: str) -> str:
    """Whether a resolution-2 cell lies in the part that its pentagon lacks."""
    return (f"((({cell} >> 45) & 127) IN {PENTAGONS} AND ((({cell} >> 42) & 7) = 1 "
            f"OR ((({cell} >> 42) & 7) = 0 AND (({cell} >> 39) & 7) = 1)))")


def common_ancestor(a: str, b: str) -> str:
    """Finest resolution first; only levels neither cell is coarser than count."""
    cases = " ".join(
        f"WHEN ({a} >> 52) & 15 >= {r} AND ({b} >> 52) & 15 >= {r} AND {ancestor(a, r)} = {ancestor(b, r)} "
        f"THEN {ancestor(a, r)}"
        for r in range(15, -1, -1)
    )
    return f"(CASE WHEN {a} = 0 OR {b} = 0 THEN 0 {cases} ELSE 0 END)"


PLACES = f"""
pair_places AS MATERIALIZED (
  SELECT i.id AS incoming_edge, o.id AS outgoing_edge, greatest(i.lca_res, o.lca_res) AS lca_res,
         i.lca_res AS source_res, o.lca_res AS target_res,
         {common_ancestor("i.incoming_cell", "o.outgoing_cell")} AS via_cell
  FROM supplier_edges i, supplier_edges o)"""


def placed(name: str, table: str) -> str:
    """A shortcut table with its place in the hierarchy."""
    return f"""
{name} AS MATERIALIZED (
  SELECT t.incoming_edge, t.outgoing_edge, via_edge, cost, p.lca_res, p.via_cell,
         CAST({resolution("p.via_cell")} AS INTEGER) AS via_res
  FROM {table} t LEFT JOIN pair_places p USING (incoming_edge, outgoing_edge))"""


# -- closures -----------------------------------------------------------------

def closure(
    name: str, arcs: str, rounds: int, groups: tuple[str, ...] = (), hop_rule: str = "last",
    source: str = "incoming_edge", target: str = "outgoing_edge", hop: str = "via_edge",
) -> str:
    """CTEs that end in ``name``: the closed arcs with the lowest hop of each pair."""
    g = "".join(f"{c}, " for c in groups)
    lg = "".join(f"l.{c}, " for c in groups)
    same = "".join(f" AND l.{c} = r.{c}" for c in groups)
    keys = f"{g}{source}, {target}"
    pair = f"{lg}l.{source}, r.{target}"
    meet = f"ON l.{target} = r.{source}{same} AND l.{source} <> r.{target}"
    live = f"{arcs} WHERE cost < 'inf'::DOUBLE AND {source} <> {target}"
    ctes = [f"{name}_0 AS MATERIALIZED (SELECT {keys}, min(cost) AS cost FROM {live} GROUP BY {keys})"]
    for i in range(rounds):
        ctes.append(
            f"{name}_{i + 1} AS MATERIALIZED (SELECT {keys}, min(cost) AS cost FROM (SELECT {keys}, cost FROM {name}_{i} "
            f"UNION ALL SELECT {pair}, l.cost + r.cost FROM {name}_{i} l JOIN {name}_{i} r {meet}) GROUP BY {keys})"
        )
    best = f"{name}_{rounds}"
    left, right, composed = {
        "last": (best, f"(SELECT * FROM {live})", f"r.{source}"),
        "first": (f"(SELECT * FROM {live})", best, f"l.{hop}"),
        "middle": (best, best, f"r.{source}"),
    }[hop_rule]
    ctes.append(
        f"{name} AS MATERIALIZED (SELECT {', '.join('c.' + k for k in keys.split(', '))}, c.cost, min(c.{hop}) AS {hop} FROM ("
        f"SELECT {keys}, cost, {hop} FROM {live} UNION ALL "
        f"SELECT {pair}, l.cost + r.cost, {composed} FROM {left} l JOIN {right} r {meet}) c "
        f"JOIN {best} b ON {' AND '.join(f'c.{k} = b.{k}' for k in keys.split(', '))} AND c.cost = b.cost "
        f"GROUP BY {', '.join('c.' + k for k in keys.split(', '))}, c.cost)"
    )
    return ",\n".join(ctes)


def improved_once(name: str, paths: str, groups: tuple[str, ...] = ()) -> str:
    """One doubling round: all two-part chains and the given paths, cheapest kept."""
    g, lg = "".join(f"{c}, " for c in groups), "".join(f"l.{c}, " for c in groups)
    same = "".join(f" AND l.{c} = r.{c}" for c in groups)
    return f"""
{name}_chains AS MATERIALIZED (
  SELECT l.incoming_edge, r.outgoing_edge, {lg}l.cost + r.cost AS cost, l.outgoing_edge AS via_edge
  FROM {paths} l JOIN {paths} r ON l.outgoing_edge = r.incoming_edge{same}
  WHERE l.incoming_edge <> r.outgoing_edge),
{name}_all AS MATERIALIZED (
  SELECT incoming_edge, outgoing_edge, {g}cost, via_edge FROM {paths}
  UNION ALL SELECT incoming_edge, outgoing_edge, {g}cost, via_edge FROM {name}_chains),
{name} AS MATERIALIZED (
  SELECT incoming_edge, outgoing_edge, {g}cost, via_edge FROM (SELECT *, row_number() OVER (
    PARTITION BY {g}incoming_edge, outgoing_edge ORDER BY cost, via_edge) AS rank FROM {name}_all)
  WHERE rank = 1)"""


# -- passes over the supplier network -------------------------------------------

PAIR = "incoming_edge, outgoing_edge, via_edge, cost"


def level_condition(res: int) -> str:
    return "lca_res <= 0" if res < 0 else f"lca_res <= {res} AND via_res >= {res}"


def step(name: str, before: str, res: int, rounds: int) -> str:
    """Place, select one level, close it per cell and replace equal pairs in ``before``."""
    return ",\n".join([
        placed(f"{name}_placed", before).strip(),
        f"{name}_level AS MATERIALIZED (SELECT {PAIR}, {ancestor('via_cell', res)} AS current_cell "
        f"FROM {name}_placed WHERE {level_condition(res)})",
        closure(f"{name}_closed", f"{name}_level", rounds, ("current_cell",)),
        f"{name} AS MATERIALIZED (SELECT {PAIR} FROM {before} WHERE (incoming_edge, outgoing_edge) NOT IN "
        f"(SELECT (incoming_edge, outgoing_edge) FROM {name}_closed) UNION ALL SELECT {PAIR} FROM {name}_closed)",
    ])


# Levels that can hold rows: cells are of resolution 2. Finer ones are empty.
DOWN, GLOBAL, UP = [2, 1, 0], [-1], [0, 1, 2]
STEP_ROUNDS = 5


def passes(levels: list[int], start: str = "supplier_shortcuts") -> tuple[str, list[tuple[str, int]]]:
    """The steps in order; returns the CTEs and the (table, level) of each step."""
    steps, before = [], start
    ctes = []
    for number, res in enumerate(levels):
        name = f"s{number}"
        ctes.append(step(name, before, res, STEP_ROUNDS))
        steps.append((name, res))
        before = name
    return ",\n".join(ctes), steps


def cumulative(name: str, table: str, column: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT {column} AS value, row_number() OVER (ORDER BY {column}) AS place, count(*) OVER () AS total
  FROM {table} WHERE {column} IS NOT NULL)"""


def percentile(name: str, share: float) -> str:
    return f"(SELECT min(value) FROM {name} WHERE place >= ceil({share}::DOUBLE * total))"
