"""Near duplicates: an n-gram Jaccard join by MinHash bands, verified on full n-gram sets.

1. A document's set holds the hashes of its runs of five words (of all its words, if it
   has fewer). Documents with equal sets form a *class*; only classes go on.
2. Bands and rows of MinHash values are chosen so that a pair at the wanted similarity
   shares a band with probability ``RECALL``. Bands are shuffled by their hash; bands that
   occur once go no further.
3. Inside a bucket, members whose signatures agree nearly as often as those of a wanted
   pair would are tied together by a tree, not by all their pairs. Components of these
   ties are *cells*: the classes of a wanted pair that share a band lie in one cell.
4. Inside a cell all pairs are verified on their full sets, block against block, by
   counting common elements with matrix products. What leaves a task is one row per class:
   how many documents it is linked to, and the lowest class it hangs together with.

Buckets and cells beyond a block are dealt out to pairs of blocks, so no task holds a
large group and no row stands for a pair. Nothing is capped: the work inside a group of
different near copies grows with its pairs, as the exact number of links asks for.

A null or empty text, or one without any word (only ASCII marks, such as ``!!!``), has the
empty set; all such documents are one class, and one of them is kept. Ids may repeat
and may be null; every row is counted. A group's ``class_id`` is its smallest id (null
only if all its ids are), ties inside a class are settled by the texts' hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.durable import durable, tidy
from roadloom.llm.rows import by_place, release_memory
from roadloom.llm.shipping import ship_package
from roadloom.llm.words import WordBlock, hash_runs, mix, word_blocks
from roadloom.operators.graph import connected_components

SHINGLE_WORDS = 5
SIMILARITY = Fraction(4, 5)
RECALL, MOST_HASHES = 0.9999, 128
#: Signatures may agree less than the similarity by so many standard deviations.
DEVIATIONS = 5
#: Members per block of a bucket; classes and set elements per block of a cell.
BUCKET_BLOCK, CELL_BLOCK, CELL_BLOCK_ELEMENTS = 1_000, 500, 1_000_000
#: Columns of a matrix product.
COLUMNS = 2_048


def bands_and_rows(similarity: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The strictest bands (most rows) that reach the recall with so many hashes."""
    best = None
    for rows in range(1, most + 1):
        missed = math.log1p(-(similarity**rows)) if similarity < 1 else -math.inf
        needed = math.log(1 - recall) / missed if missed else math.inf
        if needed * rows <= most and math.ceil(needed) * rows <= most:
            best = max(1, math.ceil(needed)), rows
    if best is None:
        raise ValueError("no banding reaches this recall; allow more hashes")
    return best


def shingle_sets(block: WordBlock, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, first = block.windows(words)
    cuts = np.searchsorted(first, block.offsets)
    sets = []
    for i in range(block.texts):
        if 0 < block.counts[i] < words:
            sets.append(hash_runs(block.hashes[block.offsets[i] : block.offsets[i + 1]], int(block.counts[i])))
        else:
            sets.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
    return sets


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.arange(1, n + 1, dtype=np.uint64)
    return mix(numbers), mix(numbers + np.uint64(1 << 40)) | np.uint64(1)


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``n`` MinHash values of each set, none of which is empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), n), np.uint64)
    turned = np.empty_like(flat)
    for i, (flip, factor) in enumerate(zip(*_seeds(n))):
        np.bitwise_xor(flat, flip, out=turned)
        np.multiply(turned, factor, out=turned)
        out[:, i] = np.minimum.reduceat(turned, starts)
    return out


def described(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """A row per document: its set's key and size, its bands' hashes and its signature, one byte per hash."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, sizes, all_bands, signatures = [], [], [], []
            for block in word_blocks(batch.column("text")):
                sets = shingle_sets(block)
                full = [i for i, s in enumerate(sets) if len(s)]
                values = minhashes([sets[i] for i in full], bands * rows) if full else np.zeros((0, bands * rows), np.uint64)
                hashed = np.zeros((len(full), bands), np.uint64)
                for row in range(rows):
                    hashed = mix(hashed * np.uint64(3) + values[:, row::rows])
                hashed = mix(hashed + np.arange(bands, dtype=np.uint64)).view(np.int64)
                low = ((values >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)
                at = dict(zip(full, range(len(full))))
                for i, s in enumerate(sets):
                    keys.append(np.array([mix(s).sum(), mix(s + np.uint64(7)).sum()], np.uint64).tobytes())
                    sizes.append(len(s))
                    all_bands.append(hashed[at[i]] if i in at else [])
                    signatures.append(low[at[i]].tobytes() if i in at else b"")
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                pa.array(all_bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary()),
            ], names=list("abcdef"))

    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, text_hash BIGINT, key BINARY, size BIGINT, bands ARRAY<BIGINT>, signature BINARY")


def in_groups(rows: DataFrame, key: str, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on tables that hold whole groups of equal ``key`` (a long), and where their groups begin.

    Many small groups make up one table; of a group larger than a batch, the whole is held.
    """

    def whole(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(key).to_numpy()
            if not len(keys):
                continue
            changes = np.flatnonzero(np.diff(keys)) + 1
            if held and held[-1].column(key)[-1].as_py() != keys[0]:
                changes = np.append([0], changes)
            if len(changes):
                yield pa.Table.from_batches([*held, batch.slice(0, changes[-1])])
                held = []
            held.append(batch.slice(changes[-1]) if len(changes) else batch)
        if held:
            yield pa.Table.from_batches(held)
        release_memory()

    def run(batches):
        for table in whole(batches):
            table = table.combine_chunks()
            keys = table.column(key).to_numpy()
            yield work(table, np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]))

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def by_block_pairs(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks that its own takes part in: ``cell`` names the pair, ``side`` its own side.

    ``blocks`` is the number of blocks of the row's group. ``crossing`` tells that the pair's
    blocks are two, also where only one of them has rows: only pairs across sides count there.
    A pair of a block with itself has side 0 only.
    """
    return rows.withColumn("_block", F.expr(f"pmod(xxhash64(key), {blocks})")).withColumn(
        "_other", F.explode(F.expr(f"sequence(CAST(0 AS BIGINT), {blocks} - 1)"))
    ).withColumn("side", F.expr("CAST(_block > _other AS INT)")).withColumn("crossing", F.expr("_block <> _other")).withColumn(
        "cell", F.xxhash64(group, F.least("_block", "_other"), F.greatest("_block", "_other"))
    ).drop("_block", "_other")


def trees(agree: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray, crossing: bool) -> np.ndarray:
    """The lowest member that each member hangs together with; if ``crossing``, only pairs across sides count."""
    n = len(side)
    root, free = np.arange(n), np.arange(1, n)
    for seed in range(n):
        if root[seed] != seed:
            continue
        reached = [seed]
        free = free[free != seed]
        while reached and len(free):
            one = reached.pop()
            near = agree(one, free)
            if crossing:
                near &= side[free] != side[one]
            root[free[near]] = seed
            reached += free[near].tolist()
            free = free[~near]
    return root


def ties(members: DataFrame, hashes: int, similarity: float) -> DataFrame:
    """Edges ``(src, dst)`` that connect members of a bucket with like signatures."""
    least = hashes * (similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / hashes))

    def work(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        keys = np.array(table.column("key").to_pylist(), dtype=object)
        side, crossing = table.column("side").to_numpy(), table.column("crossing").to_numpy()
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(keys), hashes)
        sizes = np.diff(edges)
        found = []
        two = edges[:-1][sizes == 2]
        if len(two):
            alike = (signatures[two] == signatures[two + 1]).sum(axis=1) >= least
            alike &= (side[two] != side[two + 1]) | ~crossing[two]
            found += [(two[alike], two[alike] + 1)]
        for a, b in zip(edges[:-1][sizes > 2], edges[1:][sizes > 2]):
            own = signatures[a:b]
            root = trees(lambda one, others: (own[others] == own[one]).sum(axis=1) >= least, side[a:b], crossing[a])
            tied = np.flatnonzero(root != np.arange(b - a))
            found.append((root[tied] + a, tied + a))
        left = np.concatenate([x for x, _ in found] or [np.zeros(0, int)])
        right = np.concatenate([y for _, y in found] or [np.zeros(0, int)])
        return pa.RecordBatch.from_arrays([pa.array(keys[left], pa.binary()), pa.array(keys[right], pa.binary())], names=["src", "dst"])

    dealt = by_block_pairs(members, "bucket", f"CAST(ceil(members / {BUCKET_BLOCK}) AS BIGINT)")
    return in_groups(dealt.select("cell", "side", "crossing", "key", "signature"), "cell", work, "src BINARY, dst BINARY")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        counts += held @ held.T
    return counts.astype(np.int64)


def verified(sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Per class and pair of blocks: the documents it is linked to, and the class it hangs together with."""
    p, q = similarity.numerator, similarity.denominator

    def work(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        keys = np.array(table.column("key").to_pylist(), dtype=object)
        elements = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
        copies, side, crossing = (table.column(name).to_numpy() for name in ("copies", "side", "crossing"))
        links, root = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a < 2:
                continue
            own = elements[a:b]
            sizes = np.array([len(s) for s in own])
            # common / (x + y - common) >= p / q, in whole numbers
            linked = common_counts(own) * (p + q) >= p * (sizes[:, None] + sizes[None, :])
            np.fill_diagonal(linked, False)
            if crossing[a]:
                linked &= side[a:b][:, None] != side[a:b][None, :]
            links[a:b] = linked @ copies[a:b]
            root[a:b] = trees(lambda one, others: linked[one, others], side[a:b], crossing[a]) + a
        return pa.RecordBatch.from_arrays([
            pa.array(keys, pa.binary()), pa.array(links, pa.int64()), pa.array(keys[root], pa.binary()), table.column("blocks").combine_chunks(),
        ], names=list("abcd"))

    dealt = by_block_pairs(sets, "component", "blocks").select("cell", "side", "crossing", "key", "copies", "blocks", "elements")
    return in_groups(dealt, "cell", work, "key BINARY, links BIGINT, root BINARY, blocks BIGINT")


@tidy("links")
def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: Fraction = SIMILARITY) -> DataFrame:
    """A row per document: ``class_id`` of its group, ``copy_of`` (the class's first id), ``n_links``, ``kept``.

    ``n_links`` counts the other documents of at least the similarity; ``kept`` marks one row
    per group (more only where a row is there more than once).
    """
    bands, rows = bands_and_rows(float(similarity))
    found = durable(described(docs, doc_id, text, bands, rows), "described")
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    classes = durable(found.groupBy("key").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
        F.first("bands").alias("bands"), F.first("signature").alias("signature"),
    ), "classes")
    banded = classes.select("key", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = banded.join(buckets, "bucket").join(classes.select("key", "signature"), "key")
    edges = durable(ties(members, bands * rows, float(similarity)).distinct(), "ties")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    cells = connected_components(ends, edges).select(F.col("id").alias("key"), "component")
    checked = durable(_checked(docs, doc_id, text, classes, cells, similarity), "verified")
    per_class = _components(checked)
    groups = classes.select("key", "first", "copies").join(per_class, "key", "left").withColumn("component", F.coalesce("root", "key"))
    # The first document of each group; groups differ in size, sums are made before the shuffle.
    leaders = groups.groupBy("component").agg(F.min("first").alias("leader"))
    named = groups.join(leaders, "component").select(
        "key", F.col("leader.doc_id").alias("class_id"), F.col("first.doc_id").alias("copy_of"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "leader",
    )
    kept = F.col("doc_id").eqNullSafe(F.col("leader.doc_id")) & (F.col("text_hash") == F.col("leader.text_hash"))
    return found.select("doc_id", "text_hash", "key").join(named, "key").select("doc_id", "text_hash", "class_id", "copy_of", "n_links", kept.alias("kept"))


def _checked(docs, doc_id, text, classes, cells, similarity) -> DataFrame:
    """The verified links of the classes in cells, whose texts are read again for their full sets."""
    inside = classes.select("key", "first", "copies", "size").join(cells, "key")
    blocks = inside.groupBy("component").agg(F.count(F.lit(1)).alias("_classes"), F.sum("size").alias("_elements")).select(
        "component", F.greatest(F.ceil(F.col("_classes") / CELL_BLOCK), F.ceil(F.col("_elements") / CELL_BLOCK_ELEMENTS)).cast("long").alias("blocks")
    )
    wanted = inside.join(blocks, "component").select(
        F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"), "key", "copies", "component", "blocks"
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text"))
    rows = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select(
        "key", "copies", "component", "blocks", "text"
    ).dropDuplicates(["key"])

    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for block in word_blocks(batch.column("text")) for s in shingle_sets(block)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], names=list("abcde"))

    return verified(rows.mapInArrow(run, "key BINARY, copies BIGINT, component BINARY, blocks BIGINT, elements BINARY"), similarity)


def _components(checked: DataFrame) -> DataFrame:
    """``(key, links, root)`` per class; parts of a group in several blocks are put together."""
    per_class = checked.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("blocks").alias("blocks"))
    parts = checked.where("blocks > 1 AND key <> root").select(F.col("key").alias("src"), F.col("root").alias("dst"))
    if parts.isEmpty():
        return per_class.drop("blocks")
    together = connected_components(parts.select(F.explode(F.array("src", "dst")).alias("id")), parts).select(F.col("id").alias("key"), "component")
    return per_class.join(together, "key", "left").select("key", "links", F.coalesce("component", "root").alias("root"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near duplicates, with the columns as they were."""
    plain = by_place(docs)
    own_id, own_text = (F.col(f"c{docs.columns.index(name)}") for name in (doc_id, text))
    linked = link_documents(plain.select(own_id.alias("doc_id"), own_text.alias("text")))
    kept = linked.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = plain.withColumn("_own_hash", F.xxhash64(F.coalesce(own_text, F.lit(""))))
    same = own_id.eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    one_each = rows.join(kept, same, "left_semi").dropDuplicates([f"c{docs.columns.index(doc_id)}", "_own_hash"])
    return one_each.drop("_own_hash").toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """A row per document: its group, its class's first document and its number of links."""
    return link_documents(docs).drop("text_hash")
