"""N-gram Jaccard join: a size-aware heavy-light set similarity join, exact.

Documents with equal shingle sets form one node. Shingles are ordered from rare to frequent by
a count sketch of fixed size over all documents, ties by hash. Of two sets that link, the parts
before a bound of that order share shingles (prefix bound). Small (light) sets list
every pair of shingles of their prefix, and meet under a common pair; large (heavy) sets and the
light ones near the boundary stand in the inverted lists of single shingles, which are scanned. The boundary is where the
modelled cost of listing pairs and scanning lists is least.

Links are needed up to connectivity, so a list is first joined to one member (its pivot); lists that may be
long are dealt over keys with a pivot each, and those pivots are joined to one of them. Each member is verified against the pivot it
shares most lists with, which gives a forest, and its trees are contracted. After that only lists that hold members of several
trees are looked at again, and pairs across trees that pass the positional bound are verified. Such a pair is taken from a list only if none of
the BEFORE lists that come before it, for both, is common to them; the first common list, to which the bound applies, is never
left out. That join has two plain sides, so adaptive execution can split long lists on both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, flat, mix64, slices, span_hashes, tidy, word_spans, written
from .components import components, roots

SKETCH, SLOT = 1 << 20, 1 << 12
#: Earlier lists that a row of a list remembers.
BEFORE = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by row and hash (A-Z lower-cased).

    A row with fewer words than a shingle has its whole sequence as one; without words, none.
    """
    buf = _LOWER[buf]
    starts, ends, rows = word_spans(buf, offsets)
    w = span_hashes(buf, starts, ends)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    out_rows, out = [rows[:0]], [w[:0]]

    def chain(at: np.ndarray, n: int) -> np.ndarray:
        h = w[at]
        for k in range(1, n):
            h = mix64(h * np.uint64(3) + w[at + k])
        return mix64(h + np.uint64(n))

    for n in range(1, words):
        short = np.flatnonzero(count == n)
        out_rows.append(short)
        out.append(chain(first[short], n))
    if len(w) >= words:
        at = np.flatnonzero(rows[: len(w) - words + 1] == rows[words - 1 :])
        out_rows.append(rows[at])
        out.append(chain(at, words))
    row, h = np.concatenate(out_rows), np.concatenate(out)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _row_sums(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    ends = np.searchsorted(row, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def row_key(id_column: str, text: str) -> list[Column]:
    """Two numbers that name a row: of its id (null has its own) and of its text."""
    return [F.when(F.col(id_column).isNull(), F.lit(1)).otherwise(F.xxhash64(F.lit(0), id_column)).alias("r1"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("r2")]


def _scan(rows: DataFrame, words: int) -> DataFrame:
    """Per document (kind 0) its id, row key, set size and set digest; per task (kind 1) the count sketch in slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, dtype=np.int64)
        names = ["kind", "id", "r1", "r2", "n", "h1", "h2", "counts"]
        for whole in batches:
            for batch in slices(whole, "text"):
                buf, offsets = flat(batch.column(3))
                row, h = shingle_sets(buf, offsets, words)
                n = len(offsets) - 1
                sketch += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                h1, h2 = (_row_sums(row, mix64(h ^ np.uint64(c)), n).view(np.int64) for c in (0x1234567, 0x89ABCDEF01))
                size = np.bincount(row, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *batch.columns[:3], pa.array(size), pa.array(h1), pa.array(h2), pa.nulls(n, pa.binary())], names=names)
        used = [k for k in range(SKETCH // SLOT) if sketch[k * SLOT : (k + 1) * SLOT].any()]
        none = pa.nulls(len(used), pa.int64())
        counts = [sketch[k * SLOT : (k + 1) * SLOT].tobytes() for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), np.int32)), pa.array(used, pa.int64()), none, none, none, none, none, pa.array(counts, pa.binary())], names=names)

    return rows.mapInArrow(run, "kind int, id bigint, r1 bigint, r2 bigint, n bigint, h1 bigint, h2 bigint, counts binary")


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: a fixed number of counters."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[slot] = total.get(slot, 0) + np.frombuffer(counts, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slot", "counts"])

    rows = scanned.where("kind = 1").select(F.col("id").alias("slot"), "counts")
    out = np.zeros(SKETCH, dtype=np.int64)
    for r in rows.repartition("slot").mapInArrow(add, "slot bigint, counts binary").collect():
        out[r["slot"] * SLOT : (r["slot"] + 1) * SLOT] += np.frombuffer(r["counts"], dtype=np.int64)
    return out


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def boundary(sizes: list[tuple[int, int]], sketch: np.ndarray, percent: int) -> int:
    """The largest light size, by cost: sizes is the histogram of set sizes.

    Light sets write a row per pair of prefix shingles; heavy ones a row per prefix shingle and read its
    list, whose mean length is taken from the rarest quarter of the sketch (rare shingles fill
    prefixes), less what collisions in a counter would give.
    """
    if not sizes:
        return 0
    c = np.sort(sketch[sketch > 0])
    rare = c[: max(1, int(np.searchsorted(np.cumsum(c), c.sum() / 4)))] if len(c) else np.ones(1)
    list_length = 1 + max(0.0, float((rare.astype(float) ** 2).sum() / rare.sum()) - float(rare.mean()))
    n, docs = (np.array(x, dtype=float) for x in zip(*sorted(sizes), strict=True))
    single = n - _need(n, percent) + 1
    pairs = (single + 1) * single / 2
    best, cost = 0, None
    for b in [0, *n.tolist()]:
        light, edge = n <= b, (n <= b) & (n * 100 >= percent * (b + 1))
        total = (docs * pairs)[light].sum() + (docs * single * (1 + list_length))[~light | edge].sum()
        if cost is None or total < cost:
            best, cost = int(b), total
    return best


def _shared_sketch(rows: DataFrame, sketch: np.ndarray) -> Broadcast:
    return rows.sparkSession.sparkContext.broadcast(sketch.astype(np.int32 if sketch.max(initial=0) < 1 << 31 else np.int64))


def _in_order(row: np.ndarray, h: np.ndarray, rows: int, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and sketched count of the shingles of the rows' prefixes, rarest first (ties by hash), and the rows' set sizes."""
    n = np.bincount(row, minlength=rows)
    c = counts[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
    order = np.lexsort((h, c, row))
    row, h, c = row[order], h[order], c[order]
    keep = np.arange(len(row)) - (np.cumsum(n) - n)[row] < np.minimum(n, n - _need(n, percent) + 2)[row]
    return row[keep], h[keep], c[keep], n


def _prefixes(rows: DataFrame, sketch: np.ndarray, words: int, percent: int, list_rows: int) -> DataFrame:
    """Per document its row key, set size and prefix, rarest first; spread: parts that a shingle's list is dealt over."""
    shared = _shared_sketch(rows, sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = shared.value.mean()
        for whole in batches:
            for batch in slices(whole, "text"):
                buf, offsets = flat(batch.column(3))
                row, h, c, n = _in_order(*shingle_sets(buf, offsets, words), len(offsets) - 1, shared.value, percent)
                ends = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
                spread = np.ceil(np.maximum(c - 2 * mean, 1) / list_rows).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), batch.column(2), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(ends, h.view(np.int64)), pa.ListArray.from_arrays(ends, spread)],
                    names=["r1", "r2", "n", "prefix", "spread"],
                )
        tidy()

    return rows.mapInArrow(run, "r1 bigint, r2 bigint, n int, prefix array<bigint>, spread array<int>")


def _keys(prefixes: DataFrame, light: int, percent: int) -> DataFrame:
    """List rows (key, base, node, n, room, other): room is the overlap still possible if the key's shingles are the first shared.

    base is the shingle of a list that is dealt over several keys, else null; other is the place of a pair's first shingle, else -1.
    """
    single = prefixes.where(F.expr(f"n > {light} OR n * 100 >= {percent * (light + 1)}")).where("n > 1")
    single = single.select("node", "n", F.posexplode(F.arrays_zip("prefix", "spread")).alias("at", "p")).where(F.expr(f"at < n - ceil({percent} * n / 100D) + 1"))
    token, parts = F.col("p.prefix"), F.col("p.spread")
    single = single.select(
        F.when(parts > 1, F.xxhash64(token, F.pmod(F.xxhash64("node"), parts))).otherwise(token).alias("key"), F.when(parts > 1, token).alias("base"),
        "node", "n", (F.col("n") - F.col("at")).alias("room"), F.lit(-1).alias("other"),
    )
    dealt = "least(spread[i], spread[j])"
    pair = f"named_struct('key', IF({dealt} > 1, xxhash64(2, prefix[i], prefix[j], pmod(xxhash64(node), {dealt})), xxhash64(2, prefix[i], prefix[j])), 'base', IF({dealt} > 1, xxhash64(2, prefix[i], prefix[j]), NULL), 'room', n - j + 1, 'other', i)"
    pairs = f"flatten(transform(sequence(1, size(prefix) - 1), j -> transform(sequence(0, j - 1), i -> {pair})))"
    light_rows = prefixes.where(f"n > 1 AND n <= {light} AND size(prefix) > 1").select("node", "n", F.explode(F.expr(pairs)).alias("p"))
    return single.unionByName(light_rows.select("p.key", "p.base", "node", "n", "p.room", "p.other"))


def _enough(a: str, b: str, percent: int) -> Column:
    return F.expr(f"{100 + percent} * least({a}.room, {b}.room) >= {percent} * ({a}.n + {b}.n)")


def _starred(rows: DataFrame, by: str) -> DataFrame:
    """The rows with their list's pivot, the member of least rank."""
    return rows.withColumn("pivot", F.min(F.struct("rank", "node", "n", "room")).over(Window.partitionBy(by)))


def _ranked(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their node's rank, and the written table of ranks: minus the number of others it meets in its lists, each time it does.

    Among near copies the one that shares most with the others comes first, and so is the pivot of all lists it is in.
    """
    ranks = written(lists.groupBy("node").agg((-F.sum(F.col("members") - 1)).alias("rank")), "ranks")
    return lists.drop("members").join(ranks, "node"), ranks


def _to_pivots(starred: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (x pivot, y member); x comes before y in the order of (rank, node)."""
    pairs = starred.select(F.col("pivot").alias("a"), F.struct("node", "n", "room").alias("b")).where("a.node <> b.node").where(_enough("a", "b", percent))
    return pairs.select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))


def _sets(wanted: DataFrame, rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The whole shingle sets (node, set) of the wanted nodes; repeated rows give a node more than once."""
    chosen = nodes.select("node", "r1", "r2").join(wanted, "node")
    texts = rows.join(chosen, ["r1", "r2"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                buf, offsets = flat(batch.column(1))
                row, h = shingle_sets(buf, offsets, words)
                ends = np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, h.view(np.int64))], names=["node", "set"])
        tidy()

    return written(texts.mapInArrow(run, "node bigint, set array<bigint>"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose whole sets overlap enough."""
    left = pairs.join(sets.select(F.col("node").alias("x"), F.col("set").alias("a")), "x")
    both = left.join(sets.select(F.col("node").alias("y"), F.col("set").alias("b")), "y")
    shared = F.size(F.array_intersect("a", "b"))
    return written(both.where((100 + percent) * shared >= percent * (F.size("a") + F.size("b"))).select("x", "y").distinct(), "verified")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after the links (x, y) between nodes, written."""
    x, y = (labels.select(F.col("node").alias(n), F.col("label").alias(f"_{n}")) for n in ("x", "y"))
    ends = links.join(x, "x").join(y, "y").select(F.col("_x").alias("x"), F.col("_y").alias("y"))
    tops = written(components(ends), "tops").select(F.col("node").alias("label"), F.col("label").alias("top"))
    return written(labels.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (list, node, n, room, other, label) of lists with members of several components, written."""
    marked = written(lists.select("list", "node", "n", "room", "other").join(labels, "node"), "marked")
    several = marked.groupBy("list").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("list")
    several = written(several, "several")
    out = written(marked.join(several, "list", "left_semi"), "open")
    discard(marked, several)
    return out


def join(docs: DataFrame, words: int = 5, percent: int = 75, id_column: str = "doc_id", text: str = "text", list_rows: int = 4096, keys: bool = False) -> DataFrame:
    """Per document: id, n_shingles, component_id (least id reachable by links, itself included).

    Two documents link when 100 * shared >= percent * union of their shingle sets. Null or empty texts,
    or texts without words, have no shingles and link with nothing; texts may be of any length. Rows with a null id link like others;
    their component_id is the least id they reach, null if there is none. Rows that share an id are told apart by their texts, each linking
    by its own; repeated rows keep their own rows. keys: also return the row keys r1 and r2 (row_key).
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), *row_key(id_column, text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scanned = written(_scan(rows, words), "scan")
    members = scanned.where("kind = 0").select("id", "r1", "r2", "n", "h1", "h2")
    sketch = _sketch(scanned)
    classes = members.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2")).alias("m"))
    # Classes are named by number; the written table is the only place that numbers them.
    nodes = written(classes.select("h1", "h2", "n", F.monotonically_increasing_id().alias("node"), F.col("m.id").alias("own"), "m.r1", "m.r2"), "nodes")
    # One row per set size: as many as the longest text has words, at most.
    sizes = [(r["n"], r["count"]) for r in nodes.groupBy("n").count().collect()]
    light = boundary(sizes, sketch, percent)
    prefixes = _prefixes(rows, sketch, words, percent, list_rows).join(nodes.select("node", "r1", "r2"), ["r1", "r2"]).select("node", "n", "prefix", "spread")
    met = written(_keys(prefixes, light, percent).withColumn("members", F.count("*").over(Window.partitionBy("key"))).where("members > 1 OR base IS NOT NULL"), "met")
    ranked, ranks = _ranked(met)
    lists = written(_starred(ranked, "key"), "lists")
    discard(met, ranks)
    far = _starred(lists.where("base IS NOT NULL AND node = pivot.node").select("base", "rank", "node", "n", "room"), "base")
    # A member's best pivot is the one it shares most lists with: one node before it in the order, so the links are a forest.
    counted = _to_pivots(lists, percent).unionByName(_to_pivots(far, percent)).groupBy("x", "y").agg(F.count("*").alias("c"))
    best = counted.groupBy("y").agg(F.max(F.struct("c", (-F.col("x")).alias("x"))).alias("b")).select((-F.col("b.x")).alias("x"), "y")
    best = written(best, "best")
    sets = _sets(best.select(F.explode(F.array("x", "y")).alias("node")).distinct(), rows, nodes, words)
    links = _verified(best, sets, percent)
    discard(best, sets)
    trees = roots(links.select(F.col("y").alias("node"), F.col("x").alias("label")))
    labels = written(nodes.select("node").join(trees, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    open_rows = _open(lists.select(F.coalesce("base", "key").alias("list"), "node", "n", "room", "other"), labels)
    discard(lists, links)
    # A node's lists of one kind in the order of their shingles.
    order = Window.partitionBy("node", F.col("other") >= 0).orderBy(F.desc("room"), "other").rowsBetween(-BEFORE, -1)
    sided = written(open_rows.withColumn("before", F.collect_list("list").over(order)), "sided")
    discard(open_rows)
    sets = _sets(sided.select("node").distinct(), rows, nodes, words)
    first = F.expr("NOT arrays_overlap(a.before, b.before)")
    across = sided.alias("a").join(sided.alias("b"), F.expr("a.list = b.list AND a.node < b.node AND a.label <> b.label") & _enough("a", "b", percent) & first).select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()
    pairs = written(across, "pairs")
    discard(sided)
    more = _verified(pairs, sets, percent)
    discard(sets, pairs)
    labels = _merged(labels, more)
    # Labels back to ids: the least id of each component's documents.
    of_node = written(nodes.join(labels, "node").select("h1", "h2", "n", "label", "own"), "of_node")
    least = written(of_node.groupBy("label").agg(F.min("own").alias("component_id")), "least")
    named = written(of_node.join(least, "label").select("h1", "h2", "n", "component_id"), "named")
    discard(more, nodes, labels, of_node, least)
    joined = members.join(named, ["h1", "h2", "n"], "left")
    out = joined.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "r1", "r2")
    return out if keys else out.drop("r1", "r2")


def representatives(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is their component's least; all rows of a component without ids stay."""
    found = join(docs, id_column=id_column, text=text, keys=True, **options)
    kept = found.where(F.col(id_column).eqNullSafe(F.col("component_id"))).select("r1", "r2").distinct()
    keyed = docs.select("*", *(k.alias(f"_{n}") for k, n in zip(row_key(id_column, text), ("r1", "r2"), strict=True)))
    return keyed.join(kept.select(F.col("r1").alias("_r1"), F.col("r2").alias("_r2")), ["_r1", "_r2"], "left_semi").select(docs.columns)
