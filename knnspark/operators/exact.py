"""Exact k nearest neighbours: all queries against all rows, ordered by (dist, vec_id).

One block of queries goes to every base partition. More queries stay a table: packed into blocks of rows they meet the
base's partitions, of a bounded number of rows each, pair by pair on the executors. Where most vectors are copies, only the k least
ids of each vector and one query of each vector take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance
from ..types import MAX_DIMS, RESULT_SCHEMA, Measure, check_query, log


def partitions(df: DataFrame) -> int:
    """Shuffle width of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def top_k(pairs: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best (dist, vec_id) of each query, with their rank rk; Spark limits partial groups before the shuffle."""
    by = by or ["q_id"]
    order = Window.partitionBy(*by).orderBy("dist", "vec_id")
    return pairs.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def vectors_of(col: pa.Array, dims: int | None = None) -> np.ndarray:
    """A list column as a matrix of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, dims or 0))
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if dims is None:
        dims = len(values) // len(col)
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions are more than {MAX_DIMS}")
    if len(values) != len(col) * dims:
        raise ValueError("vectors differ in length")
    return values.reshape(len(col), dims)


def pair_distances(a: np.ndarray, b: np.ndarray, measure: Measure) -> np.ndarray:
    """Distances of a[k] and b[k], each summed left to right over the dimensions."""
    total = np.zeros(len(a))
    if measure is Measure.EUCLIDEAN:
        for k in range(a.shape[1]):
            gap = a[:, k] - b[:, k]
            total += gap * gap
        return total
    na, nb = np.zeros(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
        na += a[:, k] * a[:, k]
        nb += b[:, k] * b[:, k]
    norms = na * nb
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, np.abs(1 - total / np.sqrt(norms)), np.where(np.isnan(norms), np.nan, 1.0))


#: Distances computed at a time: bounds what a task holds of a block of queries and a block of rows.
CELLS = 1 << 18


def distances_of(queries: np.ndarray, row: np.ndarray, base: np.ndarray, at: np.ndarray, measure: Measure) -> np.ndarray:
    """pair_distances() of queries[row] and base[at], a slice at a time."""
    step = max(1, CELLS // max(1, queries.shape[1]))
    parts = [pair_distances(queries[row[k : k + step]], base[at[k : k + step]], measure) for k in range(0, len(row), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def nearest(queries: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, measure: Measure, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and distance of the k nearest of a block, by (dist, id); limit: of those up to each query's limit.

    A matrix product finds the candidates, with room for its rounding; only they get exact distances.
    """
    if not len(base) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    step = max(1, CELLS // len(base))
    parts = []
    for first in range(0, len(queries), step):
        row, at, dist = _nearest(queries[first : first + step], base, ids, k, measure, None if limit is None else limit[first : first + step])
        parts.append((row + first, at, dist))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _nearest(queries: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, measure: Measure, limit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if measure is Measure.EUCLIDEAN:
        qq, bb = (queries * queries).sum(1), (base * base).sum(1)
        # One product gives qq + bb - 2 qb.
        rough = np.column_stack([-2 * queries, qq, np.ones(len(queries))]) @ np.column_stack([base, np.ones(len(base)), bb]).T
        room = 1e-10 * (np.nan_to_num(qq)[:, None] + np.nan_to_num(bb, nan=0.0, posinf=0.0).max(initial=0)) + 1e-300
    else:
        qn, bn = np.sqrt((queries * queries).sum(1)), np.sqrt((base * base).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            rough = np.abs(1 - (queries @ base.T) / (qn[:, None] * bn[None, :]))
        rough[(qn == 0)[:, None] | (bn == 0)[None, :]] = 1.0
        room = 1e-10
    if measure is Measure.COSINE or not (np.isfinite(qq).all() and np.isfinite(bb).all()):
        np.copyto(rough, np.inf, where=np.isnan(rough))
    close = None
    if limit is not None and np.isfinite(limit).all():
        close = np.flatnonzero(rough <= limit[:, None] + room)  # most rows are farther than the best so far
        if len(close) > 4 * k * len(rough):
            close = None
    if close is None:
        most = (np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if k < rough.shape[1] else np.full((len(rough), 1), np.inf)) + room
        close = np.flatnonzero(rough <= most)
    row, at = close // rough.shape[1], close % rough.shape[1]
    dist = distances_of(queries, row, base, at, measure)
    good = ~np.isnan(dist)
    row, at, dist = row[good], at[good], dist[good]
    row, found, dist, _ = best(row, ids[at], dist, np.zeros(0, np.int64), k)
    return row, found, dist


def nearest_by(queries: np.ndarray, q_groups: np.ndarray | None, base: np.ndarray, groups: np.ndarray | None, ids: np.ndarray, k: int, measure: Measure, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """nearest() inside groups, and each result's group: with q_groups a query meets its own group only, else every group has results of its own."""
    if groups is None:
        return *nearest(queries, base, ids, k, measure, limit), np.zeros(0, np.int64)
    out = []
    for g in np.unique(groups):
        mine, asked = np.flatnonzero(groups == g), np.arange(len(queries)) if q_groups is None else np.flatnonzero(q_groups == g)
        row, found, dist = nearest(queries[asked], base[mine], ids[mine], k, measure)
        out.append((asked[row], found, dist, np.full(len(row), g)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def best(row: np.ndarray, ids: np.ndarray, dist: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each row (and group, if there are groups)."""
    keys = (ids, dist, group, row) if len(group) else (ids, dist, row)
    order = np.lexsort(keys)
    row, ids, dist, group = row[order], ids[order], dist[order], group[order] if len(group) else group
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | ((group[1:] != group[:-1]) if len(group) else False)
    first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else row
    keep = np.arange(len(row)) - first < k
    return row[keep], ids[keep], dist[keep], group[keep] if len(group) else group


_FOUND = RESULT_SCHEMA + ", grp bigint"


def _batch(q_ids: np.ndarray, held: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    group = pa.array(held[3]) if len(held[3]) else pa.nulls(len(held[0]), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(q_ids[held[0]]), pa.array(held[1]), pa.array(held[2]), group], names=["q_id", "vec_id", "dist", "grp"])


def _numbers(col: pa.Array, given: bool) -> np.ndarray | None:
    """Groups as numbers; a null group is the least number, which no other row should have."""
    return pc.fill_null(col, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) if given else None


def block_l2(queries: np.ndarray, base: np.ndarray, share: float | None = None) -> np.ndarray:
    """Squared distances (q, n), each summed left to right; share: from the points so far on the way from query to row."""
    columns = np.ascontiguousarray(base.T)
    total = np.zeros((len(queries), len(base)))
    gap = np.empty_like(total)
    for k in range(base.shape[1]):
        x = queries[:, k, None]
        if share is None:
            np.subtract(x, columns[k], out=gap)
        else:
            np.subtract(columns[k], x, out=gap)
            gap *= share
            gap += x
            gap -= columns[k]
        gap *= gap
        total += gap
    return total


class _Held:
    """The k best so far of each query of a block."""

    def __init__(self, q_ids: np.ndarray, queries: np.ndarray, q_groups: np.ndarray | None, k: int, measure: Measure) -> None:
        none = np.zeros(0, np.int64)
        self.q_ids, self.queries, self.q_groups, self.k, self.measure = q_ids, queries, q_groups, k, measure
        self.held = (none, none, np.zeros(0), none)
        self.limit: np.ndarray | None = None

    def meet(self, base: np.ndarray, groups: np.ndarray | None, ids: np.ndarray) -> None:
        found = nearest_by(self.queries, self.q_groups, base, groups, ids, self.k, self.measure, self.limit)
        self.held = best(*(np.concatenate(x) for x in zip(self.held, found, strict=True)), self.k)
        row, dist = self.held[0], self.held[2]
        last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else row
        full = np.bincount(row, minlength=len(self.q_ids)) == self.k
        self.limit = np.full(len(self.q_ids), np.inf)
        self.limit[row[last]] = np.where(full[row[last]], dist[last], np.inf)

    def batch(self) -> pa.RecordBatch:
        return _batch(self.q_ids, self.held)


def _one_block(base: DataFrame, block: pa.Table, k: int, measure: Measure, own: bool) -> DataFrame:
    """All queries, a block, sent along to every base partition."""
    queries = vectors_of(block["embedding"])
    q_groups = _numbers(block["grp"].combine_chunks(), own) if len(block) else None
    shared = base.sparkSession.sparkContext.broadcast((block["q_id"].to_numpy(), queries, q_groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, queries, q_groups = shared.value
        if not len(q_ids):
            return
        held = _Held(q_ids, queries, q_groups, k, measure)
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                held.meet(vectors_of(part.column(1), queries.shape[1]), _numbers(part.column(2), own), part.column(0).to_numpy())
        yield held.batch()

    return base.mapInArrow(run, _FOUND)


_PACKED = "ids array<bigint>, vectors array<double>, groups array<bigint>"
#: Rows of a packed block of the base, and about how many rows of the base a task holds at a time.
PACK, PART = 2048, 16_384


def packed(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """Rows of up to `rows` ids, vectors (end to end) and groups, packed inside each partition; null vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            values = vectors_of(table.column(1)).ravel()
            cells = [table.column(0).combine_chunks(), pa.array(values), table.column(2).combine_chunks()]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cells], names=["ids", "vectors", "groups"])

        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) >= rows:
                    yield flush()
                    held = []
        if any(b.num_rows for b in held):
            yield flush()

    return df.select(id_col, "embedding", "grp").mapInArrow(run, _PACKED)


def query_blocks(queries: DataFrame, n: int, block: int) -> DataFrame:
    """Packed blocks (q_block, q_ids, q_vectors, q_groups) of n queries, about one a partition."""
    return packed(queries.repartition(max(1, -(-n // block))), "q_id", block).select(F.monotonically_increasing_id().alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("groups").alias("q_groups"))


def _cells(batch: pa.RecordBatch, at: int, *names: str) -> list[pa.Array]:
    return [batch[name][at].values for name in names]


def _matrix(values: pa.Array, n: int) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).reshape(n, -1)


def _many_blocks(base: DataFrame, queries: DataFrame, block: int, k: int, measure: Measure, own: bool) -> DataFrame:
    """Queries as a table: its blocks meet the base's partitions pair by pair, and only the k best of a pair go on."""
    base = base.repartition(max(1, -(-base.count() // PART)))
    pairs = packed(base, "vec_id", PACK).crossJoin(query_blocks(queries, queries.count(), min(block, PACK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Held] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                ids, vectors, groups, q_ids, q_vectors, q_groups = _cells(batch, at, "ids", "vectors", "groups", "q_ids", "q_vectors", "q_groups")
                name = batch["q_block"][at].as_py()
                if name not in blocks:
                    blocks[name] = _Held(q_ids.to_numpy(), _matrix(q_vectors, len(q_ids)).copy(), _numbers(q_groups, own), k, measure)
                x = _matrix(vectors, len(ids))
                if x.shape[1] != blocks[name].queries.shape[1]:
                    raise ValueError("vectors differ in length")
                blocks[name].meet(x, _numbers(groups, own), ids.to_numpy())
        for held in blocks.values():
            yield held.batch()

    return pairs.mapInArrow(run, _FOUND)


def _in_shards(base: DataFrame, queries: DataFrame, block: int, k: int, measure: Measure) -> DataFrame:
    """(q_id, shard_id, vec_id, dist, rk): a shard's rows meet in one task, so that its results need no shuffle."""
    def pack(table: pa.Table) -> pa.Table:
        cells = [table["vec_id"].combine_chunks(), pa.array(vectors_of(table["embedding"]).ravel())]
        return pa.table([table["grp"].slice(0, 1), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cells)], names=["grp", "ids", "vectors"])

    base = base.where("embedding IS NOT NULL")
    whole = base.repartition(max(partitions(base), -(-base.count() // PART)), "grp").groupBy("grp").applyInArrow(pack, "grp bigint, ids array<bigint>, vectors array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, vectors, q_ids, q_vectors = _cells(batch, at, "ids", "vectors", "q_ids", "q_vectors")
                q, x, shard = _matrix(q_vectors, len(q_ids)), _matrix(vectors, len(ids)), batch["grp"][at].as_py()
                if x.shape[1] != q.shape[1]:
                    raise ValueError("vectors differ in length")
                step = max(1, CELLS // k)
                for first in range(0, len(q), step):
                    row, found, dist = nearest(q[first : first + step], x, ids.to_numpy(), k, measure)
                    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids.to_numpy()[row + first]), pa.array(np.full(len(row), shard, np.int32)), pa.array(found), pa.array(dist), pa.array(rank.astype(np.int32))], names=["q_id", "shard_id", "vec_id", "dist", "rk"])

    return whole.crossJoin(query_blocks(queries, queries.count(), min(block, PACK))).mapInArrow(run, "q_id bigint, shard_id int, vec_id bigint, dist double, rk int")


def uniform(*frames: DataFrame) -> bool:
    """Whether all vectors are there, of one length and without null components."""
    rows = [df.agg(F.min(F.size("embedding")), F.max(F.size("embedding")), F.count_if(F.col("embedding").isNull()), F.count_if(F.exists("embedding", lambda x: x.isNull()))).head() for df in frames]
    return all(r[2] == r[3] == 0 for r in rows) and len({x for r in rows for x in r[:2] if x is not None}) <= 1


def all_pairs(base: DataFrame, queries: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 512) -> DataFrame:
    """(q_id, vec_id, dist) of all pairs; of: distances of a block of queries and a block of rows. Vectors have to be uniform()."""
    base = base.select("vec_id", "embedding", F.lit(None).cast("bigint").alias("grp"))
    base, queries = base.repartition(max(1, -(-base.count() // PART))), queries.select("q_id", "embedding", F.lit(None).cast("bigint").alias("grp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, vectors, q_ids, q_vectors = _cells(batch, at, "ids", "vectors", "q_ids", "q_vectors")
                x, q, ids, q_ids = _matrix(vectors, len(ids)), _matrix(q_vectors, len(q_ids)), ids.to_numpy(), q_ids.to_numpy()
                for first in range(0, len(q), 32):
                    dist = of(q[first : first + 32], x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[first : first + 32], len(x))), pa.array(np.tile(ids, len(dist))), pa.array(dist.ravel())], names=["q_id", "vec_id", "dist"])

    return packed(base, "vec_id", PACK).crossJoin(query_blocks(queries, queries.count(), block)).mapInArrow(run, RESULT_SCHEMA)


def _copies(base: DataFrame) -> bool:
    """Whether most vectors are copies of others."""
    n, kinds = base.agg(F.count("embedding"), F.approx_count_distinct(F.xxhash64("embedding", "grp"))).head()
    return 4 * kinds <= n


def brute_force(
    base: DataFrame, queries: DataFrame, k: int = 100, measure: Measure | str = Measure.EUCLIDEAN, strategy: str = "arrow",
    id_col: str = "vec_id", vec_col: str = "embedding", query_id: str | None = None, query_vec: str | None = None, dims: int | None = None, query_block: int = 4096,
    by: str | None = None, shard_size: int | None = None,
) -> DataFrame:
    """Rows (q_id, vec_id, dist, rk): the k nearest rows of base for each query row.

    arrow: up to query_block queries go to every base partition, which sends k rows per query on; base is read where it
    lies. More queries stay a table whose blocks meet the base's partitions on the executors. sql: a cross join for Catalyst, of
    blocks if all vectors are there and of one length, else of rows (sums unrolled if dims is given and at most 32). by: a column (bigint or int) of both; a query meets rows of its
    own value only, null meets null never. shard_size: ranges of so many ids have k results each (with shard_id).
    Self is not left out; rows with null vectors or NaN distances never match; fewer than k rows give fewer results.
    """
    measure = Measure.of(measure)
    check_query(k)
    if by is not None and shard_size is not None:
        raise ValueError("by and shard_size exclude each other")
    group = F.col(by) if by else F.floor(F.col(id_col) / F.lit(shard_size)) if shard_size else F.lit(None)
    base = base.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("embedding"), group.cast("bigint").alias("grp"))
    queries = queries.select(F.col(query_id or id_col).cast("bigint").alias("q_id"), F.col(query_vec or vec_col).alias("embedding"), (F.col(by) if by else F.lit(None)).cast("bigint").alias("grp")).where("embedding IS NOT NULL")
    if by:
        base, queries = base.where("grp IS NOT NULL"), queries.where("grp IS NOT NULL")
    if strategy not in ("arrow", "sql"):
        raise ValueError("strategy must be arrow or sql")
    if strategy == "sql" and not (uniform(base, queries) and shard_size is None):
        pairs = queries.select("q_id", F.col("embedding").alias("q"), F.col("grp").alias("g")).crossJoin(base.withColumnRenamed("embedding", "b"))
        pairs = pairs.where("g = grp") if by else pairs
        pairs = pairs.select("q_id", "vec_id", distance(F.col("q"), F.col("b"), measure, dims).alias("dist"), "grp").where("dist IS NOT NULL AND NOT isnan(dist)")
        if shard_size:
            return top_k(pairs.withColumn("shard_id", F.col("grp").cast("int")).drop("grp"), k, ["q_id", "shard_id"])
        return top_k(pairs.drop("grp"), k)
    if shard_size:
        return _in_shards(base, queries, query_block, k, measure)
    own, members = by is not None, None
    if _copies(base):
        # Copies are equally near: of each vector the k least ids are enough, and one query finds what its copies find.
        least = Window.partitionBy("grp", "embedding").orderBy("vec_id")
        base = base.where("embedding IS NOT NULL").withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k).drop("nth")
        members = queries.select("q_id", F.min("q_id").over(Window.partitionBy("grp", "embedding")).alias("first"))
        queries = queries.groupBy("grp", "embedding").agg(F.min("q_id").alias("q_id")).select("q_id", "embedding", "grp")
    few = queries.limit(query_block + 1).toArrow() if strategy == "arrow" else None
    if few is not None and len(few) <= query_block:
        log.info("brute force: %d queries", len(few))
        pairs = _one_block(base, few, k, measure, own)
    else:
        pairs = _many_blocks(base, queries, query_block, k, measure, own)
    pairs = pairs.drop("grp")
    if members is None:
        return top_k(pairs, k)
    found = top_k(pairs, k).select(F.col("q_id").alias("first"), "vec_id", "dist")
    return top_k(members.join(found, "first").select("q_id", "vec_id", "dist"), k)
