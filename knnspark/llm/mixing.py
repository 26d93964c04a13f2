"""Mixing sources to target weights along a time-varying curriculum, all in DataFrame functions.

Each source has a base weight and a schedule: its weight moves linearly from `start` to `end`
times the base over training time 0..1 (start + end = 2, so the integral is the base weight).
Targets share the total demand by weight, stopped at `repeats` times a source's size. A
source's documents, in a hashed order repeated pass by pass, meet its demand; the cumulative words at
the middle of a document's first take, put through the inverse of the integrated schedule,
are its training position, and documents are range-sorted by position.

Windows over all sources and over one source's cuts run in one task each: a row per source, and one per bucket_rows documents.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, written

#: Base weights, start and end multipliers, dealt to the sources in order, again and again.
WEIGHTS = (3.0, 1.0, 2.0)
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, repeats: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes: one row per source (source, source_size); adds rank, weight and target.

    The sum of targets is share times all sizes. Sources are filled from the one that meets its
    stop first: with caps in order of cap / weight, the level where the rest fits shares by weight.
    """
    every = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(every) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share
    # Levels that do not pass their own stop fall along this order; the first of them, the largest, holds.
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    whole = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    final = F.max(fits).over(whole)
    leveled = leveled.withColumn("final", final)
    return leveled.select("source", "source_size", "rank", "weight", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target"))


def _inverse(share: Column, start: Column, end: Column) -> Column:
    """Time at which the integrated linear schedule has reached `share` of its whole."""
    slope = end - start
    root = F.sqrt(F.greatest(start * start + slope * (start + end) * share, F.lit(0.0)))
    return F.when(slope == 0, share).otherwise((root - start) / slope)


def mix(docs: DataFrame, share: float = 1.5, repeats: float = 2.0, weights: tuple[float, ...] = WEIGHTS, schedules: tuple = SCHEDULES, id_column: str = "doc_id", source: str = "source", text: str = "text", bucket_rows: int = 1024, carry: list[str] | None = None, per_take: bool = False) -> DataFrame:
    """Per document: id, carried columns, size, source_size, target, taken, position; range-sorted by position.

    Null texts have size 0 and are taken 0 times; they stand at their place in the order. A null
    source is a source of its own, last. The order inside a source is by md5 of the id, then by size, so reruns
    agree and equal rows are interchangeable. The last document of a pass may be taken in part, so each
    source's words sum to its target's whole part (for targets up to `repeats` passes of whole
    documents). All sizes 0: targets and takes are 0. carry: further columns of docs to keep. per_take: a row for each take
    instead, with `take` (0 for the first), its words as `taken` and its own position.
    """
    carry = [c for c in (carry or []) if c != id_column]
    base = docs.select(
        F.col(id_column).alias("_id"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)],
        F.col(source).isNull().alias("_none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_src"), words(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")).alias("_key"),
    )
    base = written(base, "sized")
    per_source = written(base.groupBy("_none", "_src").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), "sources")
    share_of = targets(per_source.select(F.when(~F.col("_none"), F.col("_src")).alias("source"), "source_size"), share, repeats, weights)
    plan = share_of.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_src"), "source_size", "rank", "target")
    # A source is cut into as many hash ranges as its rows need, so that no task holds a whole one.
    cuts = per_source.select("_none", "_src", F.greatest(F.ceil(F.col("_rows") / bucket_rows), F.lit(1)).cast("long").alias("_cuts"))
    info = written(plan.join(cuts, ["_none", "_src"]), "plan")
    place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    dealt = base.join(info, ["_none", "_src"]).withColumn("_cut", F.floor(place * F.col("_cuts") / F.lit(1 << 32)).cast("long"))
    sums = dealt.groupBy("_none", "_src", "_cut").agg(F.sum("size").alias("_sum"))
    # One row per cut: thousands of documents each.
    upto = Window.partitionBy("_none", "_src").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_none", "_src", "_cut").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_none", "_src", "_cut"])
    start = F.col("_before") + F.col("_in")
    demand = F.floor("target").cast("long")
    words_of = lambda k: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), demand - k * F.col("source_size") - F.col("_start")))
    placed = placed.withColumn("_start", start)
    if per_take:
        placed = placed.withColumn("take", F.explode(F.sequence(F.lit(0), F.lit(ceil(repeats) - 1)))).withColumn("taken", words_of(F.col("take"))).where("taken > 0")
        middle = (2 * (F.col("_start") + F.col("take") * F.col("source_size")) + F.col("size")) / 2.0 / F.greatest(F.col("target"), F.lit(1.0))
    else:
        total = lambda sum_, k: sum_ + words_of(k)
        placed = placed.withColumn("taken", F.aggregate(F.sequence(F.lit(0), F.lit(ceil(repeats) - 1)), F.lit(0).cast("long"), total))
        middle = (2 * F.col("_start") + F.col("size")) / 2.0 / F.greatest(F.col("target"), F.lit(1.0))
    pick = lambda k: F.element_at(F.array(*[F.lit(float(s[k])) for s in schedules]), F.col("rank") % len(schedules) + 1)
    out = placed.select(
        F.col("_id").alias(id_column), *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], "size", "source_size", "target", "taken", *(["take"] if per_take else []),
        _inverse(F.least(middle, F.lit(1.0)), pick(0), pick(1)).alias("position"),
    )
    return out if per_take else out.orderBy("position", F.col(id_column).asc_nulls_last())


def train_order(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of docs as the mix takes them: once per take of any words, range-sorted by position.

    Rows that agree in id, source and text are numbered, and each goes with the takes of its own number.
    """
    hashed = lambda c: F.when(F.col(c).isNull(), F.lit(1)).otherwise(F.xxhash64(F.lit(0), c))
    names = ["_r1", "_r2", "_r3"]
    keyed = docs.select("*", hashed(id_column).alias("_r1"), hashed(text).alias("_r2"), hashed(source).alias("_r3"))
    takes = mix(keyed, id_column=id_column, source=source, text=text, carry=names, per_take=True, **options)
    same = Window.partitionBy(*names, "take").orderBy("position")
    takes = written(takes.select(*names, F.col("take").alias("_take"), F.col("position").alias("_position"), F.row_number().over(same).alias("_n")), "takes")
    repeated = written(keyed.groupBy(*names).agg(F.count("*").alias("_copies")).where("_copies > 1").select(*names), "repeated")
    if repeated.isEmpty():
        chosen = keyed.join(takes.drop("_n"), names)
    else:
        numbered = keyed.join(repeated, names, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy(F.col(id_column))))
        chosen = keyed.join(repeated, names, "left_anti").join(takes.drop("_n"), names).unionByName(numbered.join(takes, [*names, "_n"]).drop("_n"))
    return chosen.orderBy("_position", F.col(id_column).asc_nulls_last(), "_take").select(docs.columns)
