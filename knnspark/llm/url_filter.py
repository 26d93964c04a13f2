"""URL filters: a Bloom filter cascade over host and path keys, all in DataFrame functions.

A rule is a host and a path prefix. Level 1 encodes the listed keys; level 2 the keys of the
corpus that pass level 1 without being listed; level 3 the listed keys that pass level 2, and
so on until a level passes nothing wrong. Over the corpus whose keys it was built on, the
cascade answers exactly, and judging needs no join. Bits are set on the executors and travel as packed words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, discard, written

_LOWERED = str.maketrans(UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or without ://."""
    at = F.locate("://", url)
    return F.when(at > 0, ascii_lower(F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def candidate_keys(host: Column, path: Column, lengths: list[int], labels: list[int]) -> Column:
    """Every key that a rule fitting this host and path could have: a suffix of the host with as many labels
    as a rule's host has, plus a path prefix of one of the rules' path lengths."""
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in labels]))
    prefixes = F.array_distinct(F.array(*[F.substring(path, F.lit(1), F.least(F.lit(n), F.length(path))) for n in lengths]))
    fit = F.filter(prefixes, lambda p: F.length(p).isin(lengths))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fit, lambda p: F.concat(s, p))))
    return F.when(host != "", F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


@dataclass
class Cascade:
    """Levels of (bits, hashes, seed, 64-bit words of the bits in order, as comma-joined numbers)."""

    levels: list[tuple[int, int, int, str]] = field(default_factory=list)

    def _passes(self, key: Column, level: int) -> Column:
        size, hashes, seed, words = self.levels[level]
        # A constant that the optimizer turns into one array.
        words = F.split(F.lit(words), ",").cast("array<bigint>")
        places = F.array(*[_place(seed + k, key, size) for k in range(hashes)])
        return F.forall(places, lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)

    def contains(self, key: Column) -> Column:
        """Whether the key is listed: the first level that it fails decides by its parity."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def _place(seed: int, key: Column | str, size: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(size))


def _level(keys: DataFrame, n: int, hashes: int, bits_per_key: int, seed: int) -> tuple[int, int, int, str]:
    size = -(-max(64, n * bits_per_key) // 64) * 64
    at = keys.select(F.explode(F.array(*[_place(seed + k, "key", size) for k in range(hashes)])).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    # One number for 64 bits at most; build() bounds the bits.
    found = {r["w"]: r["bits"] for r in words.collect()}
    return size, hashes, seed, ",".join(str(found.get(w, 0)) for w in range(size // 64))


def build(listed: DataFrame, universe: DataFrame, most_keys: int = 200_000, bits_per_key: int = 10) -> Cascade:
    """A cascade for `listed` (column key), exact over `universe` (column key).

    Its size follows the list, never the corpus: where more than twice most_keys keys of the corpus pass level 1, its bits are doubled.
    More than most_keys listed keys raise: join instead (judge_by_join).
    """
    listed = listed.where("key is not null").select("key").distinct()
    n = listed.count()
    if n > most_keys:
        raise ValueError(f"{n} listed keys; a cascade takes {most_keys} at most")
    made = Cascade()
    if not n:
        return made
    while True:
        hashes = max(1, min(16, round(0.69 * bits_per_key)))
        made.levels = [_level(listed, n, hashes, bits_per_key, 1000)]
        outside = universe.where("key is not null").where(made._passes(F.col("key"), 0)).select("key").distinct().join(F.broadcast(listed), "key", "left_anti")
        outside = written(outside, "outside")
        if outside.count() <= 2 * most_keys:
            break
        discard(outside)
        bits_per_key *= 2
    inside, made_tables = listed, [outside]
    while True:
        for odd in (True, False):
            level = len(made.levels)
            source = outside if odd else inside
            n = source.count()
            if not n:
                discard(*made_tables)
                return made
            made.levels.append(_level(source, n, 3, 6, 1000 * (level + 1)))
            if odd:
                inside = written(inside.where(made._passes(F.col("key"), level)), "inside")
            else:
                outside = written(outside.where(made._passes(F.col("key"), level)), "outside")
            made_tables.append(inside if odd else outside)


def _verdict(allow: Column, block: Column, default: str) -> tuple[Column, Column]:
    """The longest key wins; of equally long ones (host suffixes differ) the block rule."""
    first = lambda keys: F.get(F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), F.lit(0))
    a, b = first(allow), first(block)
    blocked = b.isNotNull() & (a.isNull() | (b["n"] <= a["n"]))
    rule = F.when(blocked, b["k"]).otherwise(a["k"])
    return rule, F.when(blocked, F.lit("block")).when(a.isNotNull(), F.lit("allow")).otherwise(F.lit(default))


def _shapes(rules: list[tuple[str, str]]) -> tuple[list[int], list[int]]:
    """Path lengths and numbers of host labels that rules have; a key of others is no rule's."""
    return sorted({len(p) for _, p in rules}) or [0], sorted({h.count(".") + 1 for h, _ in rules}) or [1]


def judge(pages: DataFrame, allow: list[tuple[str, str]], block: list[tuple[str, str]], url: str = "url", default: str = "allow", most_keys: int = 200_000) -> DataFrame:
    """All rows and columns of pages plus host, path, rule and verdict (clashing columns are replaced).

    Null urls, or urls without ://, have an empty host and path, no rule and the default verdict:
    the cascades list none of their keys. A key in both lists counts as blocked. Equal rows get equal results; the work for
    a url grows with its length and the rules' shapes, not with its labels. Lists of over most_keys rules go to judge_by_join.
    """
    spark = pages.sparkSession
    if max(len(allow), len(block)) > most_keys:
        every = [(h, p, v) for rules, v in ((allow, "allow"), (block, "block")) for h, p in rules]
        return judge_by_join(pages, spark.createDataFrame(every, "host string, path string, verdict string"), url, default)
    lengths, labels = _shapes(allow + block)
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "_keys")]
    keyed = pages.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), lengths, labels)
    universe = keyed.select(F.explode(keys).alias("key"))
    listed = [spark.createDataFrame([(h.translate(_LOWERED) + p,) for h, p in rules], "key string") for rules in (allow, block)]
    yes, no = (build(rules, universe, most_keys) for rules in listed)
    hits = keyed.select("*", keys.alias("_keys")).select(*rest, "host", "path", F.filter("_keys", yes.contains).alias("_allow"), F.filter("_keys", no.contains).alias("_block"))
    rule, verdict = _verdict(F.col("_allow"), F.col("_block"), default)
    return hits.select(*rest, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def judge_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The way beyond a cascade's size: rules (host, path, verdict) of any number, joined by key.

    Equal urls share one look-up. Both sides of the joins are plain tables, so that adaptive execution can split
    the urls under a rule that fits very many, and the rows of a very frequent url.
    """
    listed = rules.select(F.concat(ascii_lower(F.col("host")), F.col("path")).alias("_key"), F.col("verdict").alias("_v")).where("_key is not null").groupBy("_key").agg(F.max("_v").alias("_v"))
    listed = written(listed, "rules")
    shapes = rules.where("host is not null and path is not null").select(F.length("path").alias("p"), (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("h")).distinct().collect()
    lengths, labels = sorted({r["p"] for r in shapes}) or [0], sorted({r["h"] for r in shapes}) or [1]
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(F.col(url).alias("_u")).where("_u is not null").distinct().select("_u", host_of(F.col("_u")).alias("host"), path_of(F.col("_u")).alias("path"))
    found = urls.select("_u", F.explode(candidate_keys(F.col("host"), F.col("path"), lengths, labels)).alias("_key")).join(listed, "_key")
    best = found.groupBy("_u").agg(F.max(F.struct(F.length("_key").alias("n"), F.col("_v").alias("v"), F.col("_key").alias("k"))).alias("_b"))
    joined = pages.select(*rest).join(written(best, "best"), F.col(url) == F.col("_u"), "left")
    return joined.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col("_b.k").alias("rule"), F.coalesce("_b.v", F.lit(default)).alias("verdict"))
