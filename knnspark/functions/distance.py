"""Distances as Column expressions; sums run left to right over the dimensions in doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..types import Measure

#: Up to so many dimensions a sum is written out term by term in generated code; longer ones overflow its compiler and are folded over the arrays.
UNROLL = 32
#: Share of the way to the other point at which a half point lies.
HALF = 0.5 - 0.1


def widen(vector: Column) -> Column:
    return vector.cast("array<double>")


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot(a: Column, b: Column, dims: int | None = None) -> Column:
    if dims is not None and 0 < dims <= UNROLL:
        return _sum([F.get(a, F.lit(k)).cast("double") * F.get(b, F.lit(k)).cast("double") for k in range(dims)])
    return F.aggregate(F.zip_with(widen(a), widen(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column, dims: int | None = None) -> Column:
    return dot(a, a, dims)


def l2_squared(a: Column, b: Column, dims: int | None = None) -> Column:
    if dims is not None and 0 < dims <= UNROLL:
        gaps = [F.get(a, F.lit(k)).cast("double") - F.get(b, F.lit(k)).cast("double") for k in range(dims)]
        return _sum([g * g for g in gaps])
    return F.aggregate(F.zip_with(widen(a), widen(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column, dims: int | None = None) -> Column:
    return F.sqrt(l2_squared(a, b, dims))


def cosine(a: Column, b: Column, dims: int | None = None, a_norm2: Column | None = None, b_norm2: Column | None = None) -> Column:
    """abs(1 - cosine); 1 where a norm is 0. Squared norms can be given."""
    norms = (norm2(a, dims) if a_norm2 is None else a_norm2) * (norm2(b, dims) if b_norm2 is None else b_norm2)
    return F.when(norms > 0, F.abs(1 - dot(a, b, dims) / F.sqrt(norms))).when(norms.isNotNull(), 1.0)


def distance(a: Column, b: Column, measure: Measure | str = Measure.EUCLIDEAN, dims: int | None = None) -> Column:
    return l2_squared(a, b, dims) if Measure.of(measure) is Measure.EUCLIDEAN else cosine(a, b, dims)


def half_point(a: Column, b: Column) -> Column:
    """The point 0.4 of the way from a to b."""
    return F.zip_with(widen(a), widen(b), lambda x, y: x + F.lit(HALF) * (y - x))


def slack(nn1: Column | float, tau: float, measure: Measure | str) -> Column:
    """Additive slack of the stopping rule: the mean nearest distance serves building, the largest querying."""
    scaled = F.lit(nn1) * tau if isinstance(nn1, float) else nn1 * tau
    return scaled * scaled if Measure.of(measure) is Measure.EUCLIDEAN else scaled


def _folds() -> dict[str, str]:
    """SQL of a distance of arrays a and b, by measure."""
    fold = "aggregate(zip_with(a, b, (x, y) -> {f}), 0D, (s, x) -> s + x)"
    dot_, aa, bb = fold.format(f="x * y"), "aggregate(a, 0D, (s, x) -> s + x * x)", "aggregate(b, 0D, (s, x) -> s + x * x)"
    return {"euclidean": fold.format(f="(x - y) * (x - y)"), "cosine": f"CASE WHEN {aa} * {bb} > 0 THEN abs(1 - {dot_} / sqrt({aa} * {bb})) WHEN {aa} * {bb} <= 0 THEN 1D END"}


def register_knn(spark: SparkSession, name: str, view: str, measure: Measure | str = Measure.EUCLIDEAN, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """A table function name(query, k) over a view, for SQL: SELECT q.*, n.* FROM queries q, LATERAL name(q.embedding, 10) n.

    Rows (vec_id, dist, rk) by (dist, vec_id). A plan of Catalyst's own: all queries of the statement against all rows of the view.
    """
    if not all(x.replace("_", "a").isalnum() for x in (name, view, id_col, vec_col)):
        raise ValueError("names must be plain identifiers")
    pairs = f"SELECT CAST({id_col} AS BIGINT) AS vec_id, {_folds()[Measure.of(measure).value]} AS dist FROM (SELECT {id_col}, CAST({vec_col} AS ARRAY<DOUBLE>) AS a, query AS b FROM {view} WHERE {vec_col} IS NOT NULL)"
    ranked = f"SELECT vec_id, dist, CAST(row_number() OVER (ORDER BY dist, vec_id) AS BIGINT) AS rk FROM ({pairs}) WHERE dist IS NOT NULL AND NOT isnan(dist)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, k INT) RETURNS TABLE(vec_id BIGINT, dist DOUBLE, rk BIGINT) RETURN SELECT vec_id, dist, rk FROM ({ranked}) WHERE rk <= k")


def register_functions(spark: SparkSession) -> None:
    """vec_l2, vec_cosine, vec_norm2 and vec_half for SQL, as expressions that Catalyst inlines."""
    fold = "aggregate(zip_with({a}, {b}, (x, y) -> {f}), 0D, (s, x) -> s + x)"
    product = lambda a, b: fold.format(a=a, b=b, f="x * y")
    pair = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    for name, arguments, kind, body in (
        ("vec_l2", pair, "DOUBLE", fold.format(a="a", b="b", f="(x - y) * (x - y)")),
        ("vec_norm2", "a ARRAY<DOUBLE>", "DOUBLE", product("a", "a")),
        ("vec_cosine", pair, "DOUBLE", f"CASE WHEN {product('a', 'a')} * {product('b', 'b')} > 0 THEN abs(1 - {product('a', 'b')} / sqrt({product('a', 'a')} * {product('b', 'b')})) WHEN {product('a', 'a')} * {product('b', 'b')} <= 0 THEN 1D END"),
        ("vec_half", pair, "ARRAY<DOUBLE>", f"zip_with(a, b, (x, y) -> x + {HALF}D * (y - x))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
