"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

Paragraphs are the lines of a text with a visible character. One of over LONG code points is cut further, at places that
its words alone decide (LONG_CUT), so that an edit changes the pieces around it only; one without such a place stays whole.
A digest has 39 bits of the paragraph's hash and 17 check bits made of those.

A sketch deals the digests over blocks by hash, about BLOCK_DIGESTS to each, so that work per digest stays the same in long
texts. A block has three tables of cells, and each digest goes into one cell of each table. A cell is one number: it counts
its digests in the bits from ONE up and sums them below, so cells subtract as they are, and a cell that holds one digest of either
side shows it (the check bits tell it from a mixture). Blocks of two sketches subtract cell by cell, and peeling recovers the
differing digests: what a cell gives away is taken out of its other cells, and so on. If cells remain, larger tables are tried (TABLE_CELLS).

A fingerprint is a sketch as text. Every block of it can be peeled itself, for which its tables grow too if need be; so two
fingerprints of different sizes can be compared as well: the smaller one gives its digests back, and they are dealt to as
many blocks as the larger one has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a paragraph that is cut further, and where: after a sentence whose last letter is one of the first
#: in the alphabet (or a figure or another mark), after full-width sentence ends, after words of 14 or more characters.
LONG, LONG_CUT = 250, r" (?<=[a-gA-G0-9!?][.!?|] |[^ ]{14} )|[。！？]"
WHITE = r" \t\n\u000b\f\r"
#: Cells a table holds: first try, then larger on failure. At the last size two digests always differ in some cell.
TABLE_CELLS = (8, 16, 64, 512, 8192)
BLOCK_DIGESTS = 4
CHECK_BITS, PLACE_BITS, ROUNDS = 17, 13, 24
ONE = 1 << 56


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs (null text: none)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    parts = F.flatten(F.transform(lines, lambda p: F.when(F.length(p) > LONG, F.split(p, LONG_CUT, -1)).otherwise(F.array(p))))
    parts = F.filter(parts, lambda p: F.btrim(p, F.lit(WHITE.encode().decode("unicode_escape"))) != "")
    hashes = F.transform(parts, lambda p: F.shiftrightunsigned(F.xxhash64(p), 64 - 3 * PLACE_BITS))
    return F.array_distinct(F.transform(hashes, lambda h: F.shiftleft(h, CHECK_BITS) + F.xxhash64(h).bitwiseAND(F.lit((1 << CHECK_BITS) - 1))))


def _let(value: str, name: str, body: str) -> str:
    """body with name standing for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def blocks_of(n: str) -> str:
    """SQL of the number of blocks for n digests, a power of two."""
    return f"CAST(power(2, greatest(0, ceil(log2(greatest({n}, 1) / {BLOCK_DIGESTS}.0)))) AS INT)"


def deal_sql(keys: str, blocks: str) -> str:
    """SQL of the digests dealt to the blocks, an array for each; in two steps, each to about the square root of their number."""
    part = lambda of, count, by, shift: f"transform(sequence(0, {count} - 1), i -> filter({of}, x -> (shiftright(xxhash64(x, 2) & 2147483647L, {shift}) & ({count} - 1)) = i))"
    low = f"CAST(power(2, floor(log2({blocks}) / 2)) AS INT)"
    two = f"flatten(transform({part(keys, '(g div l)', 'i', 'CAST(log2(l) AS INT)')}, ks -> {part('ks', 'l', 'j', '0')}))"
    return _let(blocks, "g", f"IF(g = 1, array({keys}), {_let(low, 'l', two)})")


#: Shift and number of each cell of a block at the first size.
_FIRST = "array(" + ", ".join(f"named_struct('s', {CHECK_BITS + PLACE_BITS * t}, 'p', {p}L)" for t in range(3) for p in range(TABLE_CELLS[0])) + ")"
_LARGER = f"array({', '.join(map(str, TABLE_CELLS[1:]))})"
_NONE = "CAST(array() AS array<bigint>)"


def _here(key: str, m: str) -> str:
    """SQL: whether a digest belongs to cell t (a struct of _FIRST, or at a larger size its number)."""
    if m == str(TABLE_CELLS[0]):
        return f"(shiftright({key}, t.s) & {TABLE_CELLS[0] - 1}L) = t.p"
    return f"(shiftright({key}, {CHECK_BITS} + {PLACE_BITS} * CAST(t div {m} AS INT)) & ({m} - 1)) = t % {m}"


def _over_cells(m: str, value: str) -> str:
    return f"transform({_FIRST if m == str(TABLE_CELLS[0]) else f'sequence(0, 3 * {m} - 1)'}, t -> {value})"


def cells_sql(keys: str, m: str) -> str:
    """SQL of a block's cells, table by table, m a table."""
    return _over_cells(m, f"aggregate({keys}, 0L, (a, x) -> IF({_here('x', m)}, a + x + {ONE}L, a))")


def peel_sql(cells: str, m: str) -> str:
    """SQL of the signed contents (digest + ONE, or minus that) recovered from a block's cells; null if cells remain."""
    low = (1 << CHECK_BITS) - 1
    held = f"(abs(c) & {ONE - 1}L)"
    pure = f"array_distinct(filter(st.cells, c -> abs(c) >= {ONE}L AND abs(c) < {2 * ONE}L AND (xxhash64(shiftright({held}, {CHECK_BITS})) & {low}L) = (abs(c) & {low}L)))"
    # Empty cells stay, pure ones end empty; only mixtures are worked on.
    less = f"IF(c = 0L OR array_contains(p, c), 0L, aggregate(p, c, (a, y) -> IF({_here(f'(abs(y) & {ONE - 1}L)', m)}, a - y, a)))"
    taken = f"zip_with(st.cells, {_FIRST if m == str(TABLE_CELLS[0]) else f'sequence(0, 3 * {m} - 1)'}, (c, t) -> {less})"
    state = "named_struct('cells', {}, 'found', {}, 'more', {})"
    # A round that finds nothing ends it, as does one whose digests make up the first table: then all others do too.
    whole = f"aggregate(slice(st.cells, 1, {m}), 0L, (a, c) -> a + c) = aggregate(p, 0L, (a, c) -> a + c)"
    step = _let(pure, "p", f"IF(size(p) = 0, {state.format('st.cells', 'st.found', 'false')}, IF({whole}, {state.format(_NONE, 'concat(st.found, p)', 'false')}, {state.format(taken, 'concat(st.found, p)', 'true')}))")
    return (
        f"aggregate(sequence(1, {ROUNDS}), {state.format(cells, _NONE, 'true')}, (st, r) -> IF(st.more, {step}, st), "
        "st -> IF(forall(st.cells, c -> c = 0L), st.found, NULL))"
    )


def sketch_sql(blocks: str) -> str:
    """SQL of a sketch: the cells of each block, at the first size that gives all its digests back; none for an empty block."""
    def give(m: str, otherwise: str) -> str:
        # In a sketch alone a cell below 2 * ONE has one digest at most: mostly each digest has such a cell.
        clear = f"size(array_distinct(filter(c, v -> v <> 0 AND v < {2 * ONE}L))) = size(ks)"
        return _let(cells_sql("ks", m), "c", f"IF({clear} OR {peel_sql('c', m)} IS NOT NULL, c, {otherwise})")

    larger = f"aggregate({_LARGER}, {_NONE}, (got, m) -> IF(size(got) > 0, got, {give('m', _NONE)}))"
    return f"transform({blocks}, ks -> IF(size(ks) = 0, {_NONE}, {give(str(TABLE_CELLS[0]), larger)}))"


def difference_sql(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    """SQL of the number of digests that one of two texts has alone, from their sketches, equally many blocks each.

    a and b are the digests as dealt to the blocks, which larger tables are made of when peeling fails.
    """
    first = 3 * TABLE_CELLS[0]
    # Cells of an empty block are all 0.
    gap = "IF(size(u) = 0, transform(v, y -> -y), IF(size(v) = 0, u, zip_with(u, v, (x, y) -> x - y)))"
    small = f"IF(size(u) <= {first} AND size(v) <= {first}, size({peel_sql(gap, str(TABLE_CELLS[0]))}), NULL)"
    wide = f"zip_with({cells_sql('element_at(ka, i + 1)', 'm')}, {cells_sql('element_at(kb, i + 1)', 'm')}, (x, y) -> x - y)"
    # size() of null is -1 or null by setting; both mean failure.
    larger = f"aggregate({_LARGER}, -1, (got, m) -> IF(got >= 0, got, coalesce(size({peel_sql(wide, 'm')}), -1)))"
    sure = f"coalesce(nullif({small}, -1), nullif({larger}, -1), CAST(raise_error('digests that no table tells apart') AS INT))"
    block = _let("element_at(sa, i + 1)", "u", _let("element_at(sb, i + 1)", "v", f"IF(u = v, 0, {sure})"))
    inner = f"aggregate(transform(sequence(0, size(sa) - 1), i -> {block}), 0, (x, y) -> x + y)"
    for name, value in (("sb", sketch_b), ("sa", sketch_a), ("kb", b), ("ka", a)):
        inner = _let(value, name, inner)
    return inner


def likeness(a: str, b: str) -> Column:
    """Shared digests over all digests of two sketches (structs n, blocks, sketch), from the peeled difference; two empty ones: 1."""
    def grown(x: str) -> str:
        """The sketch dealt anew to as many blocks as the other's, from what it gives back when peeled."""
        anew = f"named_struct('n', {x}.n, 'blocks', ks, 'sketch', {sketch_sql('ks')})"
        return f"IF(size({x}.blocks) = g, {x}, {_let(deal_sql(f'flatten({x}.blocks)', 'g'), 'ks', anew)})"

    differ = difference_sql("p.blocks", "q.blocks", "p.sketch", "q.sketch")
    d = _let(f"greatest(size({a}.blocks), size({b}.blocks))", "g", _let(grown(a), "p", _let(grown(b), "q", differ)))
    return F.expr(f"IF({a}.n + {b}.n = 0, 1D, {_let(d, 'd', f'({a}.n + {b}.n - d) / CAST({a}.n + {b}.n + d AS DOUBLE)')})")


def _sketched(df: DataFrame, column: str, into: str) -> DataFrame:
    """Adds the struct (n, blocks, sketch) of a text column."""
    keys = f"_keys{into}"
    df = df.withColumn(keys, digests(F.col(column)))
    dealt = deal_sql(keys, blocks_of(f"size({keys})"))
    made = _let(dealt, "b", f"named_struct('n', size({keys}), 'blocks', b, 'sketch', {sketch_sql('b')})")
    return df.withColumn(into, F.expr(made)).drop(keys)


def fingerprint(sketched: str) -> Column:
    """A sketch as text: the number of digests, then the blocks, their cells in hexadecimal (nothing for 0)."""
    block = "array_join(transform(c, v -> IF(v = 0, '', hex(v))), ',')"
    return F.expr(f"concat({sketched}.n, ':', array_join(transform({sketched}.sketch, c -> {block}), ';'))")


def _id_ranges(ids: DataFrame, bucket_rows: int) -> tuple[list[int], list[int], int, int]:
    """Quantiles of the ids, into how many hash ranges the rows at each of them are cut, the cuts between two, and those of null ids."""
    whole = ids.agg(F.count("_id").alias("n"), F.count_if(F.col("_id").isNull()).alias("none"), F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.percentile_approx("_id", [k / 256 for k in range(1, 256)], 1000).alias("q")).head()
    found = [whole["lo"], *whole["q"], whole["hi"]] if whole["n"] else [0]
    edges = sorted(set(found))
    # An id that stands for several quantiles has as many 256ths of the rows.
    heavy = [max(1, -(-max(0, found.count(e) - 1) * whole["n"] // (256 * bucket_rows))) for e in edges]
    return edges, heavy, max(1, whole["n"] // (bucket_rows * len(edges))), max(1, whole["none"] // bucket_rows)


def with_next(docs: DataFrame, id_column: str, text: str, bucket_rows: int = 1000) -> DataFrame:
    """Rows (_range, _halo, _id, _hash, _text, _next): the text of the next row in descending id order, after the last the first.

    Rows with equal ids follow by a hash of their text, then by the text; null ids come last. Rows are sorted inside ranges of
    about bucket_rows each: ids between quantiles are cut evenly, the rows at a quantile and those without an id by the
    hash. The first row of a range also goes, marked _halo, to the range before; marked rows are to be dropped.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    edges, heavy, cuts, none = _id_ranges(rows.select("_id"), bucket_rows)
    width = max(cuts, *heavy)
    lows = F.lit(edges)
    at = F.size(F.filter(lows, lambda e: e <= F.col("_id"))) - 1
    low, high = (F.get(lows, F.col("_at") + k).cast("double") for k in (0, 1))
    hashed = lambda n: F.floor((F.col("_hash").cast("double") / F.lit(2.0**64) + 0.5) * n).cast("long")
    between = F.least(F.lit(cuts - 1), F.floor((F.col("_id") - low) * F.lit(cuts) / F.greatest(high - low, F.lit(1.0)))).cast("long")
    many = F.get(F.lit(heavy), F.col("_at"))
    # Higher ranges come first: larger ids, at one id smaller hashes; even slots hold a quantile's own id, odd ones the ids up to the next.
    at_edge = F.lit(2 * width) * F.col("_at") + many - 1 - F.least(many - 1, hashed(many))
    inside = F.lit(2 * width) * F.col("_at") + F.lit(width) + F.coalesce(between, F.lit(0))
    number = F.when(F.col("_id").isNull(), -1 - F.least(F.lit(none - 1), hashed(F.lit(none)))).when(F.col("_id") == F.get(lows, F.col("_at")), at_edge).otherwise(inside)
    numbered = rows.withColumn("_at", at.cast("int")).withColumn("_range", number.cast("long")).drop("_at")
    place = F.struct(F.bitwise_not("_id").alias("i"), F.col("_hash").alias("h"))
    tops = numbered.groupBy("_range").agg(F.min(place).alias("_top"))
    # One row per range: the range that reads a range's first row is the next higher one; the lowest reads the highest's.
    order = Window.orderBy("_range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = tops.withColumn("_to", F.coalesce(F.lead("_range").over(order), F.first("_range").over(whole)))
    # Three numbers per range: few enough to send along, or else joined like any table.
    links = F.broadcast(links) if 2 * width * len(edges) + none <= 500_000 else links
    top_rows = numbered.join(links, ["_range"]).where(F.col("_top").eqNullSafe(place)).groupBy("_to").agg(F.min("_text").alias("_text"))
    halo = top_rows.select(F.col("_to").alias("_range"), F.lit(True).alias("_halo"), F.lit(None).cast("bigint").alias("_id"), F.lit(None).cast("bigint").alias("_hash"), "_text")
    both = numbered.select("_range", F.lit(False).alias("_halo"), "_id", "_hash", "_text").unionByName(halo)
    return both.withColumn("_next", F.lead("_text").over(_reading_order()))


def _reading_order() -> Window:
    return Window.partitionBy("_range").orderBy("_halo", F.col("_id").desc_nulls_last(), "_hash", "_text")


def compare(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with the first floor(n_chars / 2) code points of the next document (or
    all of it) in place of its own last ones. Null texts count as empty; empty documents have empty fingerprints
    and are alike. Repeated rows each get their own result. A text of any length takes work in proportion to its paragraphs, or nearly so.
    """
    rows = _sketched(with_next(docs, id_column, text), "_text", "_a")
    rows = rows.withColumn("_x", F.lead("_a").over(_reading_order())).where("NOT _halo")
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.length("_text") - half), F.substring("_next", F.lit(1), half))
    rows = _sketched(rows.select("_id", F.length("_text").cast("long").alias("n_chars"), edited.alias("_edited"), "_a", "_x"), "_edited", "_e")
    return rows.select(
        F.col("_id").alias(id_column), "n_chars", F.col("_edited").alias("edited"), fingerprint("_a").alias("fingerprint"), fingerprint("_e").alias("edited_fingerprint"),
        likeness("_a", "_e").alias("near_edited"), likeness("_a", "_x").alias("near_next"),
    )
