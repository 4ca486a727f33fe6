"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph pieces.

A text's paragraphs (lines) are cut into pieces after sentences, at about every second one:
the letter before the full stop decides. So pieces are of like lengths, and a change, also one that
moves what follows, leaves all other pieces as they are. What has no such place is cut
every LONGEST characters. The distinct pieces are hashed to 64 bits.
A sketch has three rows of cells; a digest goes into one cell of each row, which
holds a signed count, the XOR of the digests and the XOR of their check hashes.
The sketches of two versions are subtracted cell by cell, so that what both have
cancels out, and peeling then recovers the digests that differ: a cell with count
+1 or -1 whose check fits holds one digest, which is taken out of its other cells.

The fingerprint is the sketch of BASE cells. Where peeling fails, it is tried
again larger: the digests are dealt by their bits, FAN ways at a time, until at most GROUP are together,
each group with a sketch of LARGER[0] cells, then of more; so the work grows nearly in proportion to
the text. What fails even so is compared exactly.
Likeness is 1 less the share of the pieces of both texts that differ.

All of it is column expressions: one pass, and no Python at the executors.

Edge cases: a null text is the empty one, which has no pieces; two empty texts have
likeness 1; equal texts have equal fingerprints; pieces that recur in a text count
once. The next document is by ascending id, null ids first, rows of equal ids by
their text; the last one's next is the first, and a lone document is its own next.
Rows without an id, or with the same one, are in one range, however many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import table
from loomgraph.runtime import partitions

#: Where a paragraph's pieces end, and their greatest length in characters.
ENDS, LONGEST = "\\\\n|(?<=[a-n][.!?])", 256
#: Cells of the fingerprint, and of a group's sketch in the further attempts; multiples of three.
BASE, LARGER = 12, (18, 54)
#: Digests of both texts in a group at most, and how many ways and how often they are dealt.
GROUP, FAN, DEALS = 10, 4, 14
ROUNDS = 12
#: Boundaries of the ranges of ids are sent to the driver: two a partition, and no more than this.
MOST_RANGES = 65_536
FOUND = "array<struct<n:int,k:bigint>>"


def digests(text: str) -> str:
    """SQL: the distinct piece digests of a non-null text expression."""
    long_ = f"transform(sequence(0, (length(p) - 1) div {LONGEST}), i -> xxhash64(substring(p, cast(1 + i * {LONGEST} as int), {LONGEST})))"
    return f"array_distinct(flatten(transform(array_remove(split({text}, '{ENDS}'), ''), p -> if(length(p) <= {LONGEST}, array(xxhash64(p)), {long_}))))"


def entries(array: str, sign: int | str, count: int) -> str:
    """SQL: the digests with their sign s, check hash x, and a cell in each row of a sketch of `count` cells."""
    return placed(f"transform({array}, d -> named_struct('d', d, 's', {sign}, 'x', xxhash64(d, 7L)))", count)


def placed(signed: str, count: int) -> str:
    """SQL: digests with sign and check (d, s, x), with a cell in each row of a sketch of `count` cells."""
    place = lambda j: f"cast(pmod(shiftright(e.d, {14 * j}) & 16383, {count // 3}) as int)"
    return f"transform({signed}, e -> named_struct('d', e.d, 's', e.s, 'x', e.x, 'p', {place(0)}, 'q', {place(1)}, 'r', {place(2)}))"


def cells(made: str, count: int) -> str:
    """SQL: the sketch of an array of entries, its three rows one after the other."""
    add = "(a, e) -> named_struct('n', a.n + e.s, 'k', a.k ^ e.d, 'x', a.x ^ e.x)"
    row = lambda f: f"transform(sequence(0, {count // 3 - 1}), c -> aggregate(filter(made, e -> e.{f} = c), named_struct('n', 0, 'k', 0L, 'x', 0L), {add}))"
    return f"element_at(transform(array({made}), made -> concat({row('p')}, {row('q')}, {row('r')})), 1)"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k, 'x', p.x ^ q.x))"


def peeled(sketch: str, count: int) -> str:
    """SQL: the digests that differ, each with its sign, by peeling a subtracted sketch; null if it fails."""
    w = count // 3
    found = "array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 and c.x = xxhash64(c.k, 7L)), c -> named_struct('n', c.n, 'k', c.k)))"
    place = lambda j: f"cast(pmod(shiftright(c.k, {14 * j}) & 16383, {w}) as int) + {j * w}"
    pure = f"transform({found}, c -> named_struct('n', c.n, 'k', c.k, 'x', xxhash64(c.k, 7L), 'p', {place(0)}, 'q', {place(1)}, 'r', {place(2)}))"
    out = "(a, p) -> named_struct('n', a.n - p.n, 'k', a.k ^ p.k, 'x', a.x ^ p.x)"
    taken = f"transform(t.cells, (c, i) -> aggregate(filter(pure, p -> i = p.p or i = p.q or i = p.r), c, {out}))"
    got = "concat(t.got, transform(pure, p -> named_struct('n', p.n, 'k', p.k)))"
    turn = f"if(size(pure) = 0, named_struct('cells', t.cells, 'got', t.got, 'on', false), named_struct('cells', {taken}, 'got', {got}, 'on', true))"
    step = f"(s, r) -> if(s.on, aggregate(array({pure}), s, (t, pure) -> {turn}), s)"
    rounds = f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {sketch}, 'got', cast(array() as {FOUND}), 'on', true), {step})"
    done = "forall(z.cells, c -> c.n = 0 and c.k = 0L and c.x = 0L)"
    return f"element_at(transform(array({rounds}), z -> if({done}, z.got, cast(null as {FOUND}))), 1)"


def dealt(signed: str) -> str:
    """SQL: digests (d, s, x) in groups of GROUP at most, or of those with the same 2 * DEALS bits."""
    groups = f"array({signed})"
    for level in range(DEALS):
        ways = ", ".join(f"filter(g, e -> (shiftrightunsigned(e.d, {62 - 2 * level}) & {FAN - 1}) = {j})" for j in range(FAN))
        split = f"if(size(g) <= {GROUP}, array(g), filter(array({ways}), h -> size(h) > 0))"
        # a level is looked at only where a group is too large: most texts need two or three
        groups = f"aggregate(array({groups}), cast(null as array<array<struct<d:bigint,s:int,x:bigint>>>), (z, gs) -> if(exists(gs, g -> size(g) > {GROUP}), flatten(transform(gs, g -> {split})), gs))"
    return groups


def differing(a: str, b: str, base_a: str, base_b: str) -> str:
    """SQL: the digests that are in one of the arrays a and b only: sign (+1 in a) and digest."""
    signed = lambda x, sign: f"transform({x}, d -> named_struct('d', d, 's', {sign}, 'x', xxhash64(d, 7L)))"
    tries = ", ".join(peeled(cells(placed("own", n), n), n) for n in LARGER)
    plain = lambda s: f"transform(filter(own, e -> e.s = {s}), e -> e.d)"
    exact = " , ".join(f"transform(array_except({plain(s)}, {plain(-s)}), d -> named_struct('n', {s}, 'k', d))" for s in (1, -1))
    one = f"coalesce({tries}, concat({exact}))"
    whole = f"flatten(transform({dealt(f'concat({signed(a, 1)}, {signed(b, -1)})')}, own -> {one}))"
    # a sketch gives back no more digests than it has cells: do not try where the counts alone differ by more
    return f"coalesce(if(abs(size({a}) - size({b})) > {BASE}, null, {peeled(subtract(base_a, base_b), BASE)}), {whole})"


def likeness(found: str, a: str, b: str) -> Column:
    """1 less the share of the pieces a and b that are among the recovered ones."""
    total = f"(size({a}) + size({b}))"
    return F.expr(f"if({total} = 0, 1.0D, 1.0D - size({found}) / cast({total} as double))")


def rendered(base: str, array: str) -> Column:
    """The fingerprint as text: the number of pieces, then each cell's count, digests and checks."""
    cell = "concat(lpad(hex(c.n & 255), 2, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.x), 16, '0'))"
    return F.expr(f"lower(concat(cast(size({array}) as string), ':', array_join(transform({base}, c -> {cell}), '')))")


def _bucket(bounds: list[int], key: str) -> str:
    """SQL: how many of the ascending boundaries are at or below the key, by binary search."""
    if not bounds:
        return "0"
    bits = len(bounds).bit_length()
    padded = ", ".join(f"{x}L" for x in bounds) + ", null" * ((1 << bits) - len(bounds))
    return f"aggregate(sequence({bits - 1}, 0, -1), 0, (low, j) -> if(element_at(array({padded}), low + shiftleft(1, j)) <= {key}, low + shiftleft(1, j), low))"


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __t (the text, null as empty), __key, __range and __last. Ids are cut into
    ranges of near equal counts; the first document of each range is also sent, with
    __last = 1, to the end of the range before, so no task holds all."""
    spark = docs.sparkSession
    least = -(1 << 63)
    keyed = docs.withColumn("__key", F.coalesce(F.col(id_col).cast("long"), F.lit(least)))
    n = min(MOST_RANGES, 2 * partitions(spark))
    ids = keyed.select("__key")
    at = ids.agg(F.percentile_approx("__key", [i / n for i in range(1, n)] or [0.5], 16 * n)).first()[0] if n > 1 else []
    bounds = sorted({b for b in at or [] if b > least})
    ranges = keyed.withColumn("__range", F.expr(_bucket(bounds, "__key")))
    firsts = sorted((r["__range"], r["k"]) for r in ids.withColumn("__range", F.expr(_bucket(bounds, "__key"))).groupBy("__range").agg(F.min("__key").alias("k")).collect())
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    listed = ", ".join(f"(cast('{k}' as bigint), {r})" for k, r in before or [(0, 0)])
    sent = F.broadcast(spark.sql(f"select * from values {listed} as t(__key, __to)"))  # a row a range: bounded
    own = F.struct(F.col("__range").alias("r"), F.lit(0).alias("last"))
    copy = F.struct(F.col("__to").alias("r"), F.lit(1).alias("last"))
    return (
        ranges.join(sent, "__key", "left")
        .withColumn("__go", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
        .withColumns({"__range": F.col("__go.r"), "__last": F.col("__go.last"), "__t": F.coalesce(text_col, F.lit(""))})
        .drop("__go", "__to")
    )


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id, n_chars, the edited text's hash, both fingerprints, the likenesses, and the
    recovered digests of the pieces that the edit removed and added.

    The edited text: the last quarter of the characters is replaced by the first as
    many (or all) of the next document.
    """
    rows = with_next(docs.select(id_col, text_col), id_col, text_col).drop(text_col)
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "__range")
    rows = rows.withColumn("__d", F.expr(digests("__t"))).withColumn("__c", F.expr(cells(entries("__d", 1, BASE), BASE)))
    order = Window.partitionBy("__range").orderBy("__last", "__key", "__t")
    ahead = rows.withColumns({f"__next{c}": F.lead(f"__{c}").over(order) for c in "tdc"}).where("__last = 0")
    edited = ahead.withColumn("n_chars", F.length("__t").cast("long")).withColumn(
        "__e", F.expr("concat(left(__t, cast(n_chars - n_chars div 4 as int)), left(__nextt, cast(n_chars div 4 as int)))")
    )
    # the edited text is used several times: made once
    edited = edited.withColumn("__ed", F.expr(digests("__e"))).withColumn("__ec", F.expr(cells(entries("__ed", 1, BASE), BASE)))
    edited = edited.withColumns({"__fe": F.expr(differing("__d", "__ed", "__c", "__ec")), "__fn": F.expr(differing("__d", "__nextd", "__c", "__nextc"))})
    only = lambda found, sign: F.transform(F.filter(found, lambda x: x["n"] == sign), lambda x: x["k"])
    return edited.select(
        id_col,
        "n_chars",
        F.sha2(F.col("__e").cast("binary"), 256).alias("edited_sha256"),
        rendered("__c", "__d").alias("fingerprint"),
        rendered("__ec", "__ed").alias("edited_fingerprint"),
        likeness("__fe", "__d", "__ed").alias("near_edited"),
        likeness("__fn", "__d", "__nextd").alias("near_next"),
        only("__fe", 1).alias("removed"),
        only("__fe", -1).alias("added"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents")).drop("removed", "added")
