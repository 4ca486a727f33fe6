"""Near copies by an exact set-similarity join: texts whose sets of SHINGLE-word shingles
have a Jaccard similarity of at least 4/5 are linked, and no such link is lost.

First, the covering tables of `simhash` over the sets' fingerprints give candidates within its radius:
most copies, at little cost. No fixed radius reaches every pair of that similarity (64 bits differ in
10 on average, and in more than any radius now and then), so the exact join completes the links.

Prefixes: under any one global order of the shingles, two sets of that similarity share
one of the first n - ceil(0.8 n) + 1 shingles of both. The order puts shingles that are
common in a sample of the texts last; it decides the work only, never the result.

Work: equal sets are merged first. A bucket (the sets with a shingle in their prefix) of two is a pair,
as most are. Larger ones are compared with one of their members, which makes at most a pair for each entry,
and then go on without it, as long as they are of several components; once few are left to compare, with all
pairs across components. Sizes, places in the prefix and a lower bound of the difference, by sketches of each
set's parities, are checked before, and whole sets after, so that each link is exact. A sketch of 256 bits goes
with each entry; distinct pairs then meet sketches of twice as many bits as a set has elements, so that about
those that are similar are left to be verified, however large the sets. In a group of near copies those are still as
many as the square of its size, so of all pairs across components a spanning forest is verified first, the likeliest pairs
before others: as many as there are components at most. Then come those that are still across components, all of them.

Edge cases: null and empty texts, and texts without words, are one empty set; texts with
fewer words than a shingle are one shingle; the group's id is its smallest non-null one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import append, by_value, utf8
from loomgraph.llm.simhash import OUT, SEED, link, majority, shingles
from loomgraph.operators.components import connected_components
from loomgraph.runtime import cut_flat as cut
from loomgraph.runtime import release

SHINGLE = 5
#: Texts that the order of the shingles is learned from (a tenth of all at most), and common shingles at most.
SAMPLE, COMMON = 20_000, 400_000
#: Keys that are sent to all tasks instead of shuffling the other side.
SENT = 500_000
#: Rounds with one member of each bucket before all pairs are compared: at least, if the buckets are large, and at most.
EARLY, ROUNDS = 3, 6
#: Pairs across components for each entry, at which all of them are compared before that.
PAIRS = 256
#: Of all shingles, a SHARE-th is about what a part of the pairs moves to be verified; pairs that are not worth parts.
SHARE, FEW = 8, 1000
#: Longs of the parity sketch of an entry, and the least of a set's own; bits of the latter for each element.
SKETCH, WIDTH = 4, 2
#: Pairs of which a task takes a forest by itself, and forests before all pairs that are left.
LOCAL, FORESTS = 250_000, 3


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, SEED) for x in shingles(text, k)], "<u8"))


def parity_of(found: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """Of each value of the hashes' low bits, whether an odd number of them has it, as bits of so many longs (a power of two).

    The sketches of two sets differ in at most as many bits as the sets have elements that are not common.
    The halves of a sketch, by exclusive or, are the sketch of half the longs.
    """
    odd = np.bincount((found & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide_of(found: np.ndarray) -> np.ndarray:
    """The sketch of WIDTH times as many bits as the set has elements, up to the next power of two."""
    return parity_of(found, max(SKETCH, 1 << (max(0, WIDTH * found.size - 1) >> 6).bit_length()))


def prefix_of(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The part of a set that a similar one must meet; `common` is ascending, rank its counts."""
    n = found.size
    if not n:
        return found
    weight = np.zeros(n, np.int64)
    if common.size:
        at = np.minimum(np.searchsorted(common, found), common.size - 1)
        weight = np.where(common[at] == found, rank[at], 0)
    return found[np.lexsort((found, weight))][: n - (4 * n + 4) // 5 + 1]


def _sets(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with the set in place of the text."""

    def compute(batch: pa.RecordBatch) -> list:
        return [pa.array([shingle_set(t).view("<i8") for t in utf8(batch, text_col)], pa.list_(pa.int64()))]

    return append(docs, compute, [T.StructField(name, T.ArrayType(T.LongType()))], (text_col,))


def _common(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the sampled texts hold, and how many do."""
    share = min(0.1, SAMPLE / max(1, docs.count()))
    some = docs.select(text_col).where(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < int(share * (1 << 20)))).distinct()
    counts = _sets(some, text_col, "s").select(F.explode("s").alias("t")).groupBy("t").count().where("count > 2")
    rows = counts.orderBy(F.desc("count"), "t").limit(COMMON).toPandas()
    found, n = rows["t"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(found)
    return found[order], n[order]


def _sent(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, to be sent to all tasks if it is small. most: what it has at most, if known, so that small ones need no count."""
    return F.broadcast(df) if most is not None and most <= SENT or df.count() <= SENT else df


#: Whether entries a and b of a bucket may be similar, by sizes, by what follows in both, and by sketches.
MAY = "5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) and 9 * least(a.n - a.pos, b.n - b.pos) >= 4 * (a.n + b.n)"
MAY += " and 9 * (" + " + ".join(f"bit_count(a.odd[{i}] ^ b.odd[{i}])" for i in range(SKETCH)) + ") <= a.n + b.n"


#: A lower bound of the difference of sets a and b by their own sketches; of similar sizes one is twice as long at most, and is folded.
APART = "aggregate(sequence(0, least(size(a.w), size(b.w)) - 1), 0, (d, i) -> d + bit_count(get(a.w, i) ^ get(b.w, i)"
APART += " ^ if(size(a.w) > size(b.w), get(a.w, i + size(b.w)), 0L) ^ if(size(b.w) > size(a.w), get(b.w, i + size(a.w)), 0L)))"
#: Whether sets a and b may be similar, by sizes and that bound.
WIDE = f"5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) and 9 * {APART} <= a.n + b.n"


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The distinct pairs (src, dst) of sets that may be similar by WIDE; far: the bound, as a share of both sets. Other columns stay."""
    own = reps.select("sid", "n", "w")
    met = pairs.distinct().join(own.alias("a"), F.expr("src = a.sid")).select(*pairs.columns, F.struct("n", "w").alias("a"))
    met = met.join(own.select("sid", F.struct("n", "w").alias("b")), F.expr("dst = sid"))
    return met.where(WIDE).select(*pairs.columns, F.expr(f"{APART} / (a.n + b.n)").alias("far"))


def spanning(u: np.ndarray, v: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the edges (u, v) of a spanning forest, those of least `far` first."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root, out = at[: u.size].tolist(), at[u.size :].tolist(), list(range(ids.size)), []
    for i in np.argsort(far, kind="stable").tolist():
        x, y = a[i], b[i]
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(i)
    return np.array(out, np.int64)


def _forest(pairs: DataFrame, n: int) -> DataFrame:
    """Of the n pairs (src, dst, u, v, far) of sets of components u and v those of a spanning forest of the components.

    Tasks leave forests of LOCAL pairs each, which are put together until one task has all, or they no longer halve.
    """

    def run(batches):
        if held := [b for b in batches if b.num_rows]:
            found = pa.Table.from_batches(held)
            yield from found.take(pa.array(spanning(*(found[c].to_numpy() for c in ("u", "v", "far"))))).combine_chunks().to_batches()

    made = []
    while True:
        parts = max(1, -(-n // LOCAL))
        out = cut((pairs.coalesce(1) if parts == 1 else pairs.repartition(parts)).mapInArrow(run, pairs.schema))
        release(*made)
        left = out.count() if parts > 1 else 0
        if parts == 1 or 2 * left > n:
            return out
        pairs, n, made = out, left, [out]


def _batches(n: int, pairs: DataFrame, reps: DataFrame) -> int:
    """Parts of the n pairs: in each, about a SHARE of all sets' shingles is moved, and its ends can be sent to all tasks."""
    if n <= FEW:
        return 1
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("sid")).groupBy("sid").count()
    moved, whole = reps.select("sid", "n").join(_sent(ends, 2 * n), "sid", "left").agg(F.sum(F.col("count") * F.col("n")), F.sum("n")).first()
    return max(1, -(-(moved or 0) * SHARE // max(1, whole or 0)), min(SHARE, -(-2 * n // SENT)))


def _similar(pairs: DataFrame, docs: DataFrame, reps: DataFrame, text_col: str, near: bool = False) -> DataFrame:
    """Of the pairs (src, dst) of sets those that are similar: those that pass WIDE, by their whole sets.
    near: they are a table of distinct ones that pass already, which stays.

    Whole sets are large beside the documents, so pairs go in parts, and what a part
    wrote is deleted before the next; the sets of src are moved once, not with each pair.
    A part is two queries: the driver keeps the plans of the last thousand, so that
    its memory grows with their number.
    """
    pairs = pairs if near else cut(_near(pairs, reps).select("src", "dst"))
    n = pairs.count()
    if not n:
        return pairs
    parts = _batches(n, pairs, reps)
    each = F.pmod(F.xxhash64("dst"), F.lit(parts))
    sizes = {0: n} if parts == 1 else {r["i"]: r["count"] for r in pairs.groupBy(each.alias("i")).count().collect()}
    found = []
    for i, size in sorted(sizes.items()):
        part = pairs.where(each == i) if parts > 1 else pairs
        ends = part.select(F.explode(F.array("src", "dst")).alias("sid")).distinct()
        texts = reps.join(_sent(ends, 2 * size), "sid", "left_semi").select("sid", "h")
        # one text of each set: texts are compared by the hash by which keep_one() tells them apart
        held = docs.select(text_col, F.xxhash64(text_col).alias("h")).join(_sent(texts, 2 * size), "h").dropDuplicates(["h", "sid"])
        sets = cut(_sets(held, text_col, "s").select("sid", "s"))
        first = sets.join(_sent(part.select(F.col("src").alias("sid")).distinct(), size), "sid", "left_semi").select(F.col("sid").alias("src"), F.col("s").alias("t"))
        both = sets.join(_sent(part.withColumnRenamed("dst", "sid"), size), "sid").join(first, "src")
        found.append(cut(both.where("9 * size(array_intersect(s, t)) >= 4 * (size(s) + size(t))").select("src", F.col("sid").alias("dst"))))
        release(sets)
    out = found[0] if len(found) == 1 else cut(reduce(DataFrame.unionByName, found))
    release(None if near else pairs, *(found if len(found) > 1 else []))
    return out


def _candidates(uniq: DataFrame) -> DataFrame:
    """Pairs (src, dst) of sets whose fingerprints are equal or linked by the covering tables."""
    one = cut(uniq.groupBy("fp").agg(F.min("sid").alias("first")))
    equal = uniq.join(_sent(one), "fp").where("sid <> first").select(F.col("first").alias("src"), F.col("sid").alias("dst"))
    left, right = one.select(F.col("fp").alias("src"), F.col("first").alias("a")), one.select(F.col("fp").alias("dst"), F.col("first").alias("b"))
    near = link(one.select("fp")).join(_sent(left), "src").join(_sent(right), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return equal.unionByName(near)


def _roots(edges: DataFrame) -> DataFrame:
    return cut(connected_components(edges).select(F.col("id").alias("sid"), F.col("component").alias("root")))


def _grown(edges: DataFrame, roots: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges with more, and the roots of both; if more is empty, what there was."""
    if more.isEmpty():
        release(more)
        return edges, roots
    out = cut(edges.unionByName(more))
    new = _roots(out)
    release(edges, more, roots)
    return out, new


def _across(near: DataFrame, forest: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of near that are not in forest, and whose sets are still of several components, with these."""
    of = lambda end: _sent(roots).select(F.col("sid").alias(end), F.col("root").alias(f"r_{end}"))
    left = near.join(_sent(forest.select("src", "dst")), ["src", "dst"], "left_anti").join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    left = left.withColumns({"u": F.coalesce("r_src", "src"), "v": F.coalesce("r_dst", "dst")}).where("u <> v")
    return cut(left.select(near.columns))


def _joined(pairs: DataFrame, edges: DataFrame, roots: DataFrame, docs: DataFrame, reps: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """edges and roots with what the pairs (src, dst) of sets of components u and v add to the components: forests first, the rest after."""
    near = cut(_near(pairs, reps))
    for _ in range(FORESTS):
        n, before = near.count(), roots
        if n <= FEW:
            break
        forest = _forest(near, n)
        edges, roots = _grown(edges, roots, _similar(forest, docs, reps, text_col, True))
        near, old = _across(near, forest, roots), near
        release(old, forest)
        if roots is before:
            break
    edges, roots = _grown(edges, roots, _similar(near, docs, reps, text_col, True))
    release(near)
    return edges, roots


def links(docs: DataFrame, reps: DataFrame, uniq: DataFrame, text_col: str, rounds: int = ROUNDS) -> DataFrame:
    """(sid, root) of the sets that are linked: the components at the threshold. Releases uniq."""
    keyed = uniq.select("sid", F.posexplode("prefix").alias("pos", "token"))
    # most shingles are of one set, and most others of two
    tokens = cut(keyed.groupBy("token").agg(F.count("*").alias("c"), F.min("sid").alias("src"), F.max("sid").alias("dst")).where("c > 1"))
    two = tokens.where("c = 2").select("src", "dst").unionByName(_candidates(uniq).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    edges = _similar(two, docs, reps, text_col)
    roots = _roots(edges)
    # sizes and sketches come to what is left
    met = cut(keyed.join(_sent(tokens.where("c > 2").select("token")), "token"))
    some = _apart(met, roots)
    rest, turn = cut(some.join(uniq.select("sid", "n", "odd"), "sid")), 0
    release(uniq, tokens, met, some)
    while not rest.isEmpty():
        # of each bucket its entries, and the component with the most of them
        shape = rest.groupBy("token", "root").count().groupBy("token").agg(F.sum("count").alias("c"), F.max(F.struct("count", "root")).alias("m"))
        shape = cut(shape.select("token", "c", F.col("m.count").alias("k"), F.col("m.root").alias("main")))
        size = shape.agg(F.sum(F.expr("(c - k) * c")), F.sum("c")).first()
        last, pivots = turn >= rounds or size[0] <= (PAIRS if turn >= EARLY else 4) * size[1], None
        if last:
            # pairs within a bucket's main component are never looked at
            held = rest.join(_sent(shape.select("token", "main")), "token")
            a, b = held.where("root <> main").alias("a"), held.alias("b")
            other = "(b.root = b.main or a.sid < b.sid) and a.root <> b.root"
        else:
            # a member of its own for each bucket, so that sets that share many buckets meet many members
            first = F.min(F.struct(F.xxhash64("sid", "token").alias("h"), "sid", "n", "odd", "pos", "root")).alias("p")
            pivots = cut(rest.groupBy("token").agg(first).select("token", "p.sid", "p.n", "p.odd", "p.pos", "p.root"))
            a, b = _sent(pivots).alias("a"), rest.alias("b")
            other = "a.sid <> b.sid and a.root <> b.root"
        pairs = a.join(b, F.expr(f"a.token = b.token and {other} and {MAY}"))
        ends, turn = [F.col("a.sid").alias("src"), F.col("b.sid").alias("dst")], turn + 1
        if last:
            edges, roots = _joined(pairs.select(*ends, F.col("a.root").alias("u"), F.col("b.root").alias("v")), edges, roots, docs, reps, text_col)
        else:
            edges, roots = _grown(edges, roots, _similar(pairs.select(*ends), docs, reps, text_col))
            # the member has met its whole bucket
            left = rest.join(_sent(pivots.select("token", "sid")), ["token", "sid"], "left_anti")
            rest, old = _apart(left, roots), rest
            release(old)
        release(pivots, shape)
        if last:
            break
    release(edges, rest)
    return roots


def _apart(rest: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries of the buckets whose sets are of several components, with these."""
    rest = rest.drop("root").join(_sent(roots), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    several = cut(rest.groupBy("token").agg(F.min("root").alias("u"), F.max("root").alias("v")).where("u <> v").select("token"))
    out = cut(rest.join(_sent(several), "token", "left_semi"))
    release(several)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), rounds: int = ROUNDS) -> DataFrame:
    """id_col and the `keep` columns of each row and its component_id: the smallest id
    reachable over links of similarity 0.8 or more."""
    held = docs.select(id_col, text_col, *(c for c in keep if c not in (id_col, text_col, *OUT)))
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, text_col))

    def compute(batch: pa.RecordBatch) -> list:
        sid, n, fp, odd, wide, prefix = [], [], [], [], [], []
        for text in utf8(batch, text_col):
            found = shingle_set(text)
            sid.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63) if found.size else 0)
            n.append(found.size)
            fp.append(majority(found))
            odd.append(parity_of(found))
            wide.append(wide_of(found))
            prefix.append(prefix_of(found, *common.value).view("<i8"))
        return [pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))]

    fields = [T.StructField("sid", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("odd", T.ArrayType(T.LongType())), T.StructField("w", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))]
    made = cut(append(held.withColumn("__h", F.xxhash64(text_col)), compute, fields, () if text_col in keep else (text_col,)))
    marked = cut(made.drop("n", "fp", "odd", "w", "prefix"))
    uniq = cut(made.groupBy("sid").agg(F.min(id_col).alias("rep"), F.min("__h").alias("h"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("odd").alias("odd"), F.first("w").alias("w"), F.first("prefix").alias("prefix")))
    release(made)
    reps = cut(uniq.select("sid", "rep", "h", "n", "w"))
    roots = links(docs, reps, uniq, text_col, rounds)
    grouped = reps.join(roots, "sid", "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"))
    linked = grouped.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = grouped.join(least, "root", "left").select("sid", F.coalesce("component_id", "rep").alias("component_id"))
    out = marked.join(labels, "sid")
    return out.select(*(c for c in held.columns if c in (id_col, *keep)), "component_id")


by_value(__name__)
