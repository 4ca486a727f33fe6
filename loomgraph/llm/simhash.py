"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints: 64 bits over the words' shingles. Tables: with a code word of
radius + 1 bits at each of the 64 positions, every non-zero vector v of radius + 1
bits gives the mask of the positions whose code word is orthogonal to v. Any
`radius` positions span less than the whole space, so some v is orthogonal to all
of them: its mask misses every bit in which two fingerprints within the radius
differ, and the two collide in that table. So no pair is lost, whatever the data.

Work: equal fingerprints are merged first. A bucket of two is a pair. Larger
buckets up to BUCKET give the edges of a spanning forest each, never all pairs.
A still larger bucket is divided by covering tables over the bits that its mask leaves
out: there, too, two fingerprints within the radius collide in some table.
What is larger even then is linked through midpoints: two
fingerprints within the radius share a value at half the radius from both, so a
row for each such value and fingerprint, grouped by value, finds the same links
in work that grows with the number of fingerprints only (2081 rows each at radius 4).

With a similarity to reach beyond the radius, keep_one() takes the groups of
`nearcopies.near_copies`: the same tables over five-word shingles give the first links, each
verified, and an exact join adds the links that the radius misses.

Edge cases: null and empty texts, and texts without words, have fingerprint zero
and link like any other; texts with fewer words than a shingle are one shingle;
repeated rows share a group; a group's id is its smallest non-null doc_id (null if
it has none); columns named like an output are replaced; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import append, by_value, table, utf8
from loomgraph.operators.components import connected_components
from loomgraph.runtime import cut, partitions

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Distinct fingerprints of a bucket that one task links by itself.
BUCKET = 4096


def shingles(text: bytes | None, k: int) -> list[bytes]:
    """The k-word shingles of a text with A-Z lower-cased, repeats included."""
    words = (text or b"").lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


#: For each byte, how its bits stand: row b has bit i of b in column i.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(text: bytes | None, k: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(x, SEED) for x in shingles(text, k)], "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number; 0 for none."""
    if not h.size:
        return 0
    if h.size < 2048:
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        octets = h.view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    bits = np.packbits(2 * ones > h.size, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = SHINGLE, name: str = "simhash", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the fingerprint of each whole text as a signed long."""

    def compute(batch: pa.RecordBatch) -> list:
        return [pa.array([simhash(t, k) for t in utf8(batch, text_col)], pa.int64())]

    return append(docs, compute, [T.StructField(name, T.LongType())], drop)


def masks(radius: int, positions: list[int] | None = None) -> list[int]:
    """The covering masks over some bit positions (default: all 64) as signed longs: 2^(radius+1) - 1 of them."""
    span = 1 << (radius + 1)
    # each non-zero code word about as often
    codes = [(i, 1 + k % (span - 1)) for k, i in enumerate(range(64) if positions is None else positions)]
    out = []
    for v in range(1, span):
        mask = sum(1 << i for i, c in codes if (c & v).bit_count() & 1)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) of the components of `values` (distinct) at the radius."""
    rest = np.sort(values.view(np.uint64))
    roots, members = [], []
    while rest.size > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and rest.size:
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                roots.append(np.full(found.size, root))
                members.append(found)
                queue.extend(found)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(roots) if roots else none).view(np.int64), (np.concatenate(members) if members else none).view(np.int64)


def _bucket_edges(buckets: DataFrame, radius: int) -> DataFrame:
    """buckets: members (an array of at most BUCKET fingerprints) a row."""

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            a, b = [], []
            for row in range(batch.num_rows):
                x, y = forest(column[row].values.to_numpy(zero_copy_only=False).copy(), radius)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a) if a else [], pa.int64()), pa.array(np.concatenate(b) if b else [], pa.int64())], names=["src", "dst"])

    return buckets.select("members").mapInArrow(run, "src long, dst long")


def _midpoint_edges(hot: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints (fp, distinct) through all values at half the radius from both."""
    if radius % 2:
        raise ValueError("midpoints are exact for an even radius only")
    # flips of up to radius / 2 bits: ascending positions, -1 standing for none
    reached = hot.select("fp", F.col("fp").alias("mid"), F.lit(-1).alias("at"))
    for _ in range(radius // 2):
        step = reached.select("fp", "mid", "at", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("to")).where("to > at or (to = -1 and at = -1)")
        flipped = F.col("mid").bitwiseXOR(F.expr("shiftleft(1L, to)"))
        reached = step.select("fp", F.when(F.col("to") >= 0, flipped).otherwise(F.col("mid")).alias("mid"), F.col("to").alias("at"))
    first = reached.groupBy("mid").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).where("first <> last")
    pairs = reached.join(first, "mid").where("fp <> first").select(F.col("first").alias("src"), F.col("fp").alias("dst")).distinct()
    return pairs


def _bucketed(keyed: DataFrame, by: list[str], radius: int, bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of the buckets (`by`) of at most `bucket` fingerprints (fp), and the rows of larger ones, None if there are none."""
    groups = cut(keyed.groupBy(*by).agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst")).where("n > 1"))
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius
    pairs = groups.where("n = 2").where(near).select("src", "dst")
    members = keyed.join(groups.where((F.col("n") > 2) & (F.col("n") <= bucket)).select(*by), by)
    small = members.groupBy(*by).agg(F.collect_list("fp").alias("members"))
    edges = pairs.unionByName(_bucket_edges(small, radius))
    big = groups.where(F.col("n") > bucket).select(*by)
    return edges, None if big.isEmpty() else keyed.join(big, by, "left_semi")


def link(uniq: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (fp) whose components are those of
    the links at the radius; each edge stands for a path of such links."""
    first = masks(radius)
    keys = lambda m: F.posexplode(F.transform(m, lambda x: F.col("fp").bitwiseAND(x)))
    longs = lambda ms: F.array(*(F.lit(m).cast("long") for m in ms))
    keyed = uniq.select("fp").repartition(partitions(uniq.sparkSession), "fp").select("fp", keys(longs(first)).alias("t", "key"))
    edges, hot = _bucketed(keyed, ["t", "key"], radius, bucket)
    if hot is None:
        return edges.distinct()
    # the members of a bucket differ in the bits outside its mask only
    inner = F.array(*(longs(masks(radius, [i for i in range(64) if not m >> i & 1])) for m in first))
    divided = hot.select("fp", "t", "key", keys(F.get(inner, F.col("t"))).alias("u", "sub"))
    more, hot = _bucketed(divided, ["t", "key", "u", "sub"], radius, bucket)
    edges = edges.unionByName(more)
    if hot is not None:
        edges = edges.unionByName(_midpoint_edges(hot.select("fp").distinct(), radius))
    return edges.distinct()


OUT = ("fingerprint", "component_id")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    radius: int = RADIUS,
    bucket: int = BUCKET,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """id_col and the `keep` columns of each row, its fingerprint (16 hex digits) and its
    component_id: the smallest id reachable over links of at most `radius` differing bits."""
    held = docs.select(id_col, text_col, *(c for c in keep if c not in (id_col, text_col, *OUT)))
    marked = cut(fingerprints(held, text_col, k, "__fp", drop=() if text_col in keep else (text_col,)))
    uniq = cut(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).alias("rep")))
    edges = link(uniq.select("fp"), radius, bucket)
    roots = connected_components(edges).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    grouped = uniq.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    linked = grouped.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = grouped.join(least, "root", "left").select(F.col("fp").alias("__fp"), F.coalesce("component_id", "rep").alias("component_id"))
    # one row for each distinct fingerprint: a hot one is only on the side of the documents
    out = marked.join(labels, "__fp")
    return out.select(*(c for c in marked.columns if c != "__fp"), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates, **options) -> DataFrame:
    """One row of each component that `find` gives: that of the smallest id (null only if all are)."""
    keys = {"__h": F.xxhash64(text_col), "__k": F.coalesce(id_col, F.lit(0)), "__n": F.isnull(id_col)}
    held = docs.withColumns(keys)
    found = find(held, id_col, text_col, keep=tuple(keys), **options)
    # of the rows that bear the group's id, those with one of their texts, and of these one
    first = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("__k", "__n", "component_id").agg(F.min("__h").alias("__h"))
    kept = held.join(first.select(*keys), [*keys], "left_semi").dropDuplicates([*keys])
    return kept.select(docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


by_value(__name__)
