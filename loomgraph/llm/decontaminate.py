"""Benchmark decontamination by training suffix arrays.

Every shard of the training texts (a run of rows of one task, bounded by its
words) gets a word-level suffix array, sorted by prefix doubling to the depth
of the longest test item. Every suffix of every test item is binary-searched in
it; the longest verbatim matches, their places and all places of the item's
windows come back with the document.

The test side is read in blocks of bounded size, each sent to all shards; a task
holds one block at a time and reads the next one from its disk. The rows of the training side are
never shuffled.

Edge cases: a null or empty text has no words and no hits; an item with fewer
words than the window is one window of all its words, an item without words
none; items with a null id mark words as hit but are not named; repeated items
count once; columns of the documents named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import by_value, table
from loomgraph.runtime import bound_batches

WINDOW = 10
#: Words of a shard's suffix array: about 80 bytes each while it is sorted.
SHARD_WORDS = 1_500_000
#: Bytes of test text that are sent to all tasks at once; more go in further blocks.
BLOCK_BYTES = 8_000_000

#: A-Z to a-z; every other ASCII character that is not a word's to a space.
_FOLD = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def test_block(items: list[tuple], window: int) -> dict:
    """The vocabulary, all suffixes and all windows of some (item_id, text) rows."""
    vocab: dict[bytes, int] = {}
    texts, ids = [], []
    for item, text in items:
        w = words_of(text)
        if w:
            texts.append([vocab.setdefault(x, len(vocab) + 1) for x in w])
            ids.append(None if item is None else str(item))
    longest = max((len(t) for t in texts), default=0)
    flat = np.concatenate([np.array(t, np.int64) for t in texts]) if texts else np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    item = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(flat.size) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - offset  # words from here to the item's end
    width = np.minimum(window, np.repeat(sizes, sizes))
    return {
        "vocab": vocab, "ids": ids, "flat": np.concatenate([flat, np.zeros(longest + 4, np.int64)]), "longest": longest,
        "item": item, "offset": offset, "left": left, "width": width, "window": left >= width,
    }


def suffix_array(ids: np.ndarray, n: int, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the known words (ids > 0) sorted by the `depth` words from there,
    with their packed first words and how many words are packed.

    ids is padded with zeros beyond n. Prefix doubling: places that share the
    first h words are sorted by the rank of what stands h words on.
    """
    pack = max(1, min(62 // bits, depth))
    sa = np.flatnonzero(ids[:n])
    key = np.zeros(sa.size, np.int64)
    for j in range(pack):
        key = (key << bits) | ids[sa + j]
    order = np.argsort(key, kind="stable")
    sa, key = sa[order], key[order]
    h = pack
    if h >= depth or sa.size == 0:
        return sa, key, pack
    rank = np.zeros(n + depth + pack + 1, np.int64)
    head = np.empty(sa.size, bool)
    head[0], head[1:] = True, key[1:] != key[:-1]
    slot = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    rank[sa] = slot[group] + 1
    sizes = np.diff(np.append(slot, sa.size))
    loose = np.flatnonzero(sizes[group] > 1)  # slots of places that are not yet told apart
    while h < depth and loose.size:
        places = sa[loose]
        first, then = rank[places], rank[np.minimum(places + h, n)]
        order = np.argsort((first << 31) | then, kind="stable")
        places, first, then = places[order], first[order], then[order]
        sa[loose] = places
        head = np.empty(loose.size, bool)
        head[0], head[1:] = True, (first[1:] != first[:-1]) | (then[1:] != then[:-1])
        slot, group = np.flatnonzero(head), np.cumsum(head) - 1
        rank[places] = loose[slot][group] + 1
        sizes = np.diff(np.append(slot, loose.size))
        loose = loose[sizes[group] > 1]
        h *= 2
    return sa, key, pack


def _bounds(ids, sa, lo, hi, query, length, upper):
    """Vectorised binary search: the first slot in [lo, hi) that is not before the query
    (upper: that is after all with the query as prefix)."""
    lo, hi = lo.copy(), hi.copy()
    depth = np.arange(query.shape[1])
    inside = depth[None, :] < length[:, None]
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not open_.size:
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        diff = np.where(inside[open_], ids[sa[mid][:, None] + depth] - query[open_], 0)
        at = (diff != 0).argmax(axis=1)
        sign = diff[np.arange(open_.size), at]
        right = sign <= 0 if upper else sign < 0
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


def search_shard(ids: np.ndarray, n: int, test: dict) -> dict[str, np.ndarray]:
    """The longest verbatim matches of the test items in a shard, of a window at least.

    ids: word numbers, 0 between texts, padded. Each test suffix is searched to its
    window's width; matches at consecutive places of a text and an item are one
    longer match.
    """
    none = np.zeros(0, np.int64)
    empty = {"start": none, "end": none, "item": none}
    if not test["longest"] or not n:
        return empty
    bits = max(1, int(len(test["vocab"])).bit_length())
    sa, key, pack = suffix_array(ids, n, test["longest"], bits)
    if not sa.size:
        return empty
    flat, suffix = test["flat"], np.flatnonzero(test["window"])
    width = test["width"][suffix]
    # the packed first words narrow the range at once; a window shorter than a pack spans all its continuations
    low = np.zeros(suffix.size, np.int64)
    for j in range(pack):
        low = (low << bits) | np.where(j < width, flat[suffix + j], 0)
    high = low + (np.int64(1) << (bits * np.maximum(0, pack - width))) - 1
    lo, hi = np.searchsorted(key, low, "left"), np.searchsorted(key, high, "right")
    found = np.flatnonzero(lo < hi)
    suffix, width, lo, hi = suffix[found], width[found], lo[found], hi[found]
    if not suffix.size:
        return empty
    query = flat[suffix[:, None] + np.arange(int(width.max()))]
    first, last = _bounds(ids, sa, lo, hi, query, width, False), _bounds(ids, sa, lo, hi, query, width, True)
    hit = np.flatnonzero(first < last)
    suffix, width, first, last = suffix[hit], width[hit], first[hit], last[hit]
    count = last - first
    slots = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    places = sa[slots]
    item, width = np.repeat(test["item"][suffix], count), np.repeat(width, count)
    shift = places - np.repeat(test["offset"][suffix], count)
    order = np.lexsort((places, shift, item))
    item, width, shift, places = item[order], width[order], shift[order], places[order]
    head = np.ones(places.size, bool)
    head[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (places[1:] != places[:-1] + 1)
    first = np.flatnonzero(head)
    last = np.append(first[1:], places.size) - 1
    return {"start": places[first], "end": places[last] + width[last], "item": item[first]}


def scan_texts(texts: list, test: dict) -> list[dict]:
    """What each of a shard's texts has: words, hit words, items, spans, longest match."""
    get, lists = test["vocab"].get, [words_of(t) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    begin = np.cumsum(counts + 1) - counts - 1  # a zero stands after each text
    n = int((counts + 1).sum())
    ids = np.zeros(n + test["longest"] + 64, np.int64)
    for b, w in zip(begin.tolist(), lists):
        if w:
            ids[b : b + len(w)] = [get(x, 0) for x in w]
    found = search_shard(ids, n, test)
    out = [{"n_words": int(c), "n_hit": 0, "items": [], "spans": [], "longest": 0, "longest_item": None, "longest_start": None} for c in counts]
    if not found["start"].size:
        return out
    edge = np.bincount(found["start"], minlength=n + 1)[: n + 1] - np.bincount(found["end"], minlength=n + 1)[: n + 1]
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
    doc = np.searchsorted(begin, found["start"], "right") - 1
    pairs = np.unique(np.stack([doc, found["start"], found["item"], found["end"]]), axis=1)
    for d, s, i, e in zip(*(x.tolist() for x in pairs)):
        out[d]["spans"].append((s - int(begin[d]), e - int(begin[d]), test["ids"][i]))
    for d in np.unique(doc).tolist():
        row = out[d]
        row["n_hit"] = int(covered[begin[d] + counts[d]] - covered[begin[d]])
        row["items"] = sorted({x[2] for x in row["spans"] if x[2] is not None})
        row["spans"].sort(key=lambda x: (x[0], x[1], str(x[2])))
        start, end, item = max(row["spans"], key=lambda x: (x[1] - x[0], -x[0]))
        row |= {"longest": end - start, "longest_item": item, "longest_start": start}
    return out


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("item_id", T.StringType())]))),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_item", T.StringType()),
    T.StructField("longest_start", T.LongType()),
]
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_id", pa.string())]))


def _columns(rows: list[dict]) -> list[pa.Array]:
    spans = [[{"start": s, "end": e, "item_id": i} for s, e, i in r["spans"]] for r in rows]
    return [
        pa.array([r["n_words"] for r in rows], pa.int64()), pa.array([r["n_hit"] for r in rows], pa.int64()),
        pa.array([r["items"] for r in rows], pa.list_(pa.string())), pa.array(spans, _SPAN),
        pa.array([r["longest"] for r in rows], pa.int64()), pa.array([r["longest_item"] for r in rows], pa.string()),
        pa.array([r["longest_start"] for r in rows], pa.int64()),
    ]


def _merge(a: dict, b: dict) -> dict:
    """Of one text, the hits of two blocks of test items."""
    spans = sorted(a["spans"] + b["spans"], key=lambda x: (x[0], x[1], str(x[2])))
    hit, end = 0, 0
    for s, e, _ in spans:
        hit, end = hit + max(0, e - max(s, end)), max(end, e)
    long_ = a if a["longest"] >= b["longest"] else b
    return {"n_words": a["n_words"], "n_hit": hit, "items": sorted({*a["items"], *b["items"]}), "spans": spans} | {k: long_[k] for k in ("longest", "longest_item", "longest_start")}


def blocks_of(tests: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[dict]:
    """The test items, one block of at most block_bytes of text (one item at least) at a time."""
    block, held = [], 0
    rows = tests.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator()
    for i, t in rows:
        t = bytes(t) if t is not None else None
        if block and held + len(t or b"") > block_bytes:
            yield test_block(block, window)
            block, held = [], 0
        block.append((i, t))
        held += len(t or b"")
    if block:
        yield test_block(block, window)


def find_matches(
    docs: DataFrame,
    tests: DataFrame,
    text_col: str = "text",
    test_id: str = "item_id",
    test_text: str = "text",
    window: int = WINDOW,
    drop: tuple[str, ...] = (),
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, items, spans and the longest match of each text.

    Each block of test items is one broadcast and one pass in the same tasks; no
    shuffle. See the module's docstring for nulls, ties and clashing names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = [spark.sparkContext.broadcast(b) for b in blocks_of(tests, test_id, test_text, window, block_bytes)]
    held = held or [spark.sparkContext.broadcast(test_block([], window))]
    names = {f.name for f in FIELDS}
    kept = [f for f in docs.schema.fields if f.name not in names and f.name not in drop]
    keep = [f.name for f in kept]
    letters = shard_words * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [t for b in group for t in b.column(text_col).cast(pa.binary()).to_pylist()]
            rows = None
            for block in held:
                found = scan_texts(texts, block.value)
                rows = found if rows is None else [_merge(a, b) for a, b in zip(rows, found)]
                if len(held) > 1:
                    block.__dict__.pop("_value", None)  # one block in memory at a time
            at = 0
            for b in group:
                part, at = rows[at : at + b.num_rows], at + b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + _columns(part), names=keep + [f.name for f in FIELDS])

        group, size = [], 0
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            group.append(batch)
            size += batch.column(text_col).nbytes
            if size >= letters:
                yield from flush(group)
                group, size = [], 0
        if group:
            yield from flush(group)

    return docs.mapInArrow(run, T.StructType(kept + FIELDS))


def remove_contaminated(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """docs without those that hold a window of a test item; their own columns only."""
    marks = [f.name for f in FIELDS if f.name not in docs.columns]
    held = docs.select("*", *(F.col(c).alias(f"__own_{c}") for c in docs.columns if c in {f.name for f in FIELDS}))
    found = find_matches(held, tests, **options).where("n_hit = 0").drop(*marks)
    return found.select(*(F.col(f"__own_{c}").alias(c) if f"__own_{c}" in found.columns else F.col(c) for c in docs.columns))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_matches(docs, table(spark, sf_dir, "benchmark"), drop=("text",))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


by_value(__name__)
