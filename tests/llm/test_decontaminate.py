import random

import numpy as np
import pytest

from loomgraph.llm import decontaminate as D


def slow(texts, items, window=10):
    """Hit word places and item ids of each text, by comparing every place with every window."""
    out = []
    for text in texts:
        w, hit, ids = D.words_of(text), set(), set()
        for item, t in items:
            v = D.words_of(t)
            k = min(window, len(v))
            for o in range(len(v) - k + 1 if v else 0):
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == v[o : o + k]:
                        hit.update(range(i, i + k))
                        ids |= {item} - {None}
        out.append((len(w), len(hit), sorted(ids)))
    return out


def made(seed, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "dd", "e1"])
    items = [(str(i), " ".join(word() for _ in range(rng.randrange(0, 30))).encode()) for i in range(8)] + [("9", b""), (None, b"z z z"), ("9", None)]
    texts = []
    for _ in range(n):
        w = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            _, t = rng.choice(items)
            w[len(w) // 2 : len(w) // 2] = (t or b"").decode().split()
        texts.append(" ".join(w).encode())
    return texts + [None, b""], items


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    texts, items = made(seed)
    rows = D.scan_texts(texts, D.test_block(items, 10))
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in rows] == slow(texts, items)
    for r, t in zip(rows, texts):
        for s, e, i in r["spans"]:
            span = b" ".join(D.words_of(t)[s:e])
            assert any(span in b" ".join(D.words_of(x)) for j, x in items if j == i)
        assert r["longest"] == max((e - s for s, e, _ in r["spans"]), default=0)


def test_suffix_array_is_sorted():
    ids = np.random.default_rng(2).integers(0, 4, 500)
    padded = np.concatenate([ids, np.zeros(80, np.int64)])
    sa, _, _ = D.suffix_array(padded, 500, 40, 2)
    assert sorted(sa) == [i for i in range(500) if ids[i]]
    keys = [tuple(padded[i : i + 40]) for i in sa]
    assert keys == sorted(keys)


def test_blocks_of_tests_give_the_same(spark, sf):
    docs, tests = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    key = lambda df: sorted((r["doc_id"], r["n_hit"], tuple(r["items"])) for r in df.collect())
    assert key(D.find_matches(docs, tests)) == key(D.find_matches(docs, tests, block_bytes=2000, shard_words=2000))


def test_odd_rows(spark, odd_docs, no_docs):
    tests = spark.createDataFrame([(1, "lone words here"), (2, None), (None, "it s 12")], "item_id long, text string")
    rows = {(r["doc_id"], r["n_hit"], tuple(r["items"])) for r in D.find_matches(odd_docs, tests).where("n_hit > 0").collect()}
    assert rows == {(None, 3, ("1",)), (8, 3, ())}
    kept = D.remove_contaminated(odd_docs, tests)
    assert kept.columns == odd_docs.columns and kept.count() == 9 and kept.first()["n_words"] == "y"
    assert D.find_matches(no_docs, tests).count() == 0
    assert D.find_matches(odd_docs, tests.limit(0)).where("n_hit > 0").count() == 0
