import random

import numpy as np

from loomgraph.llm import langid as L


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in L.op7_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    import zlib

    for d in docs:
        assert rows[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
    held = [d for d in docs if rows[d["doc_id"]]["held_out"]]
    assert np.mean([rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.98


def test_ftrl_is_sparse_and_learns():
    rng = random.Random(2)
    texts = [(" ".join(rng.choice(["der", "und", "nicht"] if k % 2 else ["the", "and", "not"]) for _ in range(8)), "de" if k % 2 else "en") for k in range(80)]
    df = np.zeros(L.SLOTS, np.int64)
    for t, _ in texts:
        df += np.bincount(L.slots(L.codes(t)), minlength=L.SLOTS) > 0
    model = L.fit(texts, df, len(texts))
    assert 0 < (model["w"] != 0).mean() < 0.05
    at, x = L.vector("the and", model["idf"])
    assert model["names"][int((x @ model["w"][at]).argmax())] == "en"


def test_temperature_mends_overconfidence():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    logits = np.zeros((4000, 2))
    logits[np.arange(4000), np.where(rng.random(4000) < 0.8, y, 1 - y)] = 8.0
    p = L.softmax(logits / L.temperature(logits, y)).max(axis=1)
    assert abs(p.mean() - 0.8) < 0.02


def test_odd_rows(odd_docs, no_docs):
    model = L.train(odd_docs)
    out = L.predict(odd_docs, model).collect()
    assert [r["lang_pred"] == "und" for r in out] == [not any(c.isalpha() for c in r["text"] or "") for r in out]
    assert all(0 <= r["score"] <= 1 for r in out) and {r["lang_pred"] for r in out} <= {"und", "en", "de", "fr"}
    assert L.train(no_docs) is None and L.predict(no_docs, None).count() == 0
    assert {r["lang_pred"] for r in L.predict(odd_docs, None).collect()} == {"und"}


def test_every_language_is_learned_and_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "PER_LANGUAGE_CHARS", 300)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join(letters[i % 20] * 3 + letters[i % 20 + 1] for _ in range(12)), f"l{i % 20}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {f"l{i}": 10 for i in range(20)}
    texts = L.sample(docs, counts, "doc_id", "text", "lang", 600)
    size = {n: sum(len(t) for t, lang in texts if lang == n) for n in counts}
    assert set(size.values()) == {300}
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(docs, L.train(docs)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 190
