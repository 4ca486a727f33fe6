import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from loomgraph.llm import toxicity as X


def slow_terms(text):
    """Terms of a text, by the definition: words and their starred beginnings."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in raw))
    return Counter(words + [w[:n] + b"*" for n in (4, 6) for w in words if len(w) > n])


def slow_vectors(texts, known, idf):
    out = []
    for t in texts:
        x = {w: (1 + math.log(n)) * idf[w] for w, n in slow_terms(t).items() if w in known}
        norm = math.sqrt(sum(v * v for v in x.values()))
        out.append({w: v / norm for w, v in x.items()} if norm else {})
    return out


def slow_cosines(queries, examples):
    return np.array([[sum(v * e.get(w, 0.0) for w, v in q.items()) for e in examples] for q in queries])


def build(texts, idf_of, labels):
    known = X.Vocabulary(np.unique(np.concatenate([X.distinct(t.encode())[0] for t in texts])))
    every = {w for t in texts for w in slow_terms(t)}
    assert known.count == len(every)
    at = {w: int(known.find(X.term_hashes(w + b" ")[1][:1])[0]) if not w.endswith(b"*") else None for w in every}
    hashes = {w: hash_of(w) for w in every}
    idf = np.zeros(known.count)
    for w, h in hashes.items():
        place = int(known.find(np.array([h], np.uint64))[0])
        assert place >= 0 and at[w] in (None, place)
        idf[place] = idf_of(w)
    return X.Index(known, idf, known.counted([t.encode() for t in texts]), labels, [str(i) for i in range(len(texts))]), every


def hash_of(term):
    h = 0xCBF29CE484222325
    for c in term:
        h = ((h ^ c) * 0x100000001B3) % (1 << 64)
    return h


def test_nearest_is_exact():
    rng = random.Random(3)
    words = [f"w{i}ordlike{i % 7}"[: rng.randrange(2, 14)] + str(i) for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(700)]
    labels = np.array([rng.randrange(2) for _ in texts])
    idf_of = lambda w: 0.5 + (zlib.crc32(w) % 100) / 40
    index, every = build(texts, idf_of, labels)
    queries = [" ".join([*(rng.choice(words) for _ in range(rng.randrange(0, 12))), "unknown"]) for _ in range(150)] + ["", "zz", "w"]
    want = slow_cosines(*(slow_vectors(t, every, {w: idf_of(w) for w in every}) for t in (queries, [texts[int(n)] for n in index.names])))
    got = [x for i in range(0, len(queries), 64) for x in index.nearest(index.known.counted([q.encode() for q in queries[i : i + 64]]), len(queries[i : i + 64]), 10)]
    assert [index.labels[k] for k in range(700)] == [labels[int(n)] for n in index.names]
    for row, (ids, cos) in zip(want, got):
        best = np.sort(row[row > 1e-9])[::-1][:10]
        assert len(cos) == len(best) and np.allclose(cos, best, atol=1e-5) and np.allclose(row[ids], cos, atol=1e-5)


def test_terms_of_long_words_and_long_texts(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeABC é12 ,.  \n") for _ in range(rng.randrange(400))) for _ in range(50)] + ["x" * 200 + " " + "y" * 64 + " " + "z" * 65, "", " ", "q" * 65]
    whole = [X.distinct(t.encode()) for t in texts]
    for t, (h, n) in zip(texts, whole):
        want = slow_terms(t)
        assert h.size == len(want) and int(n.sum()) == sum(want.values())
        short = {hash_of(w): c for w, c in want.items() if len(w) <= 64}
        assert short.items() <= dict(zip(h.tolist(), n.tolist())).items()
    known = X.Vocabulary(np.unique(np.concatenate([h for h, _ in whole])))
    one = known.counted([t.encode() for t in texts])
    monkeypatch.setattr(X, "GROUP_BYTES", 40)
    assert all((a == b).all() for a, b in zip(one, known.counted([t.encode() for t in texts])))
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(whole, (X.distinct(t.encode()) for t in texts)))


def test_scores_against_brute_force(spark):
    """Every document's score from cosines of all its terms with all examples."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = X.model_of(docs, labels)
    index, w = model["index"].value, model["w"]
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    names = [int(n) for n in index.names]
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 and int(marked[i]) == y for i, y in zip(names, index.labels))
    every = {t for i in names for t in slow_terms(rows[i])}
    df = Counter(t for text in rows.values() for t in slow_terms(text).keys() & every)
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) for t in every}
    examples = slow_vectors([rows[i] for i in names], every, idf)
    ids = sorted(rows)[::10]
    cosines = slow_cosines(slow_vectors([rows[i] for i in ids], every, idf), examples)
    scored = {r["doc_id"]: r for r in X.score(docs, model).collect()}
    assert len(scored) == len(rows)
    for i, row in zip(ids, cosines):
        best = sorted((j for j in range(len(row)) if row[j] > 0), key=lambda j: (-row[j], j))[: X.NEIGHBOURS]
        z = float(w[0] + w[1:] @ X.vote(row[best], index.labels[best]))
        assert abs(scored[i]["score"] - 1 / (1 + math.exp(-z))) < 1e-3
        assert len(scored[i]["evidence"]) == min(3, len(best)) and all(abs(e["cosine"] - row[j]) < 1e-4 for e, j in zip(scored[i]["evidence"], best))


def test_examples_bytes_are_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 20 + str(i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    index = X.train(docs, docs, labels, n_bytes=500)["index"].value
    assert Counter(index.labels.tolist()) == {0: 4, 1: 4}


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in X.op5_toxicity(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[i]["score"], y) for i, y in labels.items() if i in rows and rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows.values())


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, 0), (8, None), (None, 1), (99, 1), (5, 1), (2, 0)], "doc_id long, toxic int")
    out = X.score(odd_docs, X.model_of(odd_docs, labels)).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in X.score(odd_docs, X.model_of(odd_docs, labels.limit(0))).collect()} == {0.0}
    assert X.score(no_docs, X.model_of(no_docs, labels)).count() == 0


def test_every_term_of_the_examples_counts(spark):
    """Clean examples' words are in the space: a clean text with one toxic word is nearer to clean ones."""
    toxic = [(i, f"awful nasty {w}", 1) for i, w in enumerate(["alpha", "beta", "gamma"] * 20)]
    clean = [(100 + i, f"river {w} bridge garden {w}ly", 0) for i, w in enumerate(["stone", "water", "apple"] * 20)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in toxic + clean], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic + clean], "doc_id long, toxic int")
    index = X.train(docs, docs, labels)["index"].value
    assert index.known.count == len({t for _, text, _ in toxic + clean for t in slow_terms(text)})
    (ids, cos), (one, _) = X.found(index, [b"river stone bridge garden stonely awful", b"garden"])
    assert cos[0] < 0.999 and not index.labels[ids[0]]
    assert one.size
