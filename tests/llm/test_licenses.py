import random
import re

import duckdb

from loomgraph.llm import licenses as L


def fold(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow(text):
    w = fold(text)
    base = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = {}
    for label, t in L.TEMPLATES.items():
        span, t = -(-len(t.split()) * 10 // 8), set(t.split())
        c = max((len(t & set(w[i : i + span])) / len(t) for i in range(len(w))), default=0)
        if c >= L.THRESHOLD - 1e-9:
            found[label] = c
    at = [i for i, _ in base]
    own = {x for _, x in base}
    return (len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | set(found))), 1.0 if base else max(found.values(), default=0.0))


def rows(df):
    return [tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in df.collect()]


def test_against_brute_force_on_mixed_texts(spark):
    rng = random.Random(4)
    pool = [w for t in L.TEMPLATES.values() for w in t.split()] + ["GNU", "MIT", "License", "\n", "CC-BY", "Apache", "é", "İ", "licenſe", "K", ".", "x"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in list(L.TEMPLATES.values()) * 4:
        w = t.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "zz"
        rng.shuffle(w)
        texts.append("Before\n" + " ".join(w).upper() + "\nafter mit\nLICENSE gnu general public. license")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    assert rows(L.scan_licenses(docs)) == [slow(t) for t in texts]


def test_query_against_its_sql(spark, sf):
    got = sorted(tuple(r) for r in L.op3_licenses(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.execute(L.oracle()).fetchall())
    assert any(r[6] for r in got)


def test_odd_rows(odd_docs, no_docs):
    assert rows(L.scan_licenses(odd_docs)) == [slow(r["text"]) for r in odd_docs.collect()]
    assert L.scan_licenses(no_docs).count() == 0
    assert {r["labels"] for r in L.scan_licenses(odd_docs, templates={}).collect()} == {""}


def test_wrapped_and_embedded_notices(spark):
    """A notice over several lines, behind other words, with words put in or taken out."""
    texts = []
    for label, t in L.TEMPLATES.items():
        w = t.upper().split()
        texts.append((label, "some prose before, " * 30 + "\n".join(" ".join(w[i : i + 4]) for i in range(0, len(w), 4)) + ". And after " * 30))
    got = {r["label"]: r for r in L.scan_licenses(spark.createDataFrame(texts, "label string, text string")).collect()}
    assert all(label in r["labels"].split(",") and max(m["containment"] for m in r["matches"] if m["label"] == label) == 1.0 for label, r in got.items())
    far = spark.createDataFrame([(1, (" filler" * 40).join(L.TEMPLATES["mpl-2.0"].split()))], "doc_id long, text string")
    assert L.scan_licenses(far).first()["labels"] == ""


def test_other_templates_and_quotes(spark):
    docs = spark.createDataFrame([(1, "It is the author's own; do as you like"), (2, "nothing")], "doc_id long, text string")
    many = {f"t'{i}": f"word{i} other{i} third{i}" for i in range(600)} | {"own": "author s own do as you like", "none": ""}
    got = L.scan_licenses(docs, templates=many, phrases={"as you": "a'b"}).orderBy("doc_id").collect()
    assert [(r["labels"], r["n_base"], r["first_word"]) for r in got] == [("a'b,own", 1, 7), ("", 0, None)]
