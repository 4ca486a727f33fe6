import corpus_pipeline as C
from loomgraph.llm import decontaminate as D
from loomgraph.llm import mixing as M
from test_sharding import check
from test_nearcopies import slow_least


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda df: sorted(r["doc_id"] for r in df.collect())
    scored = C.toxicity.score(docs, C.toxicity.model_of(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    kept = C.drop_toxic(spark, docs, sf).cache()
    assert kept.columns == docs.columns and key(kept) == sorted(r["doc_id"] for r in scored.collect() if r["score"] < 0.3)

    # five-word shingles, similarity 0.8 or more: all pairs of sets, compared whole
    least = slow_least([(r["doc_id"], r["text"]) for r in kept.collect()])
    one = C.drop_near_copies(spark, kept, sf).cache()
    assert one.columns == docs.columns and key(one) == sorted(set(least.values()))

    tests = [(r["item_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + min(10, len(w))]) for w in (D.words_of(t) for _, t in tests) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(g) for g in grams}
    clean = [r["doc_id"] for r in one.collect() for w in [D.words_of((r["text"] or "").encode())] if not any(tuple(w[i : i + k]) in grams for k in sizes for i in range(len(w) - k + 1))]
    pure = C.drop_contaminated(spark, one, sf).cache()
    assert pure.columns == docs.columns and key(pure) == sorted(clean)

    tokens = {}
    for r in pure.collect():
        tokens[r["source"]] = tokens.get(r["source"], 0) + len((r["text"] or "").split())
    _, _, times = M.solve({f"s{k}": v for k, v in tokens.items()})
    mixed = C.mix_sources(spark, pure, sf).cache()
    assert mixed.columns == docs.columns and set(key(mixed)) == set(clean)
    for s, t in tokens.items():
        taken = sum(len((r["text"] or "").split()) for r in mixed.where(mixed["source"] == s).collect())
        assert times[f"s{s}"] * t * 0.8 <= taken <= times[f"s{s}"] * t + 1

    out = C.shard(spark, mixed, sf)
    assert set(docs.columns) < set(out.columns)
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == key(mixed)
    check(rows)


def test_run_and_odd_rows(spark, sf, odd_docs, tmp_path):
    out = C.run(spark, sf)
    assert out.count() > 50 and {"shard", "slot", "doc_id", "text"} <= set(out.columns)
    small = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    tests = spark.createDataFrame([(1, "lone words here")], "item_id long, text string")
    small.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    tests.write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = {r["doc_id"] for r in C.run(spark, str(tmp_path)).collect()}
    assert ids == {1, 4, 7, 8, None} or ids == {1, 4, 7, 8}
    small.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.write.parquet(f"{tmp_path}/none/labels.parquet")
    tests.write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0


