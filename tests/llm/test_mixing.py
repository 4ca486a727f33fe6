import math

from loomgraph.llm import mixing as M


def test_exponent_meets_target_and_limit():
    tokens = {"a": 1000, "b": 100, "c": 10, "d": 0}
    a, w, n = M.solve(tokens, 0.9, 100.0, 1110)
    assert abs(sum(w.values()) - 1) < 1e-12 and "d" not in w
    assert M.entropy(w) >= 0.9 * math.log(3) > M.entropy(M.weights(tokens, a + 1 / M.GRID))
    a2, _, n2 = M.solve(tokens, 0.9, 3.0, 1110)
    assert a2 > a and max(n2.values()) <= 3.0 < max(n.values())


def test_budget_is_realised(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = M.mix(docs, budget="corpus").collect()
    assert len(rows) == docs.count()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        taken, all_ = sum(r["n_tokens"] * r["copies"] for r in own), sum(r["n_tokens"] for r in rows)
        assert taken <= own[0]["weight"] * all_ + 1
        assert taken >= own[0]["weight"] * all_ - max(r["n_tokens"] for r in own) * 40
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1


def test_cover_loses_no_document(odd_docs, no_docs):
    out = M.mix(odd_docs)
    rows = out.collect()
    assert len(rows) == 11 and min(r["copies"] for r in rows) >= 1 and max(r["copies"] for r in rows) <= M.PASSES + 1
    assert len(out.columns) == len(set(out.columns))
    assert M.mix(no_docs).count() == 0
    empty = odd_docs.where("text is null or text = ''")
    assert [r["copies"] for r in M.mix(empty, budget="corpus").collect()] == [1, 1, 1]


def test_passes_are_block_permutations_of_their_own(spark):
    docs = spark.createDataFrame([(i, "a b c " * (1 + i % 3), "big" if i % 9 else "small") for i in range(400)], "doc_id long, text string, source string")
    rows = M.mixture(docs, blocks=4).collect()
    copies = {r["doc_id"]: r["copies"] for r in M.mix(docs, blocks=4).collect()}
    assert len(rows) == sum(copies.values()) and set(copies) == set(range(400))
    small = sorted(r["pass"] for r in rows if r["source"] == "small")
    assert max(small) > 1
    orders = {}
    for p in sorted(set(small))[:2]:
        part = sorted((r["block_at"], r["row_at"], r["doc_id"]) for r in rows if r["source"] == "small" and r["pass"] == p)
        assert len({b for b, *_ in part}) <= 4
        orders[p] = [i for *_, i in part]
    assert orders[1] != orders[2]
    clash = docs.selectExpr("doc_id", "text", "source", "1 as copies", "2 as pass", "'x' as weight")
    got = M.mixture(clash, blocks=4)
    assert got.columns == ["doc_id", "text", "source", "copies", "weight", "pass", "block_at", "row_at"] and got.count() == len(rows)
