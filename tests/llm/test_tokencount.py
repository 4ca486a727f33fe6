import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import tokencount as C


@pytest.fixture(scope="module")
def spec():
    with open(public_tokenizers.path(C.VOCABULARY), encoding="utf-8") as f:
        return f.read()


def library(spec, texts):
    t = Tokenizer.from_str(spec)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_against_the_library_on_random_texts(spec):
    rng = random.Random(5)
    pool = list("abcdefgh'stremvdlAZ019 ") + [" ", "  ", "\n", "\t", "\r\n", "é", "ß", "\xa0", "\x85", "\x1c", " ", "—", "漢", "😀", "<|endoftext|>", "<|endof", "²", "٣", "'s", "'ll", "the", " and", "　", "ª", "\xad", "̀"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(4000)]
    count = C.counter(spec, *C.prove(spec))
    assert count(texts) == library(spec, texts)


def test_query_against_the_library(spark, sf, spec):
    rows = {r["doc_id"]: r for r in C.op10_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = library(spec, [d["text"] or "" for d in docs])
    assert len(rows) == len(docs)
    for d, n in zip(docs, want):
        r = rows[d["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((d["text"] or "").encode()), n, n > 1024)


def test_odd_rows(odd_docs, no_docs, spec):
    rows = C.count_tokens(odd_docs, public_tokenizers.path(C.VOCABULARY)).collect()
    assert [r["n_tokens"] for r in rows] == library(spec, [r["text"] or "" for r in rows])
    assert C.count_tokens(no_docs, public_tokenizers.path(C.VOCABULARY)).count() == 0


def test_other_tokenizers_are_counted_by_their_library(odd_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = C.count_tokens(odd_docs, path).collect()
    t = Tokenizer.from_file(path)
    assert [r["n_tokens"] for r in rows] == [len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows]


def test_other_tokenizers_do_not_truncate(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"a": 0, "b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    plain.pre_tokenizer = pre_tokenizers.Whitespace()
    plain.enable_truncation(3)
    plain.enable_padding(length=5)
    plain.save(f"{tmp_path}/t.json")
    docs = spark.createDataFrame([(1, "a b a b a b a"), (2, "a")], "doc_id long, text string")
    assert [r["n_tokens"] for r in C.count_tokens(docs, f"{tmp_path}/t.json").orderBy("doc_id").collect()] == [7, 1]
