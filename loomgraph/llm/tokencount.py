"""Token counts with the whole-token shortcut.

Offline, on the driver, each vocabulary string is encoded alone: those that come
back as one token form the proven set. A text is cut into pre-tokens as the
tokenizer's byte-level rule does; a pre-token of the proven set counts one
without any merging, and only the others are merged, by the library, once per
batch for each distinct one.

Why it is exact: byte-level BPE merges inside a pre-token only, so a text's count
is the sum over its pre-tokens, and a pre-token encoded alone is cut into itself.
The cut depends on what counts as letter, number and space; texts with characters
outside the ranges where the two regex engines are known to agree are counted
by the library as a whole. Special strings are cut out first and count one each,
as the library's default does.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); columns named like
an output are replaced; repeated rows and any doc_id, null too, are kept as they are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import append, by_value, table

LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
#: Distinct merged pre-tokens that a worker keeps between batches; then it starts anew.
KEPT = 200_000

#: The byte-level rule's pattern and Unicode's White_Space characters.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters whose classes have been the same in all Unicode versions of either engine.
PLAIN = r"[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def prove(spec: str) -> tuple[frozenset[str], tuple[str, ...]]:
    """The vocabulary strings that encode alone as one token, and the special strings."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    parsed = json.loads(spec)
    special = tuple(x["content"] for x in parsed.get("added_tokens", []))
    byte = byte_letters()
    texts = []
    for token in parsed["model"]["vocab"]:
        if token in special or any(c not in byte for c in token):
            continue
        try:
            texts.append(bytes(byte[c] for c in token).decode("utf-8"))
        except UnicodeDecodeError:
            continue  # part of a character: never a whole pre-token
    alone = tokenizer.encode_batch(texts, add_special_tokens=False)
    whole = regex.compile(PATTERN)
    return frozenset(t for t, e in zip(texts, alone) if len(e.ids) == 1 and whole.fullmatch(t)), special


def is_byte_level(spec: str) -> bool:
    """Whether the rule above is the tokenizer's: BPE, bytes, no normaliser, no prefix space."""
    s = json.loads(spec)
    pre = s.get("pre_tokenizer") or {}
    model = s.get("model") or {}
    plain = not any(x.get(k) for x in s.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    return bool(
        model.get("type") == "BPE" and not model.get("dropout") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        and pre.get("use_regex", True) and not s.get("normalizer") and not s.get("truncation") and not s.get("padding") and plain
    )


def counter(spec: str, whole: frozenset[str], special: tuple[str, ...]) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of a batch of texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    pieces = regex.compile(PATTERN).findall
    odd = regex.compile(PLAIN).search
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    known: dict[str, int] = dict.fromkeys(whole, 1)

    def merge(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(texts: list[str]) -> list[int]:
        nonlocal known
        if len(known) > len(whole) + KEPT:
            known = dict.fromkeys(whole, 1)
        out, parts, by_library = [0] * len(texts), {}, []
        for i, text in enumerate(texts):
            if odd(text):
                by_library.append(i)
            elif special and any(x in text for x in special):
                between = cut.split(text)
                out[i] = len(between) - 1
                parts[i] = list(chain.from_iterable(map(pieces, between)))
            else:
                parts[i] = pieces(text)
        new = set(chain.from_iterable(parts.values())).difference(known)
        if new:
            new = list(new)
            known.update(zip(new, merge(new)))
        for i, p in parts.items():
            out[i] += sum(map(known.__getitem__, p))
        if by_library:
            for i, n in zip(by_library, merge([texts[i] for i in by_library])):
                out[i] = n
        return out

    return count


def count_tokens(docs: DataFrame, tokenizer_file: str, text_col: str = "text", limit: int = LIMIT, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit). No shuffle.

    tokenizer_file is read on the driver and sent to the tasks (a vocabulary: a few
    MB). A tokenizer of another kind than byte-level BPE is counted by its library.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    whole, special = prove(spec) if is_byte_level(spec) else (frozenset(), ())
    held = docs.sparkSession.sparkContext.broadcast((spec, whole, special, is_byte_level(spec)))
    made: list = []

    def compute(batch: pa.RecordBatch) -> list:
        if not made:
            spec_, whole_, special_, shortcut = held.value
            if shortcut:
                made.append(counter(spec_, whole_, special_))
            else:
                from tokenizers import Tokenizer

                other = Tokenizer.from_str(spec_)
                other.no_truncation()
                other.no_padding()
                made.append(lambda texts: [len(e.ids) for e in other.encode_batch(texts, add_special_tokens=False)])
        texts = [t or "" for t in batch.column(text_col).to_pylist()]
        counts = made[0](texts)
        return [
            pa.array([len(t.encode()) for t in texts], pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array([n > limit for n in counts], pa.bool_()),
        ]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append(docs, compute, fields, drop)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY), drop=("text",)).select("doc_id", F.col("n_bytes"), "n_tokens", "over_limit")


by_value(__name__)
