"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with elastic-net
penalties, then calibrated by one temperature.

Training takes a bounded sample, at most PER_LANGUAGE rows and PER_LANGUAGE_CHARS characters of each
language, the rows of the least hashes of their ids; every language is learned, however many there are; the corpus's document frequencies come from
all training rows. A tenth of the sample is held back for the temperature.
Prediction covers every whole text in one pass, without a shuffle.

Edge cases: a null text, or one without a letter, is `und` with score 0; so is
every text where nothing can be learned from (an empty or unlabelled table); rows
with a null id, lang or text are not learned from, and of an id that repeats one text is; ties of the score go to the
first language by name; columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import append, by_value, table
from loomgraph.runtime import bound_batches

#: Rows of each language to learn from, and characters of their texts (by which the last row is cut).
PER_LANGUAGE, PER_LANGUAGE_CHARS = 600, 8_000_000
#: Feature slots of the hashed n-grams (a power of two), and the n-grams' lengths.
SLOTS = 1 << 15
GRAMS = (1, 2, 3, 4)
#: FTRL: learning rate and its offset, the elastic net's L1 and L2, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-3, 1e-3, 4
#: A sampled text is learned from in stretches of this many characters, so that
#: short texts are seen too; all its stretches count.
STRETCH = 2000
UNKNOWN = "und"


def codes(text: str) -> np.ndarray:
    """Lower-cased code points, runs of other than letters folded to one space, spaces around."""
    folded = " " + " ".join(regex.split(r"[^\p{L}\p{M}]+", text.lower())).strip() + " "
    return np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def slots(c: np.ndarray, size: int = SLOTS) -> np.ndarray:
    """The slot of each character n-gram of the code points c."""
    out = []
    h = np.zeros(c.size, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if c.size < n:
            break
        h = h[: c.size - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            out.append((((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) & np.uint64(size - 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse TF-IDF of a whole text, of length one: 1 + log tf, times idf."""
    counts = np.bincount(slots(codes(text), idf.size), minlength=idf.size)
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, x / norm if norm > 0 else x


class Ftrl:
    """FTRL-proximal for multinomial logistic regression with L1 and L2 penalties."""

    def __init__(self, size: int, classes: int):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    while high - low > 1e-4:
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[str, str]], df: np.ndarray, n_docs: int) -> dict | None:
    """rows: (text, lang) in a fixed order. The model, or None if nothing can be learned."""
    names = sorted({lang for _, lang in rows})
    if not names:
        return None
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    index = {x: i for i, x in enumerate(names)}
    stretches = [(text[i : i + STRETCH], index[lang], k % 10 == 9) for k, (text, lang) in enumerate(rows) for i in range(0, max(1, len(text)), STRETCH)]
    made = [(*vector(t, idf), y, back) for t, y, back in stretches if regex.search(r"\p{L}", t)]
    model = Ftrl(idf.size, len(names))
    rng = np.random.default_rng(0)
    train = [m for m in made if not m[3]] or made
    for _ in range(EPOCHS):
        for k in rng.permutation(len(train)).tolist():
            at, x, y, _ = train[k]
            model.learn(at, x, y)
    w = model.weights(slice(None))
    back = [m for m in made if m[3]]
    t = temperature(np.array([x @ w[at] for at, x, _, _ in back]), np.array([y for _, _, y, _ in back])) if back else 1.0
    return {"names": names, "idf": idf.astype(np.float32), "w": w.astype(np.float32), "temperature": t}


def below(key: Column, fraction: Column | float) -> Column:
    """Whether the key's hash is in the lowest such fraction of all hashes."""
    return F.pmod(key, F.lit(1 << 40)) < F.lit(float(1 << 40)) * fraction


def sample(rows: DataFrame, counts: dict[str, int], id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """At most per_language (text, lang) rows of each language (counts: its rows), by the least
    hashes of the ids; the texts are read for the chosen ids only."""
    # twice as many as are wanted pass a hash threshold, so few rows of a language meet
    fraction = F.create_map(*(F.lit(x) for n, c in counts.items() for x in (n, min(1.0, 2 * per_language / c + 64 / c))))
    light = rows.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l")).where("i is not null").withColumn("k", F.xxhash64("i"))
    light = light.where(below(F.col("k"), fraction[F.col("l")])).distinct().withColumn("h", F.pmod("k", F.lit(1 << 40)))
    near = light.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))).where(F.col("r") <= per_language)
    ids = [r["i"] for r in near.select("i").distinct().collect()]  # at most languages * per_language
    if not ids:
        return []
    wanted = rows.sparkSession.createDataFrame([(i,) for i in ids], rows.select(F.col(id_col).alias("__i")).schema)
    texts = rows.join(F.broadcast(wanted), F.col(id_col) == F.col("__i"), "left_semi").where(F.col(text_col).isNotNull())
    got = texts.groupBy(id_col, lang_col).agg(F.min(text_col).alias("t"))  # an id may repeat, and often
    order = Window.partitionBy(lang_col).orderBy(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)), id_col).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(PER_LANGUAGE_CHARS) - F.coalesce(F.sum(F.length("t")).over(order), F.lit(0))
    got = got.withColumn("left", left).where("left > 0").select(id_col, lang_col, F.expr("left(t, cast(left as int))"))
    return [(r[2], r[1]) for r in sorted(got.collect(), key=lambda r: (str(r[0]), r[1]))]


def frequencies(rows: DataFrame, text_col: str, size: int = SLOTS) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs: each task sends one array, summed in a tree."""
    bound_batches(rows.sparkSession)

    def run(batches):
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    df += np.bincount(slots(codes(text), size), minlength=size) > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())], names=["slot", "n"])

    sums = rows.select(text_col).mapInArrow(run, "slot long, n long").groupBy("slot").sum("n").collect()
    df, n = np.zeros(size, np.int64), 0
    for slot, count in sums:
        if slot < 0:
            n = count
        else:
            df[slot] = count
    return df, n


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> dict | None:
    known = rows.where(F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # a row a language
    if not counts:
        return None
    texts = sample(known, counts, id_col, text_col, lang_col, per_language)
    if not texts:
        return None
    df, n = frequencies(known, text_col)
    return fit(texts, df, n)


def predict(docs: DataFrame, model: dict | None, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_pred and score, the calibrated probability of lang_pred."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    letter = r"\p{L}"

    def compute(batch: pa.RecordBatch) -> list:
        m = held.value
        has = regex.compile(letter).search
        langs, scores = [], []
        for text in batch.column(text_col).to_pylist():
            if not m or not text or not has(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, x = vector(text, m["idf"])
            p = softmax((x @ m["w"][at]).astype(np.float64) / m["temperature"])
            best = int(p.argmax())
            langs.append(m["names"][best])
            scores.append(float(p[best]))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return append(docs, compute, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], drop)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; of the empty text for a null id."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder("doc_id", 3) == 1)
    model = train(docs.where("not held_out"))
    return predict(docs.drop("lang"), model, drop=("text",)).select("doc_id", "held_out", "lang_pred", "score")


by_value(__name__)
