"""Mixing sources to target weights by temperature.

The token shares p of the sources are raised to an exponent a between 0 and 1 and
normalised; a is the greatest on a grid of 2^-12, found by bisection, at which the
entropy reaches the target, but not below the least at which no source is repeated
more often than the limit allows. The weights are then realised under a token
budget: a source of weight w gets w * budget tokens, as whole passes over its
documents and a part of one more. Each pass is a block permutation: blocks of
documents in an order drawn for the pass, and documents within a block in another, drawn for the pass
too. `places` has them for each pass that takes the row; mixture() gives a row for each.

`budget=None` is the smallest budget at which each source is passed at least once,
so that the mixture repeats small sources and loses no document.

Edge cases: a null source is a source of its own; null and empty texts have no
tokens and are taken once in each whole pass; with no tokens at all every row is
taken once; repeated rows (equal id and text) are taken together; an empty table
gives an empty one; columns named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import table
from loomgraph.runtime import cut

GRID = 4096
#: Share of the greatest possible entropy that the mixture is to reach.
ENTROPY = 0.95
#: Passes over a source at most.
PASSES = 4.0
SEED = "mix-0"
#: Blocks that a source's documents are dealt to.
BLOCKS = 1024
OUT = ("n_tokens", "weight", "copies", "pass_order", "places")


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised powers of the sources' shares; sources without tokens have none."""
    total = sum(tokens.values())
    raised = {s: (t / total) ** exponent for s, t in tokens.items() if t > 0}
    whole = sum(raised.values())
    return {s: r / whole for s, r in raised.items()}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def _bisect(meets, low: int, high: int) -> int:
    """The greatest k in [low, high] with meets(k), which holds up to some k; low if none."""
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if meets(middle) else (low, middle - 1)
    return low


def passes(tokens: dict, w: dict, budget: int | None) -> dict:
    """How often each source is passed: its budgeted tokens over those it has."""
    each = {s: w[s] / tokens[s] for s in w}
    if budget is None:
        least = min(each.values(), default=1.0)
        return {s: e / least for s, e in each.items()}
    return {s: e * budget for s, e in each.items()}


def solve(tokens: dict, target: float = ENTROPY, limit: float = PASSES, budget: int | None = None) -> tuple[float, dict, dict]:
    """Exponent, weights and passes of the sources."""
    if not any(t > 0 for t in tokens.values()):
        return 1.0, {}, {}
    live = sum(t > 0 for t in tokens.values())
    reach = target * math.log(live) if live > 1 else 0.0
    exponent = _bisect(lambda k: entropy(weights(tokens, k / GRID)) >= reach, 0, GRID)
    # fewer repeats need a greater exponent: mirrored, the limit holds up to some k
    fits = lambda k: max(passes(tokens, weights(tokens, (GRID - k) / GRID), budget).values()) <= limit
    exponent = max(exponent, GRID - _bisect(fits, 0, GRID))
    w = weights(tokens, exponent / GRID)
    return exponent / GRID, w, passes(tokens, w, budget)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target: float = ENTROPY,
    limit: float = PASSES,
    budget: int | str | None = None,
    blocks: int = BLOCKS,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """`keep` columns of docs (default: all) with n_tokens, the source's weight, how many
    copies of the row the mixture takes, and its place's hash within a pass's block.

    budget: tokens; "corpus" for as many as there are; None for one pass of each
    source at least. The sources' totals go to the driver (one row a source, with
    its weight); rows are shuffled once, by source and block.
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c not in OUT]
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    keys = {
        "__src": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")),
        "__n": F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
        "__order": digest,
        "__block": F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int"),
        "__tie": F.xxhash64(text_col),
    }
    keyed = docs.withColumns(keys)
    totals = cut(keyed.groupBy("__src", "__block").agg(F.sum("__n").alias("t")))
    tokens = {r["__src"]: r["t"] for r in totals.groupBy("__src").agg(F.sum("t").alias("t")).collect()}
    _, w, times = solve(tokens, target, limit, sum(tokens.values()) if budget == "corpus" else budget)
    rows = []
    for s, t in tokens.items():
        whole = math.floor(times.get(s, 1.0) + 1e-9)
        rows.append((s, float(w.get(s, 0.0)), whole, round(max(0.0, times.get(s, 1.0) - whole) * t)))
    plan = spark.createDataFrame(rows or [("", 0.0, 1, 0)], "__src string, weight double, __whole int, __part long")
    # where each block begins in the last, partial pass: blocks in that pass's order
    turn = F.md5(F.concat_ws("|", F.lit(SEED), F.lit("pass"), "__src", F.col("__block").cast("string")))
    order = Window.partitionBy("__src").orderBy(turn, "__block").rowsBetween(Window.unboundedPreceding, 0)
    ahead = totals.withColumn("__before", F.sum("t").over(order) - F.col("t")).join(plan, "__src").drop("t")
    within = Window.partitionBy("__src", "__block").orderBy("__order", "__n", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.select(*kept, *keys).withColumn("__upto", F.sum("__n").over(within))
    taken = (F.col("__before") + F.col("__upto") <= F.col("__part")) & (F.col("__n") > 0)
    drawn = lambda p, *by: F.md5(F.concat_ws("|", F.lit(SEED), p.cast("string"), *by))
    place = lambda p: F.struct(
        p.alias("pass"),
        F.when(p > F.col("__whole"), turn).otherwise(drawn(p, "__src", F.col("__block").cast("string"))).alias("block_at"),
        F.when(p > F.col("__whole"), F.col("__order")).otherwise(drawn(p, F.col("__order"))).alias("row_at"),
    )
    mixed = placed.join(ahead, ["__src", "__block"]).withColumn("__copies", (F.col("__whole") + F.when(taken, 1).otherwise(0)).cast("int"))
    return mixed.select(
        *kept,
        F.col("__n").alias("n_tokens"),
        "weight",
        F.col("__copies").alias("copies"),
        F.col("__order").alias("pass_order"),
        F.when(F.col("__copies") > 0, F.transform(F.sequence(F.lit(1), F.col("__copies")), place)).alias("places"),
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mixture: each document as often as its source's passes take it, with the
    pass, and block_at and row_at, by which a source's pass is ordered (columns so named are replaced)."""
    kept = [c for c in docs.columns if c not in ("pass", "block_at", "row_at")]
    keys = [F.col(c).alias(f"__own_{i}") for i, c in enumerate(kept)]
    own = {k: docs[options.get(k, d)] for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    held = docs.select(*keys, *(c.alias(f"__{k}") for k, c in own.items()))
    options = {k: v for k, v in options.items() if k not in own} | {k: f"__{k}" for k in own}
    out = mix(held, keep=tuple(f"__own_{i}" for i in range(len(kept))), **options)
    rows = out.select(*(F.col(f"__own_{i}").alias(c) for i, c in enumerate(kept)), F.explode("places").alias("__place"))
    return rows.select(*kept, "__place.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, budget="corpus", keep=("doc_id", "source")).withColumn("weight", F.round("weight", 9)).drop("places")
