"""URL filters: given host and path rules, and association rules mined with FP-growth.

A url is a set of tokens: host labels, path segments that are not numbers, file
endings and query keys. Labelled urls, each with its label as one more token, are
mined by Spark's FP-growth; rules `tokens -> label` are pruned by support,
by confidence and by length, and a rule is dropped when a part of its tokens
already gives the same label as surely. The rest form an inverted index, a rule
posted under its rarest token only. Urls are matched by their distinct token sets:
the set is looked up by its tokens, what it meets is verified, and the surest rule
decides, so a host with a third of all urls is one set or few.

A given rule (host, path) fits its host and all subdomains if the url's path
starts with the rule's; the longest wins, and goes before all mined rules.

Edge cases: a null url, or one without `://`, has empty host and path and the
verdict of no tokens; where no mined rule fits, or none can be mined, the default
holds; null labels are not mined; repeated rows and null ids are kept; columns
named like an output are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table
from loomgraph.runtime import cut

SUPPORT, CONFIDENCE, TOKENS = 0.005, 0.8, 3
DEFAULT = "allow"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUT = ("host", "path", "rule", "verdict", "mined_rule", "confidence")


def parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def tokens(host: Column, path: Column, url: Column) -> Column:
    """The url's tokens, distinct and sorted; numbers (page and item ids) are none."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    names = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+(\.|$)"))
    segments = F.transform(names, lambda x: F.concat(F.lit("p:"), x))
    ending = F.array(F.concat(F.lit("e:"), F.regexp_extract(path, r"\.([A-Za-z]{1,6})$", 1)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^[^=]*", 0)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(labels, segments, ending, keys), lambda x: F.length(x) > 2)))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest given rule that fits, else null. Rules are a bounded list."""
    out = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out.append(F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*out, F.lit(None).cast("struct<rule:string,verdict:string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = TOKENS) -> DataFrame:
    """labelled (tokens, label) -> rules (antecedent sorted, label, confidence, support)."""
    spark = labelled.sparkSession
    items = labelled.where("label is not null").select(F.concat("tokens", F.array(F.concat(F.lit("="), "label"))).alias("items"))
    if items.isEmpty():
        return spark.createDataFrame([], "antecedent array<string>, label string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith("=") & (F.size("antecedent") <= most))
    found = found.where(~F.exists("antecedent", lambda x: x.startswith("=")))
    return cut(found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 1 << 20).alias("label"), "confidence", "support"))


def pruned(rules: DataFrame) -> DataFrame:
    """Rules of which no part gives the same label with at least the same confidence."""
    key = lambda c: F.array_join(c, "\u0001")
    one = F.transform("antecedent", lambda x: F.array_except("antecedent", F.array(x)))
    two = F.transform("antecedent", lambda x: F.array(x))
    less = rules.where(F.size("antecedent") > 1).select("antecedent", "label", "confidence", F.explode(F.array_distinct(F.concat(one, two))).alias("part"))
    smaller = rules.select(key("antecedent").alias("k"), F.col("label").alias("l"), F.col("confidence").alias("c"))
    vain = less.join(smaller, (key("part") == F.col("k")) & (F.col("label") == F.col("l")) & (F.col("c") >= F.col("confidence")))
    return rules.join(vain.select("antecedent", "label").distinct(), ["antecedent", "label"], "left_anti")


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    labels: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    keep: tuple[str, ...] | None = None,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """`keep` columns of pages (default: all) with host, path, rule, verdict, mined_rule and
    confidence. labels (id_col, label): more labelled urls beside those a given rule decides."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in OUT]
    host, path = parts(F.col(url_col))
    rows = pages.withColumns({"__host": host, "__path": path})
    rows = rows.withColumns({"__given": given_rule(F.col("__host"), F.col("__path"), rules), "__tokens": tokens(F.col("__host"), F.col("__path"), F.col(url_col))})
    rows = rows.withColumn("__set", F.array_join("__tokens", "\u0001"))
    known = rows.select(F.col("__tokens").alias("tokens"), F.col("__given.verdict").alias("label")).where("label is not null")
    if labels is not None:
        own = labels.select(F.col(id_col).alias("__id"), F.col("label").alias("__label"))
        more = rows.where("__given is null").join(own, F.col(id_col) == F.col("__id")).select(F.col("__tokens").alias("tokens"), F.col("__label").alias("label"))
        known = known.unionByName(more)
    found = pruned(mine(known, support, confidence))
    # how rare a token is: its count among the distinct sets that wait for a verdict
    sets = cut(rows.where("__given is null").groupBy("__set").agg(F.first("__tokens").alias("tokens")))
    spread = sets.select("__set", F.explode("tokens").alias("token"))
    rarity = spread.groupBy("token").count()
    places = found.select("*", F.explode("antecedent").alias("token")).join(rarity, "token")
    index = places.groupBy("antecedent", "label").agg(F.min(F.struct("count", "token")).alias("r"), F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.count("*").alias("n"))
    index = index.where(F.col("n") == F.size("antecedent")).select(F.col("r.token").alias("token"), "antecedent", "label", "confidence", "support")
    met = spread.join(index, "token").join(sets, "__set").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct("confidence", "support", F.array_join("antecedent", ",").alias("text"), "label")
    verdicts = met.groupBy("__set").agg(F.max(rank).alias("__best"))
    out = rows.join(verdicts, "__set", "left")
    return out.select(
        *kept,
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__given.rule").alias("rule"),
        F.coalesce("__given.verdict", "__best.label", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("__given").isNull(), F.col("__best.text")).alias("mined_rule"),
        F.when(F.col("__given").isNull(), F.col("__best.confidence")).alias("confidence"),
    )


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "mined_rule")
