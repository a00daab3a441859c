"""URL filters (operator 7): rules for hosts and paths, and logistic regression for every other URL.

The regression works on hashed character n-grams of host and path, kept apart by a mark, and is trained on a small
labelled table of URLs (url, label; 1 is a URL to block). The table beside this module, labelled_urls.csv, is made up;
judge() takes any other in its place. Everything runs in Spark's own functions and feature stages.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable
from pathlib import Path

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import beside

BUCKETS = 1 << 15
SIZES = (3, 4, 5)
SHRINK, STEPS = 1e-4, 100
#: The labelled table must be small: it is trained on as one partition, so that reruns agree to the last bit.
MAX_LABELLED = 20_000
#: A row of the labelled table is held out for evaluate() if crc32 of its URL is divisible by this.
FOLDS = 5
LABELLED = Path(__file__).with_name("labelled_urls.csv")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The table (url, label) beside this module."""
    with LABELLED.open(newline="") as file:
        rows = [(r["url"], int(r["label"])) for r in csv.DictReader(file)]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without :// or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def grams(mark: str, text: Column) -> Column:
    """The character n-grams of a text between marks of its ends, each behind the mark of what it is of."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        begins = F.sequence(F.lit(1), F.char_length(whole) - n + 1)
        here = F.transform(begins, lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))
        return F.when(F.char_length(whole) >= n, here).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*map(of_size, SIZES)))


def featured(rows: DataFrame) -> DataFrame:
    """rows (host, path) with features: which buckets their n-grams fall in, as a vector of length 1."""
    terms = rows.withColumn("terms", F.concat(grams("h", F.col("host")), grams("p", F.col("path"))))
    hashed = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="terms", outputCol="buckets").transform(terms).drop("terms")
    return Normalizer(inputCol="buckets", outputCol="features").transform(hashed).drop("buckets")


def train(labelled: DataFrame) -> LogisticRegressionModel | float:
    """The regression on a labelled table (url, label). Rows with a null in either teach nothing, repeated rows count each.
    Where a label is missing altogether, the share of label 1 takes the regression's place (a half without any row)."""
    rows = labelled.select("url", F.col("label").cast("double").alias("label")).dropna()
    seen = dict(rows.limit(MAX_LABELLED + 1).groupBy("label").count().collect())
    if sum(seen.values()) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    if not {0.0, 1.0} <= set(seen):
        return 1.0 if 1.0 in seen else 0.0 if seen else 0.5
    ordered = rows.repartition(1).sortWithinPartitions("url", "label")
    vectors = featured(ordered.select("label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    return LogisticRegression(maxIter=STEPS, regParam=SHRINK, standardization=False).fit(vectors)


def scored(rows: DataFrame, model: LogisticRegressionModel | float) -> DataFrame:
    """rows (host, path) with score, the probability that the URL is to be blocked."""
    if isinstance(model, float):
        return rows.withColumn("score", F.lit(model))
    found = model.transform(featured(rows))
    return found.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def evaluate(labelled: DataFrame, threshold: float = 0.5) -> dict[str, float]:
    """Precision, recall and rows of the fold that is held out, by a regression on the other folds."""
    held = F.crc32(F.col("url").cast("binary")) % FOLDS == 0
    parts = labelled.filter(held).select("label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    said = scored(parts, train(labelled.filter(~held))).select("label", (F.col("score") >= threshold).alias("block"))
    hit, blocked, bad, rows = said.agg(F.count_if(F.col("block") & (F.col("label") == 1)), F.count_if("block"), F.count_if(F.col("label") == 1), F.count("*")).first()
    return {"precision": hit / blocked if blocked else 1.0, "recall": hit / bad if bad else 1.0, "rows": rows}


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. rules: (verdict, "host/path")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict and score (the regression's probability that the URL is to be blocked).

    A rule's verdict stands before the regression's; of two rules of one length the later in code-point order stands.
    Null URLs and those without :// have an empty host and path, fit no rule and get the regression's verdict on empty
    texts. Very long URLs are taken whole, repeated rows are judged alike, and an empty table gives an empty one. Other
    columns stay, whatever their names; older ones of these five names are replaced.
    """
    keep = beside(pages.columns, "host", "path", "rule", "verdict", "score")
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    split = pages.select(row, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("row", "host", "path", rule.alias("rule"), said.alias("said"))
    found = scored(ruled, train(labelled_urls(pages.sparkSession) if labelled is None else labelled))
    verdict = F.coalesce("said", F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("row.*", "host", "path", "rule", verdict.alias("verdict"), "score")
