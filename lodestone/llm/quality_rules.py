"""Quality rules (operator 8): fixed base rules, then robust multivariate outliers.

Everything is DataFrame functions. The base statistics come from each text alone. The rows that pass the base rules are
then judged against their language and source by the Mahalanobis distance from a minimum-covariance-determinant
estimate of a vector of transformed statistics.

An estimate is sought from four deterministic starts: medians with absolute deviations, spatial signs, ranks, and normal
scores. Each is concentrated (the core are the rows that are nearest to the estimate, and the next estimate is the
core's mean and covariance) until its determinant falls no more, and the start with the least determinant wins. A fixed
least variance is added to each part's, so that an estimate is never singular: the determinant is that of a regularized
estimate. Estimates are made for each language and source, each language, and all rows, and a small group's is drawn to
its language's, and that to all rows', in proportion to n / (n + SHRINK_ROWS), whatever n is.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import WORD, beside, written

WINDOW = 5
#: Share of a group's rows that the estimate rests on.
CORE = 0.75
#: Rows of a group at which its own estimate and its language's weigh the same.
SHRINK_ROWS = 100
#: Fall of a determinant's logarithm below which an estimate is settled.
SETTLED = 1e-6
#: Square of the distance beyond which a row is rejected: the 0.9999 quantile of chi-square with 5 degrees of freedom.
CUT = 25.74
MEDIAN_CHI2 = 4.351
#: Names of the vector's parts and the least standard deviation of each, which is added to every estimate. Most texts
#: have no symbols or repeated lines at all, so these say how far off a text must be where all others are equal.
PARTS = {"length": 0.1, "symbols": 0.5, "lines": 0.15, "repeats": 0.1, "capitals": 0.1}
NAMES, FLOORS = list(PARTS), list(PARTS.values())
P = len(PARTS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Quantiles that ranks are read from.
QUANTILES = 32
STARTS = ("medians", "signs", "ranks", "normal scores")
#: Estimates are broadcast up to this many groups; beyond it the join shuffles, each group dealt to SALTS places.
BROADCAST_GROUPS = 20_000
SALTS = 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and n_capitals.

    A null text counts as empty: all counts are 0 and it fails, having under 10 words. Windows of five words are
    compared by 64-bit hashes within their document. Older columns of these names are replaced.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_capitals")
    own = ("_words", "_lines", "_symbols", "_capitals", "_grams", "_ordered", "_places")
    keep = [F.col(f"`{c}`") for c in beside(docs.columns, *new, *own)]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    first = docs.select(*keep, words_of(F.col("text")).alias("_words"), lines.alias("_lines"), F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("_symbols"), F.regexp_count(text, F.lit("\\p{Lu}")).alias("_capitals"))
    words, n = F.col("_words"), F.size("_words")
    window = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window))
    hashed = first.select(*keep, n.cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), F.col("_symbols").cast("long").alias("n_symbols"), F.col("_capitals").cast("long").alias("n_capitals"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), grams.alias("_grams"))
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    ordered = F.when(repeats, F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    sorted_ = hashed.withColumn("_ordered", ordered).drop("_grams")
    same = lambda k, x: F.coalesce(F.get("_ordered", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_ordered", lambda x, k: same(k - 1, x) | same(k + 1, x))
    placed = sorted_.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["at"]))).drop("_ordered")
    places, m = F.col("_places"), F.size("_places")
    gaps = F.zip_with(F.slice(places, 2, m - 1), F.slice(places, 1, m - 1), lambda b, a: F.least(F.lit(WINDOW), b - a))
    covered = F.when(m > 0, F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0)
    counted = placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(*keep, *new[:5], failed.alias("base_failed"), "n_capitals")


def vector() -> dict[str, Column]:
    """The transformed statistics. The mean word length of a short text varies more, so it is drawn to 5 characters."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    weight = F.sqrt(F.least(n, F.lit(200)) / 200.0)
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": F.log(chars / n / 5.0) * weight,
        "symbols": F.log1p(100.0 * F.col("n_symbols") / n),
        "lines": F.col("n_dup_lines") / (F.col("n_dup_lines") + 2.0),
        "repeats": F.col("n_repeat_words") / n,
        "capitals": F.col("n_capitals") / chars,
    }


def with_groups(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """rows (with _group) beside the estimates of their group; rows without one stay."""
    if few:
        return rows.join(F.broadcast(estimates), "_group", "left")
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    dealt = estimates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(dealt, ["_group", "_salt"], "left").drop("_salt")


def factored(estimates: DataFrame) -> DataFrame:
    """A table of the estimates with the lower triangle w_i_j of the inverse of the Cholesky factor c_i_j of the
    covariances v_i_j, and the logarithm of the determinant's root. A table, since each of these builds on those before."""
    made = []
    for i, j in PAIRS:
        rest = " - ".join([f"v_{i}_{j}", *(f"c_{i}_{k} * c_{j}_{k}" for k in range(j))])
        made.append(f"sqrt(greatest({rest}, 1e-12D)) AS c_{i}_{j}" if i == j else f"({rest}) / c_{j}_{j} AS c_{i}_{j}")
    for i, j in PAIRS:
        rest = "1D" if i == j else " ".join(f"- c_{i}_{k} * w_{k}_{j}" for k in range(j, i))
        made.append(f"({rest}) / c_{i}_{i} AS w_{i}_{j}")
    made.append(" + ".join(f"ln(c_{i}_{i})" for i in range(P)) + " AS logdet")
    found = estimates.selectExpr("*", *made).drop(*(f"c_{i}_{j}" for i, j in PAIRS))
    return written(found, "quality-estimate")


def squared_distance() -> Column:
    """The squared Mahalanobis distance of a row's parts from the estimate beside it."""
    away = lambda i: sum(F.col(f"w_{i}_{j}") * (F.col(NAMES[j]) - F.col(f"m_{j}")) for j in range(i + 1))
    return sum(F.pow(away(i), F.lit(2.0)) for i in range(P))


def floored(i: int, j: int, covariance: Column) -> Column:
    return (covariance + FLOORS[i] ** 2 if i == j else covariance).alias(f"v_{i}_{j}")


def starts(bare: DataFrame, few: bool) -> DataFrame:
    """The first estimates of each group (_group, start), all around the medians, with n, the group's rows."""
    shares = [k / QUANTILES for k in range(1, QUANTILES)]
    table = bare.groupBy("_group").agg(F.count("*").alias("n"), *(F.percentile_approx(x, shares).alias(f"q_{i}") for i, x in enumerate(NAMES)))
    table = written(table.select("*", *(F.get(f"q_{i}", QUANTILES // 2 - 1).alias(f"m_{i}") for i in range(P))), "quality-quantiles")
    away = with_groups(bare, table.select("_group", *(f"m_{i}" for i in range(P))), few)
    spread = away.groupBy("_group").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5).alias(f"_mad_{i}") for i, x in enumerate(NAMES)))
    scales = [F.sqrt((1.4826 * F.col(f"_mad_{i}")) ** 2 + FLOORS[i] ** 2).alias(f"s_{i}") for i in range(P)]
    table = written(table.join(spread.select("_group", *scales), "_group"), "quality-scales")
    normal = F.lit([NormalDist().inv_cdf((k + 0.5) / (2 * QUANTILES - 1)) for k in range(2 * QUANTILES - 1)])
    rows = with_groups(bare, table, few)
    place = lambda i, x: F.size(F.filter(f"q_{i}", lambda q: q < F.col(x))) + F.size(F.filter(f"q_{i}", lambda q: q <= F.col(x)))
    rows = rows.select("_group", *(((F.col(x) - F.col(f"m_{i}")) / F.col(f"s_{i}")).alias(f"z_{i}") for i, x in enumerate(NAMES)), *(place(i, x).alias(f"p_{i}") for i, x in enumerate(NAMES)))
    rows = rows.withColumn("_length", F.sqrt(sum(F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(P))))
    signs = [F.when(F.col("_length") > 0, F.col(f"z_{i}") / F.col("_length")).otherwise(0.0).alias(f"u_{i}") for i in range(P)]
    rows = rows.select("_group", *signs, *((F.col(f"p_{i}") - QUANTILES + 1).cast("double").alias(f"r_{i}") for i in range(P)), *(F.get(normal, F.col(f"p_{i}")).alias(f"g_{i}") for i in range(P)))
    products = [F.avg(F.col(f"{k}_{i}") * F.col(f"{k}_{j}")).alias(f"{k}_{i}_{j}") for k in "urg" for i, j in PAIRS]
    table = written(table.join(rows.groupBy("_group").agg(*products), "_group"), "quality-starts")
    scale = lambda i, j: F.col(f"s_{i}") * F.col(f"s_{j}")
    whole = lambda k, i, j: F.sqrt(F.col(f"{k}_{i}_{i}") * F.col(f"{k}_{j}_{j}"))
    shape = {
        "medians": lambda i, j: F.lit(float(i == j)),
        "signs": lambda i, j: P * F.col(f"u_{i}_{j}"),
        "ranks": lambda i, j: F.when(whole("r", i, j) > 0, F.col(f"r_{i}_{j}") / whole("r", i, j)).otherwise(float(i == j)),
        "normal scores": lambda i, j: F.when(whole("g", i, j) > 0, F.col(f"g_{i}_{j}") / whole("g", i, j)).otherwise(float(i == j)),
    }
    found = [table.select("_group", "n", F.lit(name).alias("start"), *(f"m_{i}" for i in range(P)), *(floored(i, j, scale(i, j) * shape[name](i, j)) for i, j in PAIRS)) for name in STARTS]
    return factored(written(reduce(DataFrame.unionByName, found), "quality-starts"))


SHAPE = [*(f"m_{i}" for i in range(P)), *(f"w_{i}_{j}" for i, j in PAIRS)]


def concentrated(bare: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """The estimate that one step makes of each: mean and covariance of the share CORE of the rows that is nearest."""
    key = ["_group", "n", "start"]
    far = with_groups(bare, estimates.select(*key, *SHAPE), few).filter("start IS NOT NULL")
    limit = written(far.groupBy(*key).agg(F.percentile_approx(squared_distance(), CORE).alias("_limit")), "quality-limits")
    limited = estimates.select(*key, *SHAPE).join(limit.select("_group", "start", "_limit"), ["_group", "start"])
    core = with_groups(bare, limited, few).filter(F.col("start").isNotNull() & (squared_distance() <= F.col("_limit")))
    moments = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(NAMES)] + [floored(i, j, F.covar_pop(NAMES[i], NAMES[j])) for i, j in PAIRS]
    return factored(core.groupBy(*key).agg(*moments))


def estimate(bare: DataFrame, few: bool) -> DataFrame:
    """The estimate of each group of bare (_group and the parts) with the least determinant, with n and logdet."""
    settled, active = None, concentrated(bare, starts(bare, few), few)
    while not active.isEmpty():
        before = active.select("_group", "start", F.struct(*(c for c in active.columns if c not in ("_group", "start"))).alias("before"))
        after = concentrated(bare, active, few)
        after = after.select("_group", "start", F.struct(*(c for c in active.columns if c not in ("_group", "start"))).alias("after"))
        steps = before.join(after, ["_group", "start"])
        falls = F.col("after.logdet") < F.col("before.logdet") - SETTLED
        still = steps.filter(~falls).select("_group", "start", "before.*")
        settled = still if settled is None else settled.unionByName(still)
        active = steps.filter(falls).select("_group", "start", "after.*")
    if settled is None:
        return active
    best = settled.groupBy("_group").agg(F.min_by(F.struct(*(c for c in settled.columns if c != "_group")), F.struct("logdet", "start")).alias("best"))
    return written(best.select("_group", "best.*"), "quality-estimate")


def rescaled(bare: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """The estimates with covariances such that half of a group's rows are within the chi-square median, but no smaller."""
    far = with_groups(bare, estimates.select("_group", *SHAPE), few)
    scale = far.groupBy("_group").agg(F.greatest(F.percentile_approx(squared_distance(), 0.5) / MEDIAN_CHI2, F.lit(1.0)).alias("_scale"))
    found = estimates.join(scale, "_group")
    return found.select("_group", "n", *(f"m_{i}" for i in range(P)), *((F.col(f"v_{i}_{j}") * F.col("_scale")).alias(f"v_{i}_{j}") for i, j in PAIRS))


def shrunk(groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """Factored estimates of groups (_own, _wider, _widest: keys of estimates), each drawn to the wider ones'."""
    values = [f"m_{i}" for i in range(P)] + [f"v_{i}_{j}" for i, j in PAIRS]
    at = lambda k: estimates.select(F.col("_group").alias(k), F.struct("n", *values).alias(f"{k}_e"))
    found = groups.join(at("_own"), "_own").join(at("_wider"), "_wider").join(at("_widest"), "_widest")
    part = lambda k: F.col(f"{k}_e.n") / (F.col(f"{k}_e.n") + SHRINK_ROWS)
    drawn = lambda v: part("_own") * F.col(f"_own_e.{v}") + (1 - part("_own")) * (part("_wider") * F.col(f"_wider_e.{v}") + (1 - part("_wider")) * F.col(f"_widest_e.{v}"))
    return factored(found.select(F.col("_own").alias("_group"), *(drawn(v).alias(v) for v in values)))


def judge(docs: DataFrame) -> DataFrame:
    """docs (with text, lang, source), without the text, with the base statistics, base_failed, distance2 and kept.

    kept is false if the base rules fail, else whether the squared distance is at most CUT. A null language or source
    is one of its own. Repeated rows count each, and rows that are as far as the last of a core belong to it. A single
    row of its language and source is judged by its language almost alone. distance2 is null where the base rules fail.
    Very long texts are taken whole, in one row's arrays. An empty table gives an empty table. Other columns stay; older
    ones of these names are replaced, and of those named _words, _lines, _symbols, _capitals, _grams, _ordered, _places.
    """
    stats = base_statistics(docs.drop("distance2", "kept"))
    keep = beside(stats.columns, "text", "n_capitals")
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    named = lambda *columns: F.concat_ws("\x01", F.lit(str(len(columns))), *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns))
    keys = [named("lang", "source").alias("_own"), named("lang").alias("_wider"), named().alias("_widest")]
    rows = written(stats.select(row, *keys, "base_failed", *(c.alias(n) for n, c in vector().items())), "quality-statistics")
    good = rows.filter(~F.col("base_failed"))
    groups = written(good.select("_own", "_wider", "_widest").distinct(), "quality-groups")
    few = groups.count() < BROADCAST_GROUPS
    bare = written(good.select(F.explode(F.array("_own", "_wider", "_widest")).alias("_group"), *NAMES), "quality-vectors")
    estimates = written(rescaled(bare, estimate(bare, few), few), "quality-estimate")
    placed = with_groups(rows.select("row", "base_failed", F.col("_own").alias("_group"), *NAMES), shrunk(groups, estimates).select("_group", *SHAPE), few)
    away = placed.select("row", "base_failed", F.when(~F.col("base_failed"), squared_distance()).alias("_d2"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d2") <= CUT, F.lit(False))
    return away.select("row.*", F.col("_d2").alias("distance2"), kept.alias("kept"))
