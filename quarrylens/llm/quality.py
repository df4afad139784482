"""Quality rules: base text statistics, then robust multivariate outliers per language and source.

DataFrame functions only. Statistics are computed in one scan and written; the estimates iterate over that narrow
table.
"""

from __future__ import annotations

import functools
import operator
import statistics

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarrylens.llm._shared import materialize, setting

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a group's rows that its estimate rests on, and the share of a clean normal population that would be rejected.
SUPPORT, REJECT = 0.75, 1e-9
#: Rows' worth of weight that the wider population (the language for a source, all texts for a language) has in an estimate.
PRIOR_ROWS = 50.0
#: Distances are ranked in this many bins an octave.
BINS = 16
#: A concentration ends when the log-determinant falls by no more than this.
LEAST_FALL = 1e-3
FEATURES = ("f_words", "f_chars", "f_symbols", "f_lines", "f_repeats")
#: Variance added to each statistic. Most texts have no symbols and no repeats, so their spread in the core of a group is
#: nothing; some repeated lines or phrases do not make a text an outlier, a share of symbols like that of words does. Those of
#: the repeats are about the variance over all passing texts; in a group without any, half the lines or words alone reject.
LEAST_VARIANCE = (0.05, 0.0016, 0.12, 0.28, 0.28)


def _windows(words: Column) -> Column:
    """The hashes of all 3-word windows; sorted with their places, equal ones become neighbours."""
    n = F.size(words)
    hashes = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 4, hashes).otherwise(F.array().cast("array<bigint>"))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def add_statistics(documents: DataFrame) -> DataFrame:
    """``documents`` with a struct ``_q`` of the statistics of every whole text (null: no words).

    n_words; word_chars (code points in words); n_symbols; n_dup_lines (lines with a word equal to an earlier one);
    n_lines (lines with a word); n_repeat_words (words in 3-word windows that occur twice or more, the first included;
    windows are compared by a 64-bit hash within their own text).
    """
    df = documents.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))).withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    df = df.withColumn("_h", _windows(F.col("_words")))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_h", F.when(some, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i: (i > 0) & (F.get("_h", i - 1)["h"] == x["h"]) | F.coalesce(F.get("_h", i + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_h", F.sort_array(F.transform(F.filter("_h", same), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_h", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_h", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    values = (
        F.size("_words"),
        F.length("_t") - F.length(F.regexp_replace("_t", WORD, "")),
        F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", "")),
        F.size("_lines") - F.size(F.array_distinct("_lines")),
        F.size("_lines"),
        F.coalesce(covered, F.lit(0)),
    )
    return df.withColumn("_q", F.struct(*[v.cast("long").alias(n) for n, v in zip(STATISTICS, values, strict=True)])).drop("_t", "_lines", "_words", "_h")


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _features(stats: DataFrame) -> DataFrame:
    """Transformed statistic vectors: logs of sizes and ratios, so that clean text is about normal."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c, of: F.log1p(100.0 * F.col(c) / of)
    return stats.select(
        "*",
        F.log(n).alias("f_words"),
        F.log(F.greatest(F.col("word_chars") / n, F.lit(0.1))).alias("f_chars"),
        share("n_symbols", n).alias("f_symbols"),
        share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)).cast("double")).alias("f_lines"),
        share("n_repeat_words", n).alias("f_repeats"),
    )


def _total(columns) -> Column:
    return functools.reduce(operator.add, columns)


_D = len(FEATURES)
_SQUARE = [(i, j) for i in range(_D) for j in range(_D)]
#: Sums are symmetric: each product is summed once, and each place of the square takes its sum.
_PAIRS = [(i, j) for i, j in _SQUARE if i <= j]
_PLACES = [*range(_D + 1), *(_D + 1 + _PAIRS.index((min(i, j), max(i, j))) for i, j in _SQUARE)]
_MODEL = ("mean", "cov", "inv", "det")


def _model(floors: tuple[float, ...]):
    """A function that adds the estimate to each row of sums: ``mean``, ``cov`` (row after row), its inverse ``inv`` and log-determinant ``det``.

    ``v`` holds weighted sums over a group's rows, taken from the prior's mean: the weight, the statistics, their products.
    The prior (mean ``p``, covariances ``t``) takes part as PRIOR_ROWS rows. ``floors`` are added to the variances before
    inversion: a statistic that hardly varies in a group cannot reject by noise alone. A symmetric matrix is inverted by sweeping
    out one pivot after the other; the determinant is the product of the pivots.
    """
    weight = F.col("v")[0] + PRIOR_ROWS
    row, column = lambda q: F.floor(q / _D).cast("int"), lambda q: q % _D
    mean = F.transform("p", lambda x, i: x + F.get("v", i + 1) / weight)
    cov = F.transform("t", lambda x, q: (F.get("v", q + _D + 1) + PRIOR_ROWS * x) / weight - F.get("v", row(q) + 1) * F.get("v", column(q) + 1) / (weight * weight))
    full = F.transform("cov", lambda x, q: x + F.when(row(q) == column(q), F.get(F.array(*map(F.lit, floors)), column(q))).otherwise(0.0))

    def sweep(acc: Column, k: Column) -> Column:
        a, pivot = acc["a"], F.get(acc["a"], k * (_D + 1))
        at = lambda i, j: F.get(a, i * _D + j)

        def swept(x: Column, q: Column) -> Column:
            i, j = row(q), column(q)
            return F.when((i == k) & (j == k), -1.0 / pivot).when((i == k) | (j == k), x / pivot).otherwise(x - at(i, k) * at(k, j) / pivot)

        return F.struct(F.transform(a, swept).alias("a"), (acc["det"] + F.log(pivot)).alias("det"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(_D - 1)), F.struct(full.alias("a"), F.lit(0.0).alias("det")), sweep).alias("swept")
    first = [F.col("*"), mean.alias("mean"), cov.alias("cov")]
    last = [F.transform("swept.a", lambda x: -x).alias("inv"), F.col("swept.det").alias("det")]
    return lambda sums: sums.select(*first).select("*", done).select(*[c for c in sums.columns if c != "v"], "mean", "cov", *last)


def _from(center: str, name: str) -> list[Column]:
    """The statistics from a centre, as columns of their own, so that what is made of them stays short to plan."""
    return [(F.col(f) - F.col(center)[i]).alias(f"{name}{i}") for i, f in enumerate(FEATURES)]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row to the estimate beside it, from columns ``c`` (see ``_from``) and ``inv``."""
    return _total([F.col(f"c{i}") * F.col(f"c{j}") * F.col("inv")[i * _D + j] * (1.0 if i == j else 2.0) for i, j in _PAIRS])


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    z = statistics.NormalDist().inv_cdf(p)
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


def _sums() -> Column:
    """Sums over rows of one, of the statistics from the prior's mean (columns ``y``), and of their products, each once."""
    y = [F.col(f"y{i}") for i in range(_D)]
    of = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    return F.array(of(F.lit(1.0)), *[of(x) for x in y], *[of(y[i] * y[j]) for i, j in _PAIRS])


def _square(sums: Column) -> Column:
    """``_sums`` with all products, row after row."""
    return F.transform(F.lit(_PLACES), lambda k: F.get(sums, k))


def _nearest(rows: Column) -> Column:
    """The sums over the ``rows`` rows that lie closest, from ``bins`` (bin and sums): of the bin on the edge in part."""

    def add(acc: Column, x: Column) -> Column:
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rows - acc["before"]) / x["v"][0]))
        return F.struct((acc["before"] + x["v"][0]).alias("before"), F.zip_with(acc["sums"], x["v"], lambda s, y: s + part * y).alias("sums"))

    none = F.struct(F.lit(0.0).alias("before"), F.array_repeat(F.lit(0.0), 1 + _D + len(_PAIRS)).alias("sums"))
    return F.aggregate(F.sort_array("bins"), none, add)["sums"]


def _quartiles() -> list[Column]:
    return [F.percentile_approx(f, [0.25, 0.5, 0.75], 2000) for f in FEATURES]


def _spread(i: int) -> Column:
    """The variance of a normal population with the quartiles of statistic i in column ``q``."""
    return F.pow((F.col("q")[i][2] - F.col("q")[i][0]) / 1.349, 2)


def estimates(rows: DataFrame, prior: DataFrame, floors: tuple[float, ...] = LEAST_VARIANCE, support: float = SUPPORT) -> DataFrame:
    """Minimum-covariance-determinant location and scatter per ``grp``: mean, cov, inv, det and scale.

    ``rows``: grp and FEATURES. ``prior``: a row per grp with the wider population's mean ``p``, covariances ``t`` and
    ``p_scale``; it takes part as PRIOR_ROWS rows, so that a group of any size has a sound estimate and its own rows
    come to prevail as it grows. Three starts (the medians and quartiles, the prior, all rows) are concentrated side by
    side: each step takes the ``support`` share of the rows that lie closest, and their mean and covariance with the
    prior's; a start is done when the determinant no longer falls. The least determinant wins. The scatter is then scaled
    so that the median distance is that of a normal population. A step is one pass: distances fall into bins of a 16th of
    an octave, each with its sums, and the bin on the edge is taken in part. The narrow table is joined to a row per group
    and start, which is broadcast where its file is small, and is aggregated map-side to a row per bin, so a group may
    hold any share of the rows.
    """
    first = rows.join(prior, "grp").select("grp", *FEATURES, *_from("p", "y")).groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*_quartiles()).alias("q"), _sums().alias("all"))
    first = first.join(prior, "grp").withColumn("all", _square(F.col("all")))
    n, zero = F.col("n"), F.lit(0.0)
    middle = [F.col("q")[i][1] - F.col("p")[i] for i in range(_D)]
    spread = [_spread(i) for i in range(_D)]
    from_quartiles = F.array(n, *[n * m for m in middle], *[n * (middle[i] * middle[j] + (spread[i] if i == j else zero)) for i, j in _SQUARE])
    starts = [F.struct(F.lit(k).alias("start"), v.alias("v")) for k, v in enumerate((from_quartiles, F.transform("all", lambda x: zero), F.col("all")))]
    kept = ("grp", "n", "p", "t", "p_scale")
    state = first.select(*kept, F.explode(F.array(*starts)).alias("x")).select(*kept, "x.*")
    with_model = _model(floors)
    state = materialize(with_model(state).withColumn("done", F.lit(False)), "mcd")
    # expressions of the steps, built once
    at = F.floor(BINS * F.log2(F.greatest(_distance(), F.lit(1e-9)))).cast("int").alias("bin")
    y = [f"y{i}" for i in range(_D)]
    v = _square(_nearest(support * (n - 1))).alias("v")
    better = F.when(F.col("det") < F.col("old.det"), F.struct(*_MODEL)).otherwise(F.col("old")).alias("x")
    unsettled = 1
    while unsettled:
        active = state.where(~F.col("done")).drop("done")
        measured = rows.join(active.select("grp", "start", "mean", "inv", "p"), "grp").select("grp", "start", "inv", *_from("mean", "c"), *_from("p", "y"))
        bins = measured.select("grp", "start", at, *y).groupBy("grp", "start", "bin").agg(_sums().alias("v"))
        bins = bins.groupBy("grp", "start").agg(F.collect_list(F.struct("bin", "v")).alias("bins"))
        both = active.select(*kept, "start", F.struct(*_MODEL).alias("old")).join(bins, ["grp", "start"])
        new = with_model(both.select(*kept, "start", "old", v))
        step = new.select(*kept, "start", (F.col("old.det") - F.col("det") <= LEAST_FALL).alias("done"), better).select(*kept, "start", "x.*", "done")
        seen = Observation()
        state = materialize(state.where("done").unionByName(step).observe(seen, F.count_if(~F.col("done")).alias("unsettled")), "mcd")
        unsettled = seen.get["unsettled"]
    best = materialize(state.groupBy("grp").agg(F.min_by(F.struct("n", "p_scale", *_MODEL), F.struct("det", "start")).alias("x")).select("grp", "x.*"), "mcd")
    median = rows.join(best, "grp").select("grp", "inv", *_from("mean", "c")).groupBy("grp").agg(F.percentile_approx(_distance(), 0.5, 10_000).alias("med"))
    own = F.greatest(F.col("med") / chi2_quantile(0.5, _D), F.lit(1.0))
    share = n / (n + PRIOR_ROWS)
    scale = F.exp(share * F.log(own) + (1 - share) * F.log("p_scale"))
    return materialize(best.join(median, "grp").withColumn("scale", scale).drop("med", "p_scale"), "mcd")


def _name(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?"))


def fit(stats: DataFrame) -> DataFrame:
    """The estimate of each language and source of ``stats`` (gl, gs, base_failed and FEATURES) that has a passing row.

    All passing rows come first (their prior has their medians and the spread of their quartiles), then each language with that estimate
    as its prior, then each source of a language with the language's. No group size changes the rule.

    The steps are many short jobs over narrow rows. They run without whole-stage code, which the driver would generate and
    compile for every stage of every step.
    """
    with setting(stats.sparkSession, "spark.sql.codegen.wholeStage", "false"):
        return _fit(stats)


def _fit(stats: DataFrame) -> DataFrame:
    passing = stats.where(~F.col("base_failed")).select("gl", "gs", *FEATURES)
    whole = F.array().cast("array<string>")
    quartiles = passing.agg(F.count(F.lit(1)).alias("n"), F.array(*_quartiles()).alias("q")).where("n > 0")
    spread = F.array(*[_spread(i) if i == j else F.lit(0.0) for i, j in _SQUARE])
    prior = materialize(quartiles.select(whole.alias("grp"), F.transform("q", lambda x: x[1]).alias("p"), spread.alias("t"), F.lit(1.0).alias("p_scale")), "prior")
    model = None
    for names in ((), ("gl",), ("gl", "gs")):
        key = F.array(*names) if names else whole
        if model is not None:
            above = model.select(F.col("grp").alias("over"), F.col("mean").alias("p"), F.col("cov").alias("t"), F.col("scale").alias("p_scale"))
            groups = passing.select(key.alias("grp")).distinct().withColumn("over", F.slice("grp", 1, len(names) - 1))
            prior = materialize(groups.join(above, "over").drop("over"), "prior")
        model = estimates(passing.select(key.alias("grp"), *FEATURES), prior)
    return model.select(F.col("grp")[0].alias("gl"), F.col("grp")[1].alias("gs"), "mean", "inv", "scale")


def _verdict(keyed: DataFrame, model: DataFrame, reject: float) -> DataFrame:
    judged = keyed.join(model, ["gl", "gs"], "left").select("*", *_from("mean", "c")).withColumn("distance", _distance() / F.col("scale"))
    judged = judged.drop(*[f"c{i}" for i in range(_D)])
    limit = chi2_quantile(1 - reject, _D)
    # one expression over both sides of the join: as a conjunction, a filter on it would be pushed down in part and would
    # compute the statistics again
    return judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.col("distance") <= limit))


def _narrow(documents: DataFrame) -> DataFrame:
    """doc_id, group, statistics and features, written."""
    rows = add_statistics(documents).select(F.col("doc_id").cast("long").alias("doc_id"), _name("lang").alias("gl"), _name("source").alias("gs"), "_q.*")
    return materialize(_features(rows.withColumn("base_failed", _base_failed())), "quality")


def judge(documents: DataFrame, reject: float = REJECT) -> DataFrame:
    """doc_id, the statistics, ``distance`` (squared robust Mahalanobis, null only where no row of the language and source
    passes the base rules) and ``kept`` of every document: false if base_failed, else false if the distance is beyond the ``1 - reject`` quantile.

    Null lang or source is a group of its own; null text has no words and fails the base rules; repeated rows count
    and are judged once each; other columns are ignored; an empty table gives no rows.
    """
    stats = _narrow(documents)
    return _verdict(stats, fit(stats), reject)


def keep_good(documents: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns. All are written once beside their statistics; the estimates read the statistics' columns alone, and no text is shuffled."""
    rows = add_statistics(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), "text", "lang", "source"))
    rows = rows.select("_row", _name("lang").alias("gl"), _name("source").alias("gs"), "_q.*")
    # written before any filter, which would be pushed down into the statistics and compute them again for every word
    judged = materialize(_features(rows.withColumn("base_failed", _base_failed())), "judged")
    return _verdict(judged, fit(judged), reject).where("kept").select("_row.*")


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
