"""Planned experiments and detectors: which runs of a plan are missing, and users' scoring functions side by side."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrylens.operators.evaluation import confusion, score_summary
from quarrylens.operators.facts import same_rows

#: The modes of a run, and the parameters of a plan that all its runs share.
MODES = ("sequence", "gnn", "fusion")
WHOLE = ("epochs", "hidden", "max_length", "split_seed")
REAL = ("learning_rate", "threshold")
PRINTS = ("dataset_sha256", "splits_sha256")
_PRINT = re.compile(r"[0-9a-f]{64}")
RUN = "mode string, seed long, epochs long, hidden long, max_length long, split_seed long, learning_rate double, threshold double, dataset_sha256 string, splits_sha256 string, encoder_sha256 string"


def plan_problems(plan: dict) -> list[str]:
    """What makes a plan (modes, seeds, and the parameters above) no sound one; none if it is."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    real = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    printed = lambda v: isinstance(v, str) and bool(_PRINT.fullmatch(v))
    modes, seeds = plan.get("modes"), plan.get("seeds")
    out = []
    if plan.get("schema_version") != "1.0":
        out.append("unknown schema version")
    if not isinstance(modes, list) or not modes or any(m not in MODES for m in modes) or len(set(modes)) < len(modes):
        out.append("modes")
        modes = []
    if not isinstance(seeds, list) or len(seeds) < 2 or not all(whole(s) and 0 <= s < 2**32 for s in seeds) or len(set(seeds)) < len(seeds):
        out.append("seeds")
    out += [k for k in PRINTS if not printed(plan.get(k))]
    out += [k for k in WHOLE if not whole(plan.get(k))]
    bounds = {"epochs": (1, math.inf), "hidden": (4, math.inf), "max_length": (8, 512)}
    out += [k for k, (a, b) in bounds.items() if whole(plan.get(k)) and not a <= plan[k] <= b]
    out += [k for k in REAL if not real(plan.get(k)) or not 0 <= plan[k] <= 1 or (k == "learning_rate" and plan[k] == 0)]
    if any(m != "gnn" for m in modes) and not printed(plan.get("encoder_sha256")):
        out.append("encoder_sha256")
    return out


def planned_runs(spark: SparkSession, plan: dict) -> DataFrame:
    """A row for each mode and seed of a sound plan, with all its parameters; the encoder's only where a mode has one."""
    if bad := plan_problems(plan):
        raise ValueError(f"the plan is not sound: {', '.join(bad)}")
    shared = [plan[k] for k in WHOLE] + [float(plan[k]) for k in REAL] + [plan[k] for k in PRINTS]
    return spark.createDataFrame([(m, s, *shared, None if m == "gnn" else plan["encoder_sha256"]) for m in plan["modes"] for s in plan["seeds"]], RUN)


def missing_runs(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """The planned runs that are not stored. A stored run that the plan does not have, whole with all parameters (the plan
    was changed), or has once but is stored twice, is an error: results of two plans are not mixed."""
    names = planned.columns
    surplus = same_rows(planned, stored.select(*names))  # how often the plan has a run more than the store
    if bad := surplus.where("surplus < 0").first():
        raise ValueError(f"a stored run is not as planned: {bad.mode} with seed {bad.seed}")
    return surplus.where("surplus > 0").select(*names)


# Detectors -----------------------------------------------------------------------------------------------------------

#: What a detector gives for each row: a probability, and ranked lines or null.
SCORES = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("ranked", T.ArrayType(T.IntegerType()))])
Detector = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _fits(batch: pa.RecordBatch) -> None:
    want = to_arrow_schema(SCORES)
    if batch.schema.names != want.names or any(a.type != b.type and not (pa.types.is_list(a.type) and pa.types.is_list(b.type) and a.type.value_type == b.type.value_type) for a, b in zip(batch.schema, want, strict=True)):
        raise TypeError(f"a detector gave {batch.schema.to_string()}, not {want.to_string()}")


def check_detector(detector: Detector, rows: DataFrame) -> None:
    """Run a detector over an empty batch of the rows' schema: what it gives must have the schema SCORES. Before any job."""
    schema = to_arrow_schema(rows.schema)
    for batch in detector(iter([pa.RecordBatch.from_pylist([], schema)])):
        _fits(batch)


def detect(rows: DataFrame, detectors: dict[str, Detector]) -> DataFrame:
    """detector and its SCORES for all ``rows`` (with sample_id). A detector is an Arrow iterator: it may keep a model while
    its batches last, and sees a batch at a time. Each is checked on an empty batch first, and every batch it gives when
    it is made; a probability that is null, no number or outside 0 to 1 is an error when read."""
    if not detectors:
        raise ValueError("no detector")
    for detector in detectors.values():
        check_detector(detector, rows)

    def checked(detector: Detector) -> Detector:
        def run(batches):
            for batch in detector(batches):
                _fits(batch)
                yield batch

        return run

    found = [rows.mapInArrow(checked(d), SCORES).select(F.lit(name).alias("detector"), "*") for name, d in detectors.items()]
    p = F.col("probability")
    sure = F.when(p.isNull() | F.isnan(p) | ~p.between(0, 1), F.raise_error(F.concat(F.lit("a probability outside 0 to 1 for "), F.coalesce("sample_id", F.lit("?"))))).otherwise(p)
    return reduce(DataFrame.unionByName, found).withColumn("probability", sure)


# Summaries -----------------------------------------------------------------------------------------------------------

SCORED = ("precision", "recall", "f1", "accuracy")


def localisation(rows: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3, 5), threshold: float = 0.5) -> DataFrame:
    """``by`` and, for each k, the share of positives with known lines whose first k ranked lines hold one (``top_k``), and
    that were also predicted (``end_to_end_top_k``); null where no row of ``by`` has a ranking, or none is eligible. Rows:
    label, probability, truth (array), ranked (array or null)."""
    eligible = (F.col("label") == 1) & (F.size("truth") > 0)
    hit = lambda k: eligible & F.coalesce(F.arrays_overlap("truth", F.slice("ranked", 1, k)), F.lit(False))
    found = F.col("probability") >= threshold
    counts = [F.count_if(c).alias(n) for k in ks for c, n in ((hit(k), f"top_{k}"), (hit(k) & found, f"end_to_end_top_{k}"))]
    out = rows.groupBy(*by).agg(F.count_if(eligible).alias("_n"), F.max(F.col("ranked").isNotNull()).alias("_ranked"), *counts)
    share = lambda c: F.when(F.col("_ranked") & (F.col("_n") > 0), F.col(c) / F.col("_n")).alias(c)
    return out.select(*by, *[share(f"{p}top_{k}") for p in ("", "end_to_end_") for k in ks])


def summarize_runs(predictions: DataFrame, records: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Of runs over one test set: (mode, score, n, mean, std, least, most) over the seeds, and the cases. predictions: mode,
    seed, sample_id, probability, ranked; records: sample_id, label, group_id, truth (array).

    Cases: mode, sample_id, group_id, label, false_positive_runs, false_negative_runs, error_runs, total_runs and the
    probabilities by seed. A sample that a run predicts twice or not at all, or that is no record, is an error when read.
    """
    n_records = records.count()
    said = F.concat_ws(" ", F.lit("run"), "mode", F.col("seed").cast("string"), F.lit("does not predict each record once"))
    counted = predictions.join(records.select("sample_id", F.lit(1).alias("_k")), "sample_id", "left").groupBy("mode", "seed").agg(F.count(F.lit(1)).alias("_n"), F.count("_k").alias("_known"), F.count_distinct("sample_id").alias("_d"))
    sound = F.when((F.col("_n") != n_records) | (F.col("_known") != n_records) | (F.col("_d") != n_records), F.raise_error(said)).otherwise(F.col("mode"))
    checked = predictions.join(counted.withColumn("_sure", sound), ["mode", "seed"]).withColumn("mode", F.col("_sure")).drop("_n", "_known", "_d", "_sure")
    rows = checked.join(records, "sample_id")
    scores = confusion(rows, threshold, ["mode", "seed"]).join(localisation(rows, ["mode", "seed"], threshold=threshold), ["mode", "seed"])
    names = [c for c in scores.columns if c in SCORED or "top_" in c]
    long = scores.select("mode", F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")).select("mode", "x.*")
    wrong = (F.col("probability") >= threshold) != (F.col("label") == 1)
    seeds = F.transform(F.array_sort(F.collect_list(F.struct("seed", "probability"))), lambda x: x["probability"])  # a value a seed
    cases = rows.groupBy("mode", "sample_id").agg(
        F.first("group_id").alias("group_id"), F.first("label").alias("label"), F.count_if(wrong & (F.col("label") != 1)).alias("false_positive_runs"), F.count_if(wrong & (F.col("label") == 1)).alias("false_negative_runs"),
        F.count_if(wrong).alias("error_runs"), F.count(F.lit(1)).alias("total_runs"), seeds.alias("probabilities"),
    )
    return score_summary(long, ["mode", "score"], "value"), cases.orderBy("mode", F.desc("error_runs"), "sample_id")


def summary_rows(models: DataFrame, scores: tuple[str, ...] = (*SCORED, "top_1", "end_to_end_top_1")) -> DataFrame:
    """mode and its row of a Markdown table: mean and sample deviation of each score, ``unsupported`` without a mean."""
    number = lambda c: F.format_string("%.3f", c)
    shown = F.when(F.col("mean").isNull(), "unsupported").otherwise(F.concat(number("mean"), F.lit(" ± "), F.when(F.col("std").isNull(), "?").otherwise(number("std"))))
    wide = models.groupBy("mode").agg(*[F.max(F.when(F.col("score") == c, shown)).alias(c) for c in scores])
    safe = F.replace(F.replace(F.col("mode"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return wide.select("mode", F.concat(F.lit("| "), F.concat_ws(" | ", safe, *scores), F.lit(" |")).alias("line"))


def audit_runs(predictions: DataFrame, reloaded: DataFrame, findings: DataFrame, stored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """What does not agree, as (problem, item): predictions (sample_id, file, probability, ranked) and the same after a reload;
    those at or above the threshold and the findings (file, detector, confidence, line; of ``model``) of a scan, one a
    file; the findings of each detector and the counts (detector, n) that were stored."""
    said = lambda df, p, c: df.select(F.lit(p).alias("problem"), F.col(c).cast("string").alias("item"))
    cols = ["sample_id", "file", "probability", "ranked"]
    want = predictions.where(F.col("probability") >= threshold).select("file", F.col("probability").alias("p"), F.get("ranked", F.lit(0)).alias("l"))
    both = want.join(findings.where("detector = 'model'"), "file", "full")
    off = ~(F.col("p").eqNullSafe(F.col("confidence")) & F.col("l").eqNullSafe(F.col("line")))
    counts = findings.groupBy("detector").agg(F.count(F.lit(1)).alias("found")).join(stored, "detector", "full")
    found = [
        said(same_rows(predictions.select(*cols), reloaded.select(*cols)), "changed by the reload", "sample_id"), said(predictions.groupBy("file").count().where("count > 1"), "several functions of a file", "file"),
        said(both.where(off), "scan and prediction differ", "file"), said(counts.where(~F.col("found").eqNullSafe(F.col("n"))), "stored count differs", "detector"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()
