"""Plans that resume, and detectors that plug in."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import evaluation, experiments

PLAN = {
    "schema_version": "1.0", "modes": ["gnn", "fusion"], "seeds": [1, 2, 3], "epochs": 5, "hidden": 8, "max_length": 64, "split_seed": 42, "learning_rate": 0.01, "threshold": 0.5,
    "dataset_sha256": "a" * 64, "splits_sha256": "b" * 64, "encoder_sha256": "c" * 64,
}


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"modes": []}, "modes"), ({"modes": ["gnn", "gnn"]}, "modes"), ({"seeds": [1]}, "seeds"), ({"seeds": [1, True]}, "seeds"), ({"seeds": [1, 2**32]}, "seeds"), ({"epochs": 0}, "epochs"), ({"hidden": 3}, "hidden"),
        ({"max_length": 513}, "max_length"), ({"learning_rate": 0}, "learning_rate"), ({"threshold": float("nan")}, "threshold"), ({"dataset_sha256": "A" * 64}, "dataset_sha256"), ({"encoder_sha256": None}, "encoder_sha256"), ({"schema_version": 1}, "unknown schema version"), ({"split_seed": 1.0}, "split_seed"),
    ],
)
def test_unsound_plans(spark, change, problem):
    assert experiments.plan_problems({**PLAN, **change}) == [problem]
    with pytest.raises(ValueError, match="not sound"):
        experiments.planned_runs(spark, {**PLAN, **change})


def test_a_plan_resumes_and_a_changed_one_does_not(spark):
    assert experiments.plan_problems(PLAN) == [] and experiments.plan_problems({**PLAN, "modes": ["gnn"], "encoder_sha256": None}) == []
    planned = experiments.planned_runs(spark, PLAN)
    assert planned.count() == 6 and planned.where("mode = 'gnn' and encoder_sha256 is null").count() == 3
    assert experiments.missing_runs(planned, planned.limit(0)).count() == 6
    part = planned.where("seed < 3").withColumn("f1", F.lit(0.5))
    assert sorted((r.mode, r.seed) for r in experiments.missing_runs(planned, part).collect()) == [("fusion", 3), ("gnn", 3)]
    assert experiments.missing_runs(planned, planned).count() == 0
    for stored in (part.unionByName(part), experiments.planned_runs(spark, {**PLAN, "epochs": 6}), experiments.planned_runs(spark, {**PLAN, "seeds": [1, 4]})):
        with pytest.raises(ValueError, match="not as planned"):
            experiments.missing_runs(planned, stored)


def _detectors():
    """Closures, so that tasks need not import this file."""

    def scores(batch, values):
        return pa.record_batch([batch["sample_id"], values, pa.nulls(batch.num_rows, pa.list_(pa.int32()))], names=["sample_id", "probability", "ranked"])

    def by_length(batches):
        for b in batches:
            yield scores(b, pc.min_element_wise(pc.divide(pc.cast(pc.utf8_length(b["source"]), pa.float64()), 10.0), 1.0))

    def always(batches, value=0.25, kind=None):
        for b in batches:
            yield scores(b, pa.array([value] * b.num_rows, kind or pa.float64()))

    return by_length, always


def test_two_detectors_side_by_side(spark):
    rows = spark.createDataFrame([(f"s{i}", "x" * i, 10 * i) for i in range(12)], "sample_id string, source string, start_line int")
    by_length, always = _detectors()
    got = experiments.detect(rows, {"length": by_length, "flat": always})
    assert got.count() == 24 and got.where("detector = 'flat' and probability = 0.25").count() == 12
    found = evaluation.scored_findings(got.join(rows.select("sample_id", "start_line"), "sample_id"))
    assert {(r.detector, r.sample_id, r.line) for r in found.collect()} == {("length", f"s{i}", 10 * i) for i in range(5, 12)}
    assert experiments.detect(rows.limit(0), {"flat": always}).count() == 0


def test_detectors_that_do_not_fit(spark):
    rows = spark.createDataFrame([("s", "x" * 30, 1)], "sample_id string, source string, start_line int")
    always = _detectors()[1]
    ints = lambda bs: always(bs, 1, pa.int64())
    names = lambda bs: (b for b in bs)
    for wrong in (ints, names):
        with pytest.raises(TypeError, match="a detector gave"):
            experiments.detect(rows, {"d": wrong})
    high = lambda bs: always(bs, 1.5)
    with pytest.raises(Exception, match="outside 0 to 1"):
        experiments.detect(rows, {"d": high}).collect()
    with pytest.raises(ValueError):
        experiments.detect(rows, {})


def _runs(spark):
    records = spark.createDataFrame([("a", 1, "g1", [3]), ("b", 1, "g1", []), ("c", 0, "g2", []), ("d", 0, "g3", [])], "sample_id string, label int, group_id string, truth array<int>")
    probabilities = {("gnn", 1): [0.9, 0.2, 0.1, 0.7], ("gnn", 2): [0.8, 0.9, 0.2, 0.6], ("sequence", 1): [0.6, 0.6, 0.6, 0.6]}
    rows = [(m, s, i, p, None if m == "sequence" else [s, 3]) for (m, s), ps in probabilities.items() for i, p in zip("abcd", ps, strict=True)]
    return spark.createDataFrame(rows, "mode string, seed int, sample_id string, probability double, ranked array<int>"), records


def test_runs_are_summarised_over_seeds(spark):
    predictions, records = _runs(spark)
    models, cases = experiments.summarize_runs(predictions, records)
    got = {(r["mode"], r.score): (r.n, r.mean, r.std) for r in models.collect()}
    assert got["gnn", "accuracy"] == (2, 0.625, pytest.approx(0.1767766952966369)) and got["gnn", "recall"][1] == 0.75
    assert got["gnn", "top_1"][:2] == (2, 0) and got["gnn", "top_3"][:2] == (2, 1) and got["sequence", "top_1"] == (0, None, None)
    case = {(r["mode"], r.sample_id): r for r in cases.collect()}
    d, b = case["gnn", "d"], case["gnn", "b"]
    assert (d.false_positive_runs, d.false_negative_runs, d.error_runs, d.total_runs, d.probabilities) == (2, 0, 2, 2, [0.7, 0.6])
    assert (b.false_negative_runs, b.group_id) == (1, "g1")
    assert [(r["mode"], r.sample_id) for r in cases.collect()] == [("gnn", "d"), ("gnn", "b"), ("gnn", "a"), ("gnn", "c"), ("sequence", "c"), ("sequence", "d"), ("sequence", "a"), ("sequence", "b")]
    lines = {r["mode"]: r.line for r in experiments.summary_rows(models).collect()}
    assert lines["sequence"] == "| sequence | 0.500 ± ? | 1.000 ± ? | 0.667 ± ? | 0.500 ± ? | unsupported | unsupported |" and lines["gnn"].startswith("| gnn | 0.")
    for wrong in (predictions.where("sample_id != 'a' or seed = 2"), predictions.unionByName(predictions.limit(1)), predictions.withColumn("sample_id", F.concat("sample_id", F.lit("x")))):
        with pytest.raises(Exception, match="each record once"):
            experiments.summarize_runs(wrong, records)[0].collect()


def test_an_audit_finds_what_differs(spark):
    schema = "sample_id string, file string, probability double, ranked array<int>"
    predictions = spark.createDataFrame([("a", "a.c", 0.9, [4]), ("b", "b.c", 0.2, [1]), ("c", "c.c", 0.7, [2, 1])], schema)
    findings = spark.createDataFrame([("a.c", "model", 0.9, 4), ("c.c", "model", 0.7, 2), ("b.c", "rule", 1.0, 1)], "file string, detector string, confidence double, line int")
    stored = spark.createDataFrame([("model", 2), ("rule", 1)], "detector string, n long")
    assert experiments.audit_runs(predictions, predictions, findings, stored).collect() == []
    other = predictions.withColumn("probability", F.when(F.col("sample_id") == "b", 0.21).otherwise(F.col("probability")))
    got = experiments.audit_runs(predictions, other, findings.where("file != 'c.c'"), stored.where("n = 2"))
    assert {tuple(r) for r in got.collect()} == {("changed by the reload", "b"), ("scan and prediction differ", "c.c"), ("stored count differs", "model"), ("stored count differs", "rule")}
