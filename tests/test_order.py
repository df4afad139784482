"""Places in a total order, and running sums, without a task that sees all rows."""

import random

from pyspark.sql import functions as F

from quarrylens.operators.order import positions, positions_within


def test_positions_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), i, rng.randint(-5, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(7)
    got = positions(df, [F.desc_nulls_last("i")], "at", {"before": F.col("v")}).orderBy("at").collect()
    want, total = sorted(rows, key=lambda r: -r[1]), 0
    assert len(got) == len(rows)
    for k, (r, w) in enumerate(zip(got, want, strict=True)):
        assert (r.g, r.i, r.v, r["at"], r.before) == (*w, k, total)
        total += w[2]
    within = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        within.setdefault(r[0], []).append(r[1])
    for r in positions_within(df, ["g"], [F.col("i")]).collect():
        assert within[r.g][r.position] == r.i


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, i long")
    assert positions(empty, [F.col("i")], "at", {"s": F.col("i")}).collect() == []
    assert positions_within(empty, ["g"], [F.col("i")]).columns == ["g", "i", "position"]
