"""Exact places in a total order, without one task that sees all rows: range partitions and prefix sums of their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.sources.shared import materialize

_IN_PART = (1 << 33) - 1


def positions(rows: DataFrame, order: list[Column], name: str = "position", sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with their 0-based place in ``order`` as ``name``, and for each of ``sums`` the sum of its column over all
    rows before.

    Rows are dealt by ranges of ``order`` and written; a partition's first place is the sum of the sizes of the
    partitions before it (a row a partition). Rows that are equal in ``order`` meet in one partition, so end it with a
    key that tells them apart; those that it does not tell apart are placed as they come, once for all. Nulls stand
    where ``order`` puts them; an empty table stays empty. ``rows`` must have no column ``name`` or in ``sums``.
    """
    sums = sums or {}
    place, part = F.col("_place"), F.shiftright("_place", 33)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    written = materialize(dealt, "order")
    below = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    sizes = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_base"), *[F.coalesce(F.sum(f"_sum_{k}").over(below), F.lit(0)).alias(f"_base_{k}") for k in sums])
    out = written.withColumn("_part", part).join(F.broadcast(bases), "_part")  # as many rows as partitions
    within = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    return out.withColumns({name: F.col("_base") + place.bitwiseAND(_IN_PART), **{k: F.col(f"_base_{k}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()}}).drop("_part", "_place", "_base", *[f"_base_{k}" for k in sums])


def positions_within(rows: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """As ``positions``, counted from 0 again for each value of ``by`` (nulls are a value). A value may have any share of
    the rows: its first place is a minimum, and the join that hands it out can be split."""
    if not by:
        return positions(rows, order, name)
    placed = positions(rows, [*[F.col(c).asc_nulls_first() for c in by], *order], "_at")
    first = placed.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min("_at").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return placed.join(first, same).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first", *[f"_by_{c}" for c in by])
