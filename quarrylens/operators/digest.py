"""Digests of ordered rows, whole for any number of them: a tree of hashes over runs of their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.order import positions_within
from quarrylens.sources.shared import materialize

RUN = 512


def ordered_digest(rows: DataFrame, by: list[str], order: list[Column], leaf: Column, run: int = RUN) -> DataFrame:
    """``by``, rows, digest: a hash of the number of rows, a colon and the root of a tree over the rows' leaves (hex digests)
    in ``order``. Every ``run`` consecutive digests are joined and hashed (SHA-256) into one, level by level, until one is
    left; a lone leaf is its own root.

    The digest tells any two different sequences apart and does not depend on partitions. With ``order`` the leaf itself
    it tells multisets apart, in whatever order rows come. No group is gathered: a task gets ``run`` digests at a time,
    so one value of ``by`` (null is a value) may have any share of the rows. No rows give no digests.
    """
    by_ = [F.col(c) for c in by]
    placed = positions_within(rows.select(*by_, leaf.alias("_leaf"), *[o.alias(f"_o{i}") for i, o in enumerate(order)]), by, [*[F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))], F.col("_leaf")], "_pos")
    level = materialize(placed.select(*by, "_leaf", "_pos"), "digest")
    sizes = level.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    longest = level.agg(F.max("_pos")).first()[0]
    done = None
    while longest is not None:
        # values with one digest left are done; only the others rise
        last = level.groupBy(*by).agg(F.max("_pos").alias("_top"), F.min("_leaf").alias("digest"))
        single = last.where("_top = 0").select(*by, "digest")
        done = single if done is None else done.unionByName(single)
        if longest == 0:
            break
        tops = last.where("_top > 0").select(*[F.col(c).alias(f"_by_{c}") for c in by])
        rising = level.join(tops, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], "left_semi") if by else level
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_leaf"))), lambda x: x["_leaf"]), "")
        up = rising.groupBy(*by, F.expr(f"_pos div {run}").alias("_up")).agg(F.sha2(joined, 256).alias("_leaf"))
        level = materialize(up.select(*by, "_leaf", F.col("_up").alias("_pos")), "digest")
        longest //= run
    if done is None:
        return sizes.withColumn("digest", F.lit(None).cast("string"))
    found = done.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("digest").alias("_root"), F.lit(0).alias("_k"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_k") == F.col("_j"))
    return sizes.withColumn("_j", F.lit(0)).join(found, same).select(*by, "rows", F.sha2(F.concat(F.col("rows").cast("string"), F.lit(":"), "_root"), 256).alias("digest"))


def digest_sql(rows: str, run: int = RUN) -> str:
    """The same in SQL (DuckDB) over ``rows``, a query with columns grp, leaf and pos (from 0 within grp): grp, rows, digest."""
    return f"""WITH RECURSIVE b AS ({rows}), t(grp, lvl, pos, h, c) AS (SELECT grp, 0, pos, leaf, count(*) OVER (PARTITION BY grp) FROM b UNION ALL
 SELECT grp, lvl + 1, pos // {run}, sha256(string_agg(h, '' ORDER BY pos)), (c + {run - 1}) // {run} FROM t WHERE c > 1 GROUP BY grp, lvl, c, pos // {run})
SELECT grp, n AS rows, sha256(n || ':' || h) AS digest FROM t JOIN (SELECT grp AS g, count(*) AS n FROM b GROUP BY 1) ON g IS NOT DISTINCT FROM grp WHERE c = 1"""


def fields_hash(*parts: Column) -> Column:
    """SHA-256 of the parts as text, each after its length, null as none."""
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)
