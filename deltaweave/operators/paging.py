"""Pages, prefixes within a budget, and newest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of a pass over a page, and rows that need no finer ones.
BUCKETS, FEW_ROWS = 32, 100_000


def keyset_page(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    rows = df if cursor is None else df.where(F.col(key) > cursor)
    return rows.orderBy(key).limit(limit)


def byte_budget_page(df: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """Rows in order while their sizes sum up to the budget at most, stopping once it is reached; at least one row.

    A row's bucket by key gives sums of sums. Rows beyond the bucket that reaches the budget go, and the rest is cut into finer
    buckets until they are few or nothing goes any more, so no task orders more than a bucket of what lies before the budget.
    """
    rows = df
    while True:
        cuts = rows.select(F.expr(f"percentile_approx({key}, array({', '.join(str(i / BUCKETS) for i in range(1, BUCKETS))}))").alias("c")).first()[0] or []
        cuts = sorted(set(cuts))
        bucket = F.lit(0)
        for c in cuts:
            bucket = bucket + F.when(F.col(key) > c, 1).otherwise(0)
        sums = rows.groupBy(bucket.alias("bucket")).agg(F.sum(size).alias("s"), F.count("*").alias("n")).orderBy("bucket").collect()  # BUCKETS rows
        total, kept, last = 0, 0, None
        for r in sums:
            total, kept, last = total + (r["s"] or 0), kept + r["n"], r["bucket"]
            if total >= budget:
                break
        n = sum(r["n"] for r in sums)
        if last is None or last >= len(cuts) or kept == n:
            break
        rows = rows.where(F.col(key) <= cuts[last])
        if n <= FEW_ROWS:
            break
    marked = rows.withColumn("bucket", bucket)
    before = marked.groupBy("bucket").agg(F.sum(size).alias("s")).select("bucket", (F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).alias("ahead"))
    w = Window.partitionBy("bucket").orderBy(key)
    placed = marked.join(F.broadcast(before), "bucket").withColumn("upto", F.col("ahead") + F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = (F.col("upto") == F.col(size)) & (F.col("ahead") == 0)
    return placed.where(first | ((F.col("upto") <= budget) & (F.col("upto") - F.col(size) < budget))).select(*df.columns, F.col("upto").alias("running"))


def latest(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(1)


def recent(df: DataFrame, key: str, n: int, most: int = 100) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(min(n, most))


def distinct_first_seen(df: DataFrame, order: list[str], keys: list[str], limit: int, most: int = 50_000) -> DataFrame:
    """Keys in order of their first row among the first 10 * limit rows."""
    scanned = df.orderBy(*order).limit(min(most, 10 * limit))
    ranked = scanned.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.groupBy(*keys).agg(F.min("rank").alias("rank")).orderBy("rank").limit(limit)


def by_label(df: DataFrame, path: str, name: str, key: str) -> DataFrame:
    return df.orderBy(F.coalesce(F.nullif(F.col(path), F.lit("")), F.col(name)), key)
