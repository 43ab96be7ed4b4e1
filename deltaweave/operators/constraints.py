"""Constraints on tables, examined in one scan of each.

Each row of a table becomes one small row for each of its checks: whether it breaks it, and, for a key that has to be unique, the key. Rows without a key
are summed up before anything is shuffled, so only keys travel. Referenced keys are joined before, each table's once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True, eq=False)
class Check:
    table: str
    name: str
    severity: str = "error"


@dataclass(frozen=True, eq=False)
class Holds(Check):
    """broken is true of a row that breaks it; null is no breach."""

    broken: Column | None = None


@dataclass(frozen=True, eq=False)
class Unique(Check):
    """n counts the keys that several rows have; nulls are equal to each other."""

    keys: tuple[str, ...] = ()


@dataclass(frozen=True, eq=False)
class Reference(Check):
    """Rows whose keys the other table lacks; if optional, rows with a null among them are none."""

    keys: tuple[str, ...] = ()
    other: str = ""
    others: tuple[str, ...] = ()
    optional: bool = False


def examine(tables: dict[str, DataFrame], checks: Iterable[Check]) -> DataFrame:
    """(name, status, n): ok where n is 0, else the check's severity."""
    checks = list(checks)
    spark = next(iter(tables.values())).sparkSession
    by_table: dict[str, list[Check]] = {}
    for c in checks:
        by_table.setdefault(c.table, []).append(c)
    parts = [_examined(tables, name, own) for name, own in by_table.items()]
    known = spark.createDataFrame([(c.name, c.severity) for c in checks], "name string, severity string")
    counts = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "name string, n long")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return counts.join(F.broadcast(known), "name", "right").select("name", F.when(n == 0, "ok").otherwise(F.col("severity")).alias("status"), n.alias("n"))  # a row a check


def _examined(tables: dict[str, DataFrame], table: str, checks: list[Check]) -> DataFrame:
    rows, entries = tables[table], []
    none = F.lit(None).cast("string")
    for k, c in enumerate(checks):
        key = none
        if isinstance(c, Unique):
            key, broken = F.to_json(F.struct(*c.keys)), F.lit(False)
        elif isinstance(c, Reference):
            hit, names = f"__hit{k}", [f"__key{k}_{i}" for i in range(len(c.keys))]
            there = tables[c.other].select(*(F.col(o).alias(n) for o, n in zip(c.others, names, strict=True))).distinct().withColumn(hit, F.lit(True))
            rows = rows.join(there, [F.col(a) == F.col(b) for a, b in zip(c.keys, names, strict=True)], "left").drop(*names)
            broken = F.col(hit).isNull()
            if c.optional:
                broken = broken & reduce(lambda a, b: a & b, (F.col(x).isNotNull() for x in c.keys))
        else:
            broken = F.coalesce(c.broken, F.lit(False))
        entries.append(F.struct(F.lit(c.name).alias("name"), key.alias("key"), broken.cast("long").alias("broken")))
    each = rows.select(F.inline(F.array(*entries))).groupBy("name", "key").agg(F.count("*").alias("rows"), F.sum("broken").alias("broken"))
    return each.groupBy("name").agg(F.sum(F.when(F.col("key").isNotNull(), (F.col("rows") > 1).cast("long")).otherwise(F.col("broken"))).alias("n"))
