"""Snapshots that come in pieces: each micro-batch of normalised records is merged into the state.

Nothing is removed by a piece, since what it lacks may be in the next; removal is a run's business. The state lies in buckets by key, each a table of its own,
and a batch rewrites only the buckets that its keys fall in: all of them in one job, from one written copy of the batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import delta
from ..sources.store import Store


def latest_records(batch: DataFrame, version: str) -> DataFrame:
    """The record of highest version of each key; of equal versions the largest by its other columns, so a batch that comes again gives the same."""
    rest = [c for c in batch.columns if c not in ("source_key", version)]
    best = batch.groupBy("source_key").agg(F.max(F.struct(version, *rest)).alias("b"))
    return best.select("source_key", *(F.col(f"b.{c}").alias(c) for c in batch.columns if c != "source_key")).select(*batch.columns)


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(store: Store, state: DataFrame, buckets: int, table: str = "mapping") -> None:
    """The state dealt to its buckets, as merge_stream expects it, in one pass."""
    names = {b: f"{table}_{b}" for b in range(buckets)}
    store.write_split(names, state, bucket_of("source_key", buckets))


def read_buckets(store: Store, buckets: int, table: str = "mapping") -> DataFrame:
    out = store.read(f"{table}_0")
    for b in range(1, buckets):
        out = out.unionByName(store.read(f"{table}_{b}"))
    return out


def merge_stream(stream: DataFrame, store: Store, checkpoint: str, run: int, on_actions: Callable[[DataFrame, int], None] | None = None, on_conflicts: Callable[[DataFrame, int], None] | None = None, table: str = "mapping", buckets: int = 0, version: str | None = None):
    """Start a query that merges (source_key, id_product, hashes) rows; a batch that comes again changes nothing.

    version: the column that says which record of a key is the latest, where a batch may have several; it isn't kept. Rows whose key has another product
    aren't merged; on_conflicts gets them. buckets: 0 for one table, else the number that write_buckets() has dealt the state to.
    """

    def merged(rows: DataFrame, state: DataFrame, number: int) -> DataFrame:
        bad = delta.merge_conflicts(state, rows)
        if on_conflicts is not None:
            on_conflicts(bad, number)
        good = rows.join(bad.select("source_key").distinct(), "source_key", "left_anti")
        if on_actions is not None:
            domains = [c[: -len("_hash")] for c in state.columns if c.endswith("_hash")]
            on_actions(delta.changed_rows(good, state, domains=domains), number)
        return delta.merge_mapping(state, good, run)

    def apply(batch: DataFrame, number: int) -> None:
        rows = latest_records(batch, version).drop(version) if version else latest_records(batch, "id_product")
        store.append_partition(f"{table}_batches", rows, "batch", number)  # once; a batch that comes again replaces it
        rows = store.partition(f"{table}_batches", "batch", number)
        if not buckets:
            store.write(table, merged(rows, store.read(table), number))
            return
        touched = sorted(r[0] for r in rows.select(bucket_of("source_key", buckets)).distinct().collect())  # at most `buckets` rows
        if touched:
            state = reduce(DataFrame.unionByName, (store.read(f"{table}_{b}") for b in touched))
            store.write_split({b: f"{table}_{b}" for b in touched}, merged(rows, state, number), bucket_of("source_key", buckets))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
