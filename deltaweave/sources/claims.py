"""Queues that several workers share: jobs in a store's table, and an append-only log of what became of them.

Every change is a part of the log, with the whole rows as they are afterwards and the version it was decided on. It is committed only if the table is still
as it was read, and is decided anew if it isn't; so two workers never get one job, and what one decides rests on what all before it did. A claim's token is
its place in the log: a worker whose lease has run out, and whose job somebody has claimed since, holds a token that isn't the job's any more, and can neither
finish it nor keep it.

The queue's state is the last word of the log on each job, or the job as it was put in. compact() makes a new base of it, and the log is gone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import work
from .store import DELETED, Conflict, Store, under

LOG, BASE = "log", "base"


class StaleToken(RuntimeError):
    """Somebody else has claimed what the token stood for."""


class Queue:
    def __init__(self, store: Store, name: str, lease: str = work.IMAGE_LEASE, most: int = work.MOST_CLAIMED, tries: int = 20):
        self.store, self.name, self.lease, self.most, self.tries = store, name, lease, most, tries

    def _read(self, folders: list[str]) -> DataFrame:
        return self.store.spark.read.parquet(*(f"{self.store.folder}/{f}" for f in folders))

    def _seen(self) -> tuple[int, dict[str, str]]:
        v = self.store.version(self.name)
        return v, self.store.parts(self.name, version=v)

    def state(self, parts: dict[str, str] | None = None) -> DataFrame:
        """Jobs as they are, with the token of the last claim (0: none)."""
        parts = self._seen()[1] if parts is None else parts
        base = self.store.without_deleted([f for p, f in parts.items() if not under(p, LOG) and not under(p, DELETED)], parts)
        base = base if "token" in base.columns else base.withColumn("token", F.lit(0).cast("long"))
        log = [f for p, f in parts.items() if under(p, LOG)]
        return work.folded(base, self._read(log)) if log else base

    def _append(self, decide: Callable[[DataFrame, int], DataFrame]) -> int:
        """decide: (state, version) to rows as they are afterwards. Their place in the log."""
        for _ in range(self.tries):
            v, parts = self._seen()
            rows = decide(self.state(parts), v + 1)
            try:
                self.store.write(self.name, rows.withColumn("seq", F.lit(v + 1).cast("long")), part=f"{LOG}/{v + 1:012d}", expect=parts, watches="")
                return v + 1
            except Conflict:
                if self.store.open_transaction is not None:
                    raise
        raise Conflict(f"{self.name}: others came first {self.tries} times")

    def put(self, jobs: DataFrame) -> None:
        """More jobs, of ids that the queue hasn't had."""
        v, parts = self._seen()
        self.store.write(self.name, jobs.withColumn("token", F.lit(0).cast("long")), part=f"{BASE}/{v + 1:012d}", expect=parts, watches="")

    def claim(self, now: Column, limit: int, worker: str, owners: DataFrame | None = None, keys: Sequence[str] = ()) -> tuple[int, DataFrame]:
        """(token, jobs): the first eligible ones, those with a live owner before all others if owners are given. What is returned is read from the log."""

        def decide(state: DataFrame, seq: int) -> DataFrame:
            jobs = state.drop("token")
            got = work.claim(jobs, now, limit, worker, self.lease, self.most) if owners is None else work.claim_active_first(jobs, owners, now, limit, worker, keys)
            return got.withColumn("token", F.lit(seq).cast("long"))

        seq = self._append(decide)
        return seq, self.store.read(self.name, prefix=f"{LOG}/{seq:012d}").drop("seq")

    def _held(self, token: int, worker: str, now: Column, change: Callable[[DataFrame], DataFrame]) -> int:
        """Change the jobs that a token still holds. How many; StaleToken if it holds none any more."""
        counts = []

        def decide(state: DataFrame, seq: int) -> DataFrame:
            mine = state.where((F.col("token") == token) & work.holds(worker, now))
            counts.append(mine.count())
            if not counts[-1]:
                raise StaleToken(f"{self.name}: {worker} holds nothing by token {token}")
            return change(mine.drop("token")).withColumn("token", F.lit(token).cast("long"))

        self._append(decide)
        return counts[-1]

    def heartbeat(self, token: int, worker: str, now: Column) -> int:
        """The lease of what the token holds runs anew."""
        return self._held(token, worker, now, lambda mine: work.heartbeat(mine, worker, now, self.lease))

    def finish(self, token: int, worker: str, now: Column, ids: DataFrame, note: str | None = None) -> int:
        """Jobs of ids (id_queue) that the token holds are done; how many. The others of its jobs stay held."""
        chosen = ids.select("id_queue").distinct()
        return self._held_among(token, worker, now, chosen, lambda mine: work.finish(mine, chosen, worker, now, note))

    def fail(self, token: int, worker: str, now: Column, failures: DataFrame) -> int:
        """failures: (id_queue, message). Jobs that the token holds wait for another try, or have failed for good; how many."""
        told = failures.groupBy("id_queue").agg(F.min("message").alias("message"))

        def change(mine: DataFrame) -> DataFrame:
            rows = mine.join(told, "id_queue").withColumns({"last_error": F.col("message"), "updated_at": now})
            failed = work.fail(rows, now, work.is_retryable(F.coalesce("message", F.lit(""))))
            return failed.withColumns({"locked_by": F.lit(None).cast("string"), "locked_until": F.lit(None).cast(mine.schema["locked_until"].dataType)}).select(*mine.columns)

        return self._held_among(token, worker, now, told.select("id_queue"), change)

    def _held_among(self, token: int, worker: str, now: Column, ids: DataFrame, change) -> int:
        return self._held(token, worker, now, lambda mine: change(mine.join(ids, "id_queue", "left_semi").select(*mine.columns)))

    def cancel(self, which: Column) -> int:
        """Jobs in work among `which` are freed: they wait again, under a token that nobody has. How many."""
        counts = []

        def decide(state: DataFrame, seq: int) -> DataFrame:
            open_ = state.where(which & (F.col("status") == "processing"))
            counts.append(open_.count())
            return work.released(open_).withColumn("token", F.lit(seq).cast("long"))

        self._append(decide)
        return counts[-1]

    def compact(self) -> None:
        """The state becomes the base; the log goes with the same commit."""
        _, parts = self._seen()
        self.store.write(self.name, self.state(parts), part=f"{BASE}/{self.store.version(self.name) + 1:012d}", replaces="", expect=parts)
