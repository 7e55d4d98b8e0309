"""Stateful operators on event-time timers: lifetimes of issued tokens and redelivery of wake-ups.

State of a key ends with its timer, so it is bounded by the traffic of one lifetime.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prefloom import constants as c

HOUR = 3_600_000
TTL_MS = c.TOKEN_TTL_HOURS * HOUR
RETENTION_MS = c.USED_RETENTION_DAYS * 24 * HOUR
# open tokens of a bucket as its state holds them
OPEN = pa.schema([("token_hash", pa.string()), ("user_id", pa.int64()), ("issued", pa.int64()), ("used", pa.int64()), ("loose", pa.list_(pa.int64()))])


class _Timed(StatefulProcessor):
    """One value and at most one timer per key; a timer fires once the watermark has passed ``due``."""

    SCHEMA: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.SCHEMA)

    def _keep(self, before: int | None, due: int | None, *values) -> None:
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        self.value.update((*values, due))

    def close(self) -> None:
        pass


class IssuanceLifetimes(StatefulProcessor):
    """Issuances of one bucket of tokens; each ends unused after its lifetime, or a week after its first use within it.

    A use outside the lifetime is none. Uses may arrive before their issuance; without one they are forgotten
    when it could no longer be valid. The open tokens of a bucket are one Arrow table, and its timer is that of the
    token that ends first, so state is read and written once a bucket and micro-batch and not once a token.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "rows binary, timer long")

    def _load(self) -> tuple[dict[str, list], int | None]:
        """Token to [user, issued, first use, uses that await their issuance], and the timer."""
        if not self.state.exists():
            return {}, None
        rows, timer = self.state.get()
        columns = pa.ipc.open_stream(rows).read_all().to_pydict()
        return {t: list(entry) for t, *entry in zip(*(columns[n] for n in OPEN.names))}, timer

    def _save(self, open_: dict[str, list], before: int | None) -> None:
        timer = min((self._due(e) for e in open_.values()), default=None)
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if timer is not None:
                self.handle.registerTimer(timer)
        if not open_:
            self.state.clear()
            return
        columns = [list(open_), *map(list, zip(*open_.values()))]
        table = pa.table([pa.array(v, f.type) for v, f in zip(columns, OPEN)], schema=OPEN)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, OPEN) as writer:
            writer.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(), timer))

    @staticmethod
    def _due(entry: list) -> int:
        _, issued, used, loose = entry
        if issued is None:
            return max(loose) + TTL_MS + 1
        return (issued + TTL_MS if used is None else used + RETENTION_MS) + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_, before = self._load()
        touched = set()
        for frame in rows:
            for token, kind, at, who in zip(frame["token_hash"].tolist(), frame["kind"].tolist(), frame["ms"].tolist(), frame["user_id"].tolist()):
                entry = open_.setdefault(token, [None, None, None, []])
                touched.add(token)
                if kind == "used":
                    entry[3].append(int(at))
                elif entry[1] is None or at < entry[1]:
                    entry[:2] = int(who), int(at)
        for token in touched:
            entry = open_[token]
            _, issued, used, loose = entry
            if issued is not None:
                entry[2] = min([t for t in loose if issued <= t < issued + TTL_MS] + [used] * (used is not None), default=None)
                entry[3] = []
            else:
                entry[3] = sorted(set(loose))
        self._save(open_, before)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_, _ = self._load()
        clock = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = {t: e for t, e in open_.items() if self._due(e) <= clock}
        # the timer that fired is gone already
        self._save({t: e for t, e in open_.items() if t not in over}, None)
        ended = [(t, user, "unanswered" if used is None else "retention-over") for t, (user, issued, used, _) in over.items() if issued is not None]
        if ended:
            yield pd.DataFrame(ended, columns=["token_hash", "user_id", "reason"])

    def close(self) -> None:
        pass


def ended_issuances(issuances: DataFrame, responses: DataFrame, lateness: str = "1 hour", buckets: int = 1 << 12) -> DataFrame:
    """Issuances to delete, each once, when the clock of the streams has passed their end. Needs RocksDB.

    State is kept for ``buckets`` hash buckets of tokens; a task holds the open tokens of one bucket at a time.
    """
    issued = issuances.select("token_hash", "user_id", F.lit("issued").alias("kind"), F.col("issued_at").alias("at"))
    used = responses.select("token_hash", "user_id", F.lit("used").alias("kind"), F.col("responded_at").alias("at"))
    rows = issued.unionByName(used).withColumn("ms", F.unix_millis("at")).withWatermark("at", lateness)
    bucket = F.pmod(F.xxhash64("token_hash"), F.lit(buckets)).alias("bucket")
    return rows.select(bucket, *rows.columns).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=IssuanceLifetimes(), outputStructType="token_hash string, user_id bigint, reason string", outputMode="Append", timeMode="EventTime"
    )


def retry_seconds(deliveries: Column) -> Column:
    """Wait after the given number of deliveries, null when no further one is due."""
    wait = F.least(F.lit(c.WAKEUP_MAX_WAIT), F.pow(F.lit(2.0), deliveries) * c.WAKEUP_WAIT).cast("bigint")
    return F.when(deliveries < c.WAKEUP_DELIVERIES, wait)


class Redelivery(_Timed):
    """A wake-up is delivered once, and again after a growing wait for every failure, until done or given up.

    Its digest is remembered for a week after the wake-up, so a repeat does nothing.
    """

    SCHEMA = "user_id long, first long, deliveries long, open boolean, failed long, due long"

    @staticmethod
    def _wait(deliveries: int) -> int:
        return min(c.WAKEUP_MAX_WAIT, 2**deliveries * c.WAKEUP_WAIT) * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        user, first, deliveries, is_open, failed, before = self.value.get() if self.value.exists() else (None, None, 0, True, None, None)
        order = {"sent": 0, "failed": 1, "done": 2}
        events = sorted((int(at), order[kind], int(who)) for frame in rows for kind, at, who in zip(frame["kind"].tolist(), frame["ms"].tolist(), frame["user_id"].tolist()))
        out = []
        for at, kind, who in events:
            if failed is not None and failed + self._wait(deliveries) <= at:
                # the wait ended before this row, though the clock of the stream has not passed it yet
                out.append((failed + self._wait(deliveries), deliveries + 1, "deliver"))
                deliveries, failed = deliveries + 1, None
            if first is None:
                if kind == order["sent"]:
                    user, first, deliveries = who, at, 1
                    out.append((at, 1, "deliver"))
            elif kind == order["done"]:
                is_open, failed = False, None
            elif kind == order["failed"] and is_open and failed is None:
                if deliveries >= c.WAKEUP_DELIVERIES:
                    is_open = False
                    out.append((at, deliveries, "give-up"))
                else:
                    failed = at
        if first is None:
            return
        due = failed + self._wait(deliveries) if failed is not None else first + RETENTION_MS + 1
        self._keep(before, due, user, first, deliveries, is_open, failed)
        if out:
            yield self._rows(key, user, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.value.exists():
            return
        user, first, deliveries, is_open, failed, due = self.value.get()
        if failed is None:
            self.value.clear()
            return
        # the timer that fired is gone already
        self._keep(None, first + RETENTION_MS + 1 if first + RETENTION_MS >= due else due + RETENTION_MS, user, first, deliveries + 1, is_open, None)
        yield self._rows(key, user, [(due, deliveries + 1, "deliver")])

    @staticmethod
    def _rows(key, user, out) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["ms", "delivery", "action"]).assign(event_hash=key[0], user_id=user)[["event_hash", "user_id", "ms", "delivery", "action"]]


def redeliveries(wakeups: DataFrame, outcomes: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Deliveries of wake-ups: event_hash, user_id, ms (epoch milliseconds), delivery, action. Needs RocksDB.

    ``wakeups`` has event_hash, user_id and ts; ``outcomes`` has those and kind, failed or done, of a delivery.
    A failure counts once per delivery.
    """
    sent = wakeups.select("event_hash", "user_id", F.lit("sent").alias("kind"), "ts")
    rows = sent.unionByName(outcomes.select("event_hash", "user_id", "kind", "ts"))
    rows = rows.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", lateness)
    return rows.groupBy("event_hash").transformWithStateInPandas(
        statefulProcessor=Redelivery(), outputStructType="event_hash string, user_id bigint, ms bigint, delivery bigint, action string",
        outputMode="Append", timeMode="EventTime"
    )
