"""A circuit breaker per engine, folded over its calls in order of time, as a batch and as a stream.

A breaker opens after `threshold` limits in a row (or one while half-open) for min(longest, base x 2^(limits - threshold))
seconds, lets one probe through afterwards, and closes on success. The fold is sequential by nature, so an engine's calls
meet in one task; calls of kinds that change nothing are dropped before, and the stream keeps a few numbers per engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = "engine string, ts timestamp_ntz, call_kind string, allowed boolean, state string, blocked_until double"


@dataclass
class Breaker:
    threshold: int = 2
    base: float = 120.0
    longest: float = 300.0
    state: str = "closed"
    until: float = 0.0
    limits: int = 0
    probing: bool = False

    def step(self, kind: str, now: float) -> bool | None:
        """Take one call; for a query, whether it may pass."""
        if kind == "query":
            if self.state == "open":
                if self.until > now:
                    return False
                self.state, self.probing = "half-open", True
                return True
            if self.state == "half-open":
                if self.probing:
                    return False
                self.probing = True
            return True
        if kind == "success":
            self.state, self.until, self.limits, self.probing = "closed", 0.0, 0, False
        elif kind == "limit":
            self.limits += 1
            self.probing = False
            if self.state == "half-open" or self.limits >= self.threshold:
                self.state, self.until = "open", now + min(self.longest, self.base * 2 ** min(60, max(0, self.limits - self.threshold)))
        return None


def run(calls: pd.DataFrame, breaker: Breaker) -> pd.DataFrame:
    calls = calls.sort_values(["ts", "call_kind"], ignore_index=True)
    seconds = (calls["ts"] - pd.Timestamp("1970-01-01")).dt.total_seconds()
    rows = []
    for kind, now in zip(calls["call_kind"], seconds):
        allowed = breaker.step(kind, now)
        rows.append((allowed, breaker.state, breaker.until))
    return calls[["engine", "ts", "call_kind"]].assign(allowed=pd.array([r[0] for r in rows], dtype="boolean"), state=[r[1] for r in rows], blocked_until=[float(r[2]) for r in rows])


def useful(calls: DataFrame) -> DataFrame:
    """Distinct calls of the kinds that matter."""
    return calls.where("engine is not null and ts is not null and call_kind in ('query', 'success', 'limit')").select("engine", F.col("ts").cast("timestamp_ntz").alias("ts"), "call_kind").distinct()


def fold(calls: DataFrame, **settings) -> DataFrame:
    """Every call with what the breaker of its engine made of it. The calls of an engine pass one task in order, batch by batch: what is held is one breaker."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, breaker = None, Breaker(**settings)
        for batch in batches:
            out = []
            for e, kind, us in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if e != engine:
                    engine, breaker = e, Breaker(**settings)
                allowed = breaker.step(kind, us / 1e6)
                out.append((allowed, breaker.state, float(breaker.until)))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["engine", "ts", "call_kind", "allowed", "state", "blocked_until"])

    ordered = useful(calls).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).repartition("engine").sortWithinPartitions("engine", "ts", "call_kind")
    return ordered.mapInArrow(step, OUT)


def snapshot(folded: DataFrame, now: float) -> DataFrame:
    """(engine, state, seconds_left) after the last call of every engine, at a time in seconds since 1970."""
    last = folded.groupBy("engine").agg(F.max_by(F.struct("state", "blocked_until"), F.struct("ts", "call_kind")).alias("x"))
    left = F.when(F.col("x.state") == "open", F.greatest(F.lit(0.0), F.col("x.blocked_until") - now)).otherwise(0.0)
    return last.select("engine", F.col("x.state").alias("state"), left.alias("seconds_left"))


def fold_stream(calls: DataFrame, **settings) -> DataFrame:
    """The same over a stream; the state of an engine is six numbers."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(**settings)
        if state.exists:
            breaker.state, breaker.until, breaker.limits, breaker.probing = state.get
        pdf = pd.concat(list(batches), ignore_index=True)
        out = run(pdf, breaker)
        state.update((breaker.state, breaker.until, breaker.limits, breaker.probing))
        yield out

    return calls.where("engine is not null and ts is not null and call_kind in ('query', 'success', 'limit')").groupBy("engine").applyInPandasWithState(step, OUT, "state string, until double, limits int, probing boolean", "append", GroupStateTimeout.NoTimeout)


# Words of errors that say that an engine is asked too often.
LIMIT_WORDS = ("429", "too many requests", "rate limit", "captcha", "quota", "unusual traffic")


def is_limit(message: Column) -> Column:
    """Whether an error says that an engine is asked too often; false for null."""
    return F.coalesce(F.lower(message).rlike("|".join(LIMIT_WORDS)), F.lit(False))
