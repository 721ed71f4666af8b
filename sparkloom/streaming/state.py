"""Streaming operators with state of their own: cumulative counts and ad funnels.  Each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

#: Bits of the funnel.
CREATIVE, SHOW, CLICK = 1, 2, 4
#: Seconds after its creative in which a show or click counts, and seconds by which a step may precede the one before.
TIMEOUT, TOLERANCE = 60, 30


def cumulative_counts(df: DataFrame, key: str, initial: dict[str, int] | None = None, each_row: bool = False) -> DataFrame:
    """Stream: (key, total) for each key of a micro-batch, its rows so far plus its count in ``initial``; with
    ``each_row`` one row for each that came in, with the total up to it."""
    ship(df.sparkSession)
    initial = dict(initial or {})

    def update(group: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else initial.get(group[0], 0)
        total = before + sum(map(len, rows))
        state.update((total,))
        for at in range(before if each_row else total - 1, total, 10_000):
            totals = range(at + 1, min(at + 10_000, total) + 1)
            yield pd.DataFrame({key: [group[0]] * len(totals), "total": list(totals)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key).groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, total long", "total long", "update", GroupStateTimeout.NoTimeout)


def cumulative_counts_batch(df: DataFrame, key: str, initial: dict[str, int] | None = None) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("total"))
    if not initial:
        return counts
    start = F.create_map(*[x for k, v in initial.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return counts.select(key, (F.col("total") + F.coalesce(F.try_element_at(start, F.col(key)), F.lit(0))).alias("total"))


def advance(step: int, accepted: float, events: Iterable[tuple[float, int]], tolerance: float) -> tuple[int, float]:
    """The ordered machine: a step is accepted at the earliest event of its type that comes at most ``tolerance``
    before the acceptance of the step below."""
    events = sorted(events)
    while True:
        hit = next((t for t, kind in events if kind == step + 1 and (step == 0 or t >= accepted - tolerance)), None)
        if hit is None:
            return step, accepted
        step, accepted = step + 1, hit


def funnel_steps(df: DataFrame, keys: Sequence[str], ts: str, kind: str, types: Sequence[str], tolerance: float = TOLERANCE, idle: str | None = "24 hours") -> DataFrame:
    """Stream: (keys, step) for each key of a micro-batch that has reached a step, 1 to len(``types``) in their order.

    Events that came early are kept and tried again, as long as a later event could still let them count.  Rows may
    be ``idle`` late, and the state of a key goes that long after its last event, in event time (None: it stays).
    """
    ship(df.sparkSession)
    rank = _rank(kind, types)
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = (df.withWatermark(ts, idle) if idle else df).filter(F.col(kind).isin(*types)).select(*keys, ts, F.col(ts).cast("double").alias("_t"), rank.alias("_k"))

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        step, accepted, times, kinds = state.get if state.exists else (0, 0.0, [], [])
        events = list(zip(times, kinds, strict=True))
        for b in batches:
            events += list(zip(b["_t"].tolist(), b["_k"].tolist(), strict=True))
        step, accepted = advance(step, accepted, events, tolerance)
        waiting = [(t, k) for t, k in events if k > step and (step == 0 or k > step + 1 or t >= accepted - tolerance)]
        state.update((step, accepted, [t for t, _ in waiting], [int(k) for _, k in waiting]))
        if idle:
            last = max((t for t, _ in events), default=0.0)
            state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs() + 1))
        if step:
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, group, strict=True)}, "step": [step]})

    names = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandasWithState(update, f"{names}, step int", "step int, accepted double, times array<double>, kinds array<int>", "update", GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def _rank(kind: str, types: Sequence[str]) -> Column:
    out = F.lit(None).cast("int")
    for i, t in enumerate(types, 1):
        out = F.when(F.col(kind) == t, i).otherwise(out)
    return out


def funnel_steps_batch(df: DataFrame, keys: Sequence[str], ts: str, kind: str, types: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """The batch twin: per key the times of each type, then one array fold a step."""
    t = F.col(ts).cast("timestamp").cast("double")
    lists = df.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col(kind) == x, t))).alias(f"_t{i}") for i, x in enumerate(types, 1)])
    accepted, step = F.get("_t1", 0), F.when(F.size("_t1") > 0, 1).otherwise(0)
    for i in range(2, len(types) + 1):
        accepted = F.get(F.filter(f"_t{i}", _from(accepted - F.lit(float(tolerance)))), 0)
        step = F.when(accepted.isNotNull(), i).otherwise(step)
    return lists.select(*keys, step.alias("step")).filter("step > 0")


def _from(least: Column):
    return lambda x: x >= least


def funnel_bits(df: DataFrame, keys: Sequence[str], ts: str, kind: str, types: Sequence[str], timeout: int = TIMEOUT, delay: str = "10 seconds") -> DataFrame:
    """Stream: (keys, bits, delta) whenever events set bits that a key hadn't; each of creative, show and click counts
    once, in any order.  State goes ``timeout`` seconds of event time after the creative (or the first event).  A key's
    events of one micro-batch count in the order of their times, whatever the pieces in which they reach the worker."""
    ship(df.sparkSession)
    flag = _flags(kind, types)
    rows = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).filter(F.col(kind).isin(*types)).select(*keys, ts, F.col(ts).cast("double").alias("_t"), flag.alias("_bit"))

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bits, begun = state.get if state.exists else (0, None)
        before = bits
        pieces = [(b["_t"].to_numpy(), b["_bit"].to_numpy()) for b in batches]
        times, flags = (np.concatenate(x) for x in zip(*pieces, strict=True))
        order = np.lexsort((flags, times))
        for t, bit in zip(times[order], flags[order], strict=True):
            begun = float(t) if begun is None or bit == CREATIVE and not bits & CREATIVE else begun
            if t <= begun + timeout:
                bits |= int(bit)
        state.update((bits, begun))
        state.setTimeoutTimestamp(max(int((begun + timeout) * 1000), state.getCurrentWatermarkMs() + 1))
        if bits != before:
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, group, strict=True)}, "bits": [bits], "delta": [bits & ~before]})

    names = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandasWithState(update, f"{names}, bits int, delta int", "bits int, begun double", "update", GroupStateTimeout.EventTimeTimeout)


def _flags(kind: str, types: Sequence[str]) -> Column:
    out = F.lit(0)
    for i, t in enumerate(types):
        out = F.when(F.col(kind) == t, 1 << i).otherwise(out)
    return out


def funnel_bits_batch(df: DataFrame, keys: Sequence[str], ts: str, kind: str, types: Sequence[str], timeout: int | None = None) -> DataFrame:
    """The batch twin: all bits of a key; with ``timeout`` the creative and what comes up to so many seconds after the
    first one, or, before it, after the key's first event."""
    rows = df.filter(F.col(kind).isin(*types)).withColumn("_bit", _flags(kind, types)).withColumn("_t", F.col(ts).cast("timestamp").cast("double"))
    if timeout is not None:
        begun = rows.groupBy(*keys).agg(F.min(F.when(F.col("_bit") == CREATIVE, F.col("_t"))).alias("_c"), F.min("_t").alias("_b"))
        since = F.when(F.col("_t") >= F.col("_c"), F.col("_c")).otherwise(F.col("_b"))
        rows = rows.join(begun, list(keys)).filter(F.when(F.col("_bit") == CREATIVE, F.col("_t") == F.col("_c")).otherwise(F.col("_t") <= since + timeout))
    return rows.groupBy(*keys).agg(F.bit_or("_bit").cast("int").alias("bits"))


def ad_counters(deltas: DataFrame, ad: str = "ad_id", delta: str = "delta") -> DataFrame:
    """(ad, show, click): how many keys of an ad have newly got each bit."""
    has = lambda bit: F.sum((F.col(delta).bitwiseAND(F.lit(bit)) != 0).cast("long"))
    return deltas.groupBy(ad).agg(has(SHOW).alias("show"), has(CLICK).alias("click"))
