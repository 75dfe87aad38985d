"""Structured Streaming versions of log replay, heartbeat collection and failure detection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_reports(reports: DataFrame, host: str, at: str, window: str, late: str) -> DataFrame:
    """(window, host, n, last) of heartbeats, as counted so far; later than ``late`` they are dropped. In update mode the
    state holds only windows that the watermark hasn't passed."""
    return reports.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), host).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))


def vnode_counters(diffs: DataFrame, by: str) -> DataFrame:
    """Running store size and keys of each vnode from a stream of diffs without resets."""
    return diffs.groupBy(by).agg(F.sum("size").alias("store_size"), F.sum("n_keys").alias("store_keys"))


def contiguous(log: DataFrame, by: str, first: int) -> DataFrame:
    """(by, pos) of a stream's log entries in order, each once all before it have come; the rest wait in the state.

    ``by`` splits the log (one log a vnode); the state holds what waits beyond the first gap, as runs (first, last, ...).
    """

    def drain(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, waiting = state.get if state.exists else (first, [])
        new = np.unique(np.concatenate([rows["pos"].to_numpy(np.int64) for rows in batches]))
        new = new[new >= due]
        cuts = np.flatnonzero(np.diff(new, prepend=new[:1] - 2) != 1)
        runs = sorted([*zip(waiting[::2], waiting[1::2], strict=True), *zip(new[cuts].tolist(), new[np.append(cuts[1:], len(new)) - 1].tolist() if len(new) else [], strict=True)])
        merged: list[list[int]] = []
        for low, high in runs:
            if merged and low <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        out = np.zeros(0, np.int64)
        if merged and merged[0][0] <= due:
            out = np.arange(due, merged.pop(0)[1] + 1)
            due += len(out)
        state.update((due, [x for run in merged for x in run]))
        yield pd.DataFrame({by: [key[0]] * len(out), "pos": out})

    kind = log.schema[by].dataType.simpleString()
    return log.groupBy(by).applyInPandasWithState(drain, f"{by} {kind}, pos long", "due long, waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def round_trips(samples: DataFrame, by: str, rtt: str, least: float) -> DataFrame:
    """(by, mean, deviation, rto) after each batch of a stream of round trips (columns by, seq, rtt): two numbers a host."""
    from rangeweave.operators.detection import DEVIATION_RATE, MEAN_RATE, STD_FACTOR

    def move(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, deviation = state.get if state.exists else (None, 0.0)
        for x in pd.concat(list(batches)).sort_values("seq")[rtt]:
            if mean is None:
                mean = float(x)
            else:
                deviation = (1 - DEVIATION_RATE) * deviation + DEVIATION_RATE * abs(mean - x)
                mean = (1 - MEAN_RATE) * mean + MEAN_RATE * x
        state.update((mean, deviation))
        yield pd.DataFrame({by: [key[0]], "mean": [mean], "deviation": [deviation], "rto": [max(least, mean + STD_FACTOR * deviation)]})

    kind = samples.schema[by].dataType.simpleString()
    return samples.groupBy(by).applyInPandasWithState(move, f"{by} {kind}, mean double, deviation double, rto double", "mean double, deviation double", "update", GroupStateTimeout.NoTimeout)


def silent_hosts(beats: DataFrame, host: str, at: str, timeout_ms: int, late: str) -> DataFrame:
    """(host, event) of a stream of heartbeats: suspected once the watermark passes a host's last beat by the timeout,
    restored at its next beat; one event a change."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, suspected = state.get if state.exists else (0, False)
        events = []
        if state.hasTimedOut:
            if not suspected:
                suspected, events = True, ["suspected"]
        else:
            for rows in batches:
                last = max(last, int(rows[at].max().timestamp() * 1000))
            if suspected:
                suspected, events = False, ["restored"]
        state.update((last, suspected))
        if not suspected and last + timeout_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(last + timeout_ms)
        yield pd.DataFrame({host: [key[0]] * len(events), "event": events})

    kind = beats.schema[host].dataType.simpleString()
    return beats.withWatermark(at, late).groupBy(host).applyInPandasWithState(
        watch, f"{host} {kind}, event string", "last long, suspected boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
