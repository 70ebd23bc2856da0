"""Alerts that settle down: a channel's alerts are told together once none has come for a while."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "channel string, told_at timestamp, nth int, key string, severity string, message string, at timestamp"
_STATE = "known array<struct<key:string,severity:string,message:string,at:long>>, waiting array<struct<key:string,severity:string,message:string,at:long,removed:boolean>>, last long"


def _micros(t) -> int:
    return int(pd.Timestamp(t).value // 1000)


def settled(known: dict, last: int | None, events: list[tuple], upto: int, quiet: int) -> tuple[dict, int | None, list[tuple[int, list]]]:
    """Events (at, key, removed, severity, message; in order) on what is known: what is known then, when the last unsettled
    event came (None: none), and what is told: when, and the alerts, newest first. Times are microseconds; upto: no earlier
    event comes any more."""
    told = []

    def tell():
        if last is not None and known:
            told.append((last + quiet, sorted(known.items(), key=lambda x: (-x[1][2], x[0]))))

    for at, key, removed, severity, message in events:
        if last is not None and at > last + quiet:
            tell()
        last = at if last is None else max(last, at)
        if removed:
            known.pop(key, None)
        else:
            known[key] = (severity, message, at)
    if last is not None and upto > last + quiet:
        tell()
        last = None
    return known, last, told


def _settle(quiet: int):
    def run(channel: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old, wait, last = state.get if state.exists else ([], [], None)
        known = {k: (s, m, a) for k, s, m, a in (tuple(x) for x in old or [])}
        waiting = [(x[3], x[0], x[4], x[1], x[2]) for x in (tuple(w) for w in wait or [])]
        for batch in batches:
            for row in batch.itertuples(index=False):
                waiting.append((_micros(row.at), row.key, bool(row.removed), row.severity, row.message))
        now = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda e: (e[0], e[1], e[2], e[3] or "", e[4] or ""))
        due = [e for e in waiting if e[0] <= now]
        waiting = waiting[len(due) :]
        known, last, told = settled(known, last, due, now, quiet)
        if known or waiting or last is not None:
            state.update(([(k, *v) for k, v in known.items()], [(e[1], e[3], e[4], e[0], e[2]) for e in waiting], last))
            ahead = [e[0] for e in waiting[:1]] + ([last + quiet] if last is not None else [])
            if ahead:
                state.setTimeoutTimestamp(max(min(ahead) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        for when, alerts in told:
            yield pd.DataFrame([{"channel": channel[0], "told_at": pd.Timestamp(when, unit="us"), "nth": n, "key": k, "severity": s, "message": m, "at": pd.Timestamp(a, unit="us")} for n, (k, (s, m, a)) in enumerate(alerts, 1)])

    return run


def debounced(alerts: DataFrame, quiet: timedelta = timedelta(milliseconds=350), late: str = "10 seconds") -> DataFrame:
    """channel, told_at, nth, key, severity, message, at: of a stream of alerts (channel, key, severity, message, at,
    removed) what each channel tells when no alert has come for longer than `quiet`: all alerts that it knows, newest first.

    The last alert of a key wins; one with removed = true takes its key away, which counts as an alert but is not told. Events
    are taken in the order of `at` once the watermark (`late` behind the newest) has passed them; what comes behind the
    watermark is dropped. A channel holds an alert for each of its keys, so keys must be few. Rows without at or key are
    left out; a null channel is one like others. A channel that has nothing to tell gives no row.
    """
    rows = alerts.filter("at IS NOT NULL AND key IS NOT NULL").select("channel", "key", "severity", "message", "at", F.coalesce("removed", F.lit(False)).alias("removed"))
    return rows.withWatermark("at", late).groupBy("channel").applyInPandasWithState(_settle(int(quiet.total_seconds() * 1_000_000)), OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
