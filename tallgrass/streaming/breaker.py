"""Circuit breaker of sources: a state machine over their events, in batch and as a stream.

Events: source, ts (seconds), event ('success', 'failure' or 'ask') and kind of
failure. Per event the state after it comes out: state, reason, failures, until,
admitted (of an 'ask', else null). Events of a source count in the order (ts,
seq); null sources are left out, null times come first as 0. A source without
events has no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Cooling times in seconds, failures in a row that cool, and kinds of failure.
TRANSIENT, RATE_LIMIT, RISK_CONTROL = 1800.0, 3600.0, 21600.0
IN_A_ROW = 3
TRANSIENT_KINDS = {"timeout", "network", "server_error", "unknown"}
HARMLESS = {"auth", "permission", "not_found", "validation", "redirect", "scan_limit"}


class Health(NamedTuple):
    state: str = "healthy"
    reason: str = ""
    failures: int = 0
    until: float = 0.0


def _cooled(h: Health, reason: str, seconds: float, failures: int, now: float) -> Health:
    """Cooling never ends sooner than before, and only risk control changes its reason."""
    if h.state == "cooling_down":
        return Health(h.state, reason if reason == "risk_control" else h.reason, failures, max(h.until, now + seconds))
    return Health("cooling_down", reason, failures, now + seconds)


def step(h: Health, event: str, kind: str, now: float) -> tuple[Health, bool | None]:
    """The health after an event, and whether an 'ask' is admitted."""
    cooling = h.state == "cooling_down"
    if event == "ask":
        if h.state == "healthy":
            return h, True
        if cooling and now >= h.until:  # the first to ask after the end is the probe
            return h._replace(state="probe"), True
        return h, False
    if event == "success":
        return (h if cooling else Health()), None
    if event != "failure" or kind == "source_cooling_down":
        return h, None
    if kind in HARMLESS:  # the source has answered
        return (h if cooling else Health() if h.state == "probe" else h._replace(reason=kind)), None
    if kind in ("risk_control", "rate_limit"):
        return _cooled(h, kind, RISK_CONTROL if kind == "risk_control" else RATE_LIMIT, h.failures + 1, now), None
    if cooling:
        return h, None
    reason = kind if kind in TRANSIENT_KINDS else "unknown"
    if h.failures + 1 >= IN_A_ROW:
        return _cooled(h, reason, TRANSIENT, h.failures + 1, now), None
    return h._replace(reason=reason, failures=h.failures + 1), None


_OUT = "source string, seq long, ts double, state string, reason string, failures int, until double, admitted boolean"
_COLUMNS = [x.split()[0] for x in _OUT.split(", ")]


def _walk(h: Health, rows: Iterable) -> tuple[Health, list]:
    out = []
    for r in rows:
        h, admitted = step(h, r.event or "", r.kind or "", float(r.ts))
        out.append((r.source, r.seq, float(r.ts), *h, admitted))
    return h, out


def _frame(out: list) -> pd.DataFrame:
    return pd.DataFrame(out, columns=_COLUMNS).astype({"admitted": "object"})


def replayed(events: DataFrame) -> DataFrame:
    """The state after each event of a table (source, seq, ts, event, kind). A source's events stream through one task in order, and are never held together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, health = None, Health()
        for batch in batches:
            out: list = []
            for name, rows in batch.groupby("source", sort=False):
                if name != source:
                    source, health = name, Health()
                health, more = _walk(health, rows.itertuples(index=False))
                out += more
            yield _frame(out)

    rows = events.where("source IS NOT NULL").select("source", "seq", F.coalesce("ts", F.lit(0.0)).cast("double").alias("ts"), "event", "kind")
    return rows.repartition("source").sortWithinPartitions("source", "ts", "seq").mapInPandas(run, _OUT)


def streamed(events: DataFrame) -> DataFrame:
    """The same over a stream: a source's health is its state, the events of a micro-batch are put in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        health = Health(*state.get) if state.exists else Health()
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        health, out = _walk(health, rows.itertuples(index=False))
        state.update(tuple(health))
        yield _frame(out)

    rows = events.where("source IS NOT NULL").select("source", "seq", F.coalesce("ts", F.lit(0.0)).cast("double").alias("ts"), "event", "kind")
    return rows.groupBy("source").applyInPandasWithState(run, _OUT, "state string, reason string, failures int, until double", "append", GroupStateTimeout.NoTimeout)


def final(states: DataFrame) -> DataFrame:
    """The last state of each source."""
    return states.groupBy("source").agg(F.max_by(F.struct("state", "reason", "failures", "until"), F.struct("ts", "seq")).alias("h")).select("source", "h.*")
