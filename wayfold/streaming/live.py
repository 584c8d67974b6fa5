"""Structured Streaming forms: sessions, trails, daily counts and deduplication of visits as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from wayfold.operators import facts
from wayfold.operators.structure import SESSION_GAP_MS, TRAIL_GAP_MS


def stream_sessions(visits: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """visits: ts (timestamp), profile_id, domain. Sessions that close once the watermark passes their gap; domains are counted exactly."""
    window = F.session_window("ts", gap)
    found = visits.withWatermark("ts", late).groupBy("profile_id", window.alias("session")).agg(
        F.count("*").alias("visits"), F.size(F.collect_set("domain")).alias("domains"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return found


def stream_daily(visits: DataFrame, late: str = "1 hour") -> DataFrame:
    """Visits a day, profile and domain."""
    return visits.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "profile_id", "domain").agg(F.count("*").alias("visits"))


def stream_dedup(visits: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first visit of each profile and source id within the watermark."""
    return visits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["profile_id", "source_id"])


TRAIL_ROWS = "profile_id string, visit_id long, session_id string, trail_id string, ordinal long"
_STATE = "last_ms long, session long, trail long, ordinal long"


def stream_trails(visits: DataFrame, gap_ms: int = SESSION_GAP_MS, trail_gap_ms: int = TRAIL_GAP_MS) -> DataFrame:
    """visits: ms, visit_id, profile_id, search. Session and trail of each visit as it comes, from four numbers kept a profile.

    Visits of a micro-batch are put in order; one that is older than the last one seen goes on from
    there as if it came then. What came late is set right by replay(), which rebuilds the days concerned.
    """

    def assign(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, session, trail, ordinal = state.get if state.exists else (-1, -1, -1, -1)
        rows = pd.concat(list(frames)).sort_values(["ms", "visit_id"])
        out = []
        for ms, visit, search in zip(rows["ms"], rows["visit_id"], rows["search"], strict=True):
            if last < 0 or ms - last > gap_ms:
                session, trail = int(visit), -1
            elif trail >= 0 and search is None and ms - last > trail_gap_ms:
                trail = -1
            trail, ordinal = (int(visit), 0) if search is not None else (trail, ordinal + 1)
            out.append((key[0], int(visit), f"session:{key[0]}:{session}", f"trail:{key[0]}:{trail}" if trail >= 0 else None, ordinal if trail >= 0 else None))
            last = max(int(ms), last)
        state.update((last, session, trail, ordinal))
        yield pd.DataFrame(out, columns=["profile_id", "visit_id", "session_id", "trail_id", "ordinal"])

    return visits.groupBy("profile_id").applyInPandasWithState(assign, TRAIL_ROWS, _STATE, "append", GroupStateTimeout.NoTimeout)


EVENT_ROWS = "kind string, profile_id string, visit_id long, ms long, session_id string, trail_id string, ordinal long, first_ms long, last_ms long, visits long, searches long"
_OPEN = "last_ms long, session long, trail long, ordinal long, first_ms long, visits long, searches long"


class Closing(StatefulProcessor):
    """Sessions and trails of a profile in the order of time: visits wait until the watermark has passed them, a session ends by a timer."""

    def __init__(self, gap_ms: int, trail_gap_ms: int) -> None:
        self.gap, self.trail_gap = gap_ms, trail_gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.waiting = handle.getListState("waiting", "ms long, visit_id long, search string")

    def _event(self, kind: str, profile: str, visit: int | None = None, ms: int | None = None, state: tuple | None = None) -> tuple:
        if state is None:
            return (kind, profile, visit, ms, *[None] * 7)
        last, session, trail, ordinal, first, visits, searches = state
        trailing = trail >= 0 and kind == "visit"
        whole = (first, last, visits, searches) if kind == "session" else (None,) * 4
        return (kind, profile, visit, ms, f"session:{profile}:{session}", f"trail:{profile}:{trail}" if trailing else None, ordinal if trailing else None, *whole)

    def _advance(self, profile: str, rows: list[tuple], watermark: int) -> Iterator[tuple]:
        """Visits up to the watermark in order, then the session if nothing can join it any more; the rest waits for a timer."""
        due = sorted((r for r in rows if r[0] < watermark), key=lambda r: r[:2])
        later = sorted((r for r in rows if r[0] >= watermark), key=lambda r: r[:2])
        state = tuple(self.open.get()) if self.open.exists() else None
        for ms, visit, search in due:
            if state is not None and ms - state[0] > self.gap:
                yield self._event("session", profile, state=state)
                state = None
            last, session, trail, ordinal, first, visits, searches = state or (ms, visit, -1, 0, ms, 0, 0)
            if search is not None:
                trail, ordinal = visit, 0
            else:
                trail, ordinal = (-1 if ms - last > self.trail_gap else trail), ordinal + 1
            state = (ms, session, trail, ordinal, first, visits + 1, searches + (search is not None))
            yield self._event("visit", profile, visit, ms, state)
        # a visit at the watermark may still come, so the gap has to have passed before it
        if state is not None and watermark - state[0] > self.gap and not (later and later[0][0] - state[0] <= self.gap):
            yield self._event("session", profile, state=state)
            state = None
        for known in list(self.handle.listTimers()):
            self.handle.deleteTimer(known)
        if state is None:
            self.open.clear()
        else:
            self.open.update(state)
            self.handle.registerTimer(state[0] + self.gap + 1)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] + 1)
        else:
            self.waiting.clear()

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in EVENT_ROWS.split(", ")])
        return frame.astype({c.split()[0]: "Int64" for c in EVENT_ROWS.split(", ") if c.endswith("long")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark, came, out = max(timerValues.getCurrentWatermarkInMs(), 0), [], []
        for frame in rows:
            for ms, visit, search in zip(frame["ms"].tolist(), frame["visit_id"].tolist(), frame["search"].tolist(), strict=True):
                if ms < watermark:
                    out.append(self._event("late", key[0], visit, ms))
                else:
                    came.append((ms, visit, None if pd.isna(search) else search))
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield self._frame([*out, *self._advance(key[0], [*held, *came], watermark)])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield self._frame(list(self._advance(key[0], held, timerValues.getCurrentWatermarkInMs())))

    def close(self) -> None:
        pass


def stream_events(visits: DataFrame, late: str = "1 hour", gap_ms: int = SESSION_GAP_MS, trail_gap_ms: int = TRAIL_GAP_MS) -> DataFrame:
    """visits: ts, ms, visit_id, profile_id, search. Rows of EVENT_ROWS, each final when it comes: ``visit`` with session, trail and ordinal, ``session`` when one has ended, ``late`` for a visit that came after the watermark.

    A profile's state is its open session and the visits that the watermark has not passed; once that is done it
    is empty. Late visits change nothing here: they are what replay() takes to set sessions and trails right.
    The session needs ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider.
    """
    rows = visits.withWatermark("ts", late).select("profile_id", "ms", "visit_id", "search")  # without ts, so that late rows aren't dropped before they are told
    return rows.groupBy("profile_id").transformWithStateInPandas(Closing(gap_ms, trail_gap_ms), EVENT_ROWS, "Append", "EventTime")


def replay(stored: DataFrame, visits: DataFrame, changed: DataFrame, build) -> DataFrame:
    """Rows by profile and session after late or reverted visits: those of sessions that a change touches are built again.

    stored: session rows with profile_id, first_ms, last_ms. changed: profile_id, ms of visits that came
    or went. build makes the rows of some visits. A change reaches from the start of the sessions
    within a gap of it, so everything of the profile from there on is rebuilt, and nothing before.
    """
    hits = changed.select(F.col("profile_id").alias("_profile"), F.col("ms").alias("_ms"))
    near = stored.select(F.col("profile_id").alias("_own"), "first_ms", "last_ms").join(hits, (F.col("_own") == F.col("_profile")) & (F.col("last_ms") >= F.col("_ms") - SESSION_GAP_MS))
    first = near.groupBy(F.col("_own").alias("profile_id")).agg(F.min("first_ms").alias("from_ms"))
    start = changed.groupBy("profile_id").agg(F.min("ms").alias("ms")).join(first, "profile_id", "left").select("profile_id", F.least("ms", "from_ms").alias("from_ms"))
    kept = stored.join(start, "profile_id", "left").where(F.col("from_ms").isNull() | (F.col("last_ms") < F.col("from_ms"))).select(*stored.columns)
    again = visits.join(start, "profile_id").where(F.col("ms") >= F.col("from_ms")).drop("from_ms")
    return kept.unionByName(build(again).select(*stored.columns))


def replace_days(batch: DataFrame, path: str) -> None:
    """A foreachBatch sink: the days that a batch has replace the same days of a table partitioned by date_key."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date_key").parquet(path)


def refresh_rollups(batch: DataFrame, visits: DataFrame, path: str) -> None:
    """A foreachBatch sink: the domain rollup of the days that a batch of visits touches is counted again from all visits of those days."""
    days = batch.select("date_key").distinct()
    replace_days(facts.domain_rollup(visits.join(days, "date_key", "left_semi")), path)
