"""Which project files to export again and when, from a stream of events: one timer and one run at a time for each file.

Events are (file, ts, kind): `changed` (the file, or one made from it, changed), `done` (a run ended) and `busy` (a run found the file open).
Times are event times, so a batch that is run again after a loss gives the same requests. A file's state is five values, whatever its events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the state store that state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EVENTS = "file string, ts timestamp, kind string"
REQUESTS = "file string, due_ms long, action string, changes long"


class Refresh(StatefulProcessor):
    """Requests of one file. action: run (export it now), joined (a run is on its way; the changes are taken up when it ends) or failed (busy
    `tries` times). changes: how many changes the request covers.

    A burst of changes has one timer, `gap` after its latest; later changes move it. While a run is on its way no second one starts: when it
    ends, the waiting changes start one at once. A busy run is tried again after `retry`. Events of a batch may come in any order; of several
    ends of runs in one batch the latest counts, as there is one run at a time. Changes of one batch are one burst, as a run covers all."""

    def __init__(self, gap_ms: int, retry_ms: int, tries: int):
        self.gap, self.retry, self.tries = gap_ms, retry_ms, tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # due: of the open timer, -1 if none; changes: not yet asked for; covered: of the run on its way, -1 if none
        self.state = handle.getValueState("refresh", "due long, changes long, covered long, waiting boolean, failed int")

    def _get(self) -> list:
        return list(self.state.get()) if self.state.exists() else [-1, 0, -1, False, 0]

    def _timer(self, s: list, due: int) -> None:
        if s[0] >= 0:
            self.handle.deleteTimer(s[0])
        self.handle.registerTimer(due)
        s[0] = due

    def _expire(self, s: list, file: str, out: list) -> None:
        due, s[0] = s[0], -1
        if s[2] >= 0:
            s[3] = True
            out.append(Row(file=file, due_ms=due, action="joined", changes=s[1]))
        else:
            s[2], s[1] = s[1], 0
            out.append(Row(file=file, due_ms=due, action="run", changes=s[2]))

    def _end(self, s: list, file: str, at: int, kind: str, out: list) -> None:
        if s[2] < 0:  # an end without a run says nothing
            return
        if kind == "done":
            s[2], s[4] = -1, 0
            if s[3]:
                s[2], s[1], s[3] = s[1], 0, False
                out.append(Row(file=file, due_ms=at, action="run", changes=s[2]))
                if s[0] >= 0:  # the run takes up what the open timer was for
                    self.handle.deleteTimer(s[0])
                    s[0] = -1
            return
        s[1], s[2], s[3], s[4] = s[1] + s[2], -1, False, s[4] + 1
        if s[4] < self.tries:
            self._timer(s, max(at + self.retry, s[0]))
        else:
            out.append(Row(file=file, due_ms=at, action="failed", changes=s[1]))
            s[1], s[4] = 0 if s[0] < 0 else s[1], 0

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s, (file,), out = self._get(), key, []
        latest, new, end = -1, 0, None
        for r in rows:
            if r.kind == "changed":
                new, latest = new + 1, max(latest, r.ms)
            elif end is None or (r.ms, r.kind) > end:
                end = (r.ms, r.kind)
        # rows come before timers: one that is due already fires before what came later moves it
        due = 0 <= s[0] <= timerValues.getCurrentWatermarkInMs()
        steps = ([(s[0], "timer")] if due else []) + ([end] if end else [])
        for at, what in sorted(steps):
            if what != "timer":
                self._end(s, file, at, what, out)
            elif s[0] == at:
                self.handle.deleteTimer(at)
                self._expire(s, file, out)
        if new:
            s[1] += new
            self._timer(s, max(latest + self.gap, s[0]))
        self.state.update(tuple(s))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, (file,), out = self._get(), key, []
        if expiredTimerInfo.getExpiryTimeInMs() == s[0]:
            self._expire(s, file, out)
            self.state.update(tuple(s))
        return iter(out)


def requests(events: DataFrame, gap_ms: int = 400, retry_ms: int = 2000, tries: int = 5, late: str = "1 second") -> DataFrame:
    """REQUESTS from a stream of EVENTS, which may be up to `late` out of order. Events without a file, a time or a known kind are passed over.

    The session's state store must be STORE."""
    sound = events.where("file IS NOT NULL AND ts IS NOT NULL AND kind IN ('changed', 'done', 'busy')")
    keyed = sound.withWatermark("ts", late).select("file", "ts", "kind", F.unix_millis("ts").alias("ms"))
    return keyed.groupBy("file").transformWithState(Refresh(gap_ms, retry_ms, tries), REQUESTS, "update", "EventTime")


def stale_events(health: DataFrame, at) -> DataFrame:
    """EVENTS of a poll: each project of health(project, state) whose export isn't ok counts as changed at `at` (a timestamp column)."""
    return health.where("state <> 'ok'").select(F.col("project").alias("file"), at.cast("timestamp").alias("ts"), F.lit("changed").alias("kind"))


def project_of(files: DataFrame, exports: DataFrame) -> DataFrame:
    """EVENTS of routine files(path, ts) that changed inside export folders(folder, project): they count as changes of that project. A path meets
    the folders above it by equality, whatever their depth; of nested folders the innermost counts, of files in none there are no events."""
    parts = F.split("path", "/")
    up = files.withColumn("d", F.explode(F.sequence(F.lit(1), F.size(parts) - 1))).where("size(split(path, '/')) > 1").withColumn("folder", F.array_join(F.slice(parts, 1, F.col("d")), "/"))
    met = up.join(exports.select("folder", "project"), "folder").groupBy("path", "ts").agg(F.max_by("project", "d").alias("file"))
    return met.where(F.col("path").rlike(r"\.(rll|st)$")).select("file", "ts", F.lit("changed").alias("kind"))
