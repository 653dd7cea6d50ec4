"""Decision histories as keyed state of a stream of commands.

run_histories keeps the state as a table, which each batch folds its commands into in one sorted pass. It is for batches
that reach many entities. histories keeps it in a state store, with calls for each entity that a batch reaches: for
small batches, and for state that expires. Of the latter:

An entity's events are a list state, its status and what it started from a value state; a batch's commands run in the
order of seq. So batches of commands, over restarts as well, give what one replay of all of them gives, as long as an
entity's commands come in that order from batch to batch. With keep_days commands have a time `at`: an entity whose last
command the watermark has left behind by that many days is handed out once more as expired and its state is dropped
by a timer (the table of histories keeps it), and commands that come later than the watermark allows are left out.

The state is in RocksDB, as Spark's transformWithState asks for: spark.sql.streaming.stateStore.providerClass must name its
provider when the stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.commits import file_system
from millrace.operators.history import STATUSES, advance, replay

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "id string, status string, history array<struct<status:string,day:string>>, refused array<string>, expired boolean"
_DAY_MS = 86_400_000


class _Histories(StatefulProcessor):
    def __init__(self, statuses: tuple, keep_days: int | None):
        self.statuses, self.keep_days = statuses, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "status string, day string")
        self.now = handle.getValueState("now", "status string, first_seen string")

    def _events(self) -> list[tuple]:
        return [(e[0], e[1]) for e in self.events.get()] if self.events.exists() else []

    def _out(self, key: tuple, status: str, history: list[tuple], refused: list[str], expired: bool) -> Row:
        return Row(id=key[0], status=status, history=[Row(status=s, day=d) for s, d in history], refused=refused, expired=expired)

    def _keep(self, status: str | None, first_seen: str | None, history: list[tuple]) -> None:
        self.now.update((status, first_seen))
        if history:
            self.events.put(history)
        else:
            self.events.clear()

    def _remind(self, last_ms: int) -> None:
        due = max([last_ms + self.keep_days * _DAY_MS, *(earlier := list(self.handle.listTimers()))])
        for at in earlier:
            self.handle.deleteTimer(at)
        self.handle.registerTimer(due)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._keep(initialState["status"], initialState["first_seen"], [(e["status"], e["day"]) for e in initialState["history"] or []])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, first_seen = self.now.get() if self.now.exists() else (None, None)
        history = self._events()
        commands = sorted((r.asDict() for r in rows), key=lambda c: c["seq"])
        status, refused = replay(status, history, first_seen, commands, self.statuses)
        self._keep(status, first_seen, history)
        if self.keep_days is not None:
            self._remind(max((int(c["at"].timestamp() * 1000) for c in commands if c["at"] is not None), default=timerValues.getCurrentWatermarkInMs()))
        yield self._out(key, status, history, refused, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, _ = self.now.get() if self.now.exists() else (None, None)
        history = self._events()
        self.now.clear()
        self.events.clear()
        yield self._out(key, status or "new", history, [], True)


def histories(commands: DataFrame, state: DataFrame | None = None, statuses: tuple = STATUSES, keep_days: int | None = None, late: str = "1 day") -> DataFrame:
    """A stream of commands(id, seq, kind, status, day, place, seen_status, seen_day, and at with keep_days) -> for each batch the entities that it
    had commands for: (id, status, history, refused, expired); refused lists the batch's commands that no longer fitted.
    state(id, status, first_seen, history) is what a new stream starts from, one row an entity. Rules are those of
    operators.history.fold."""
    initial = state.select("id", "status", "first_seen", "history").groupBy("id") if state is not None else None
    if keep_days is not None:
        commands = commands.withWatermark("at", late)
    return commands.groupBy("id").transformWithState(_Histories(statuses, keep_days), OUT, "Update", "None" if keep_days is None else "EventTime", initial)


_STATE = "id string, status string, first_seen string, history array<struct<status:string,day:string>>, refused array<string>, changed boolean"


def run_histories(stream: DataFrame, state: DataFrame, path: str, checkpoint: str, statuses: tuple = STATUSES) -> DataFrame:
    """Run over what is there of a stream of commands, as histories takes them -> the state after it: (id, status, first_seen,
    history). state is what a new stream starts from, one row an entity.

    Batch n writes the whole state into path/state=n, from the one before, and the entities that it had commands for
    into path/changes=n: (id, status, history, refused, changed_in). A batch that is tried again does both anew; the
    state it starts from stays until the next one is through.
    """
    spark = stream.sparkSession
    fs, root = file_system(spark, path)

    def versions() -> list[int]:
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removeprefix("state=")) for n in names if n.startswith("state="))

    def after(number: int) -> DataFrame:
        return spark.read.schema(_STATE).parquet(f"{path}/state={number}")

    def put(batch: DataFrame, number: int) -> None:
        earlier = [n for n in versions() if n < number]
        advance(after(earlier[-1]) if earlier else state, batch, statuses).write.mode("overwrite").parquet(f"{path}/state={number}")
        changed = after(number).where("changed").select("id", "status", "history", "refused", F.lit(number).alias("changed_in"))
        changed.write.mode("overwrite").parquet(f"{path}/changes={number}")
        for old in earlier[:-1]:
            fs.delete(file_system(spark, f"{path}/state={old}")[1], True)

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    there = versions()
    return (after(there[-1]) if there else state).select("id", "status", "first_seen", "history")
