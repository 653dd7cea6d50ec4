"""Decision histories as folded commands: set a status, edit, delete and undo events, each checked against what the
user saw.

Histories are small and their commands sequential, so an entity's commands run in order in one task; entities run
apart. Commands that no longer fit are refused and say why; nothing else of the entity changes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("new", "interesting", "waiting", "ignored", "applied", "response", "interview", "trial_day", "rejected", "offer", "no_response", "withdrawn", "closed")
APPLICATIONS = STATUSES[4:]
OUT = "id string, status string, first_seen string, history array<struct<status:string,day:string>>, refused array<string>, changed boolean"


def _current(history: list[tuple]) -> str:
    """Status of the last event by date, unknown dates first, else of the order they came in."""
    return max(enumerate(history), key=lambda x: (x[1][1] is not None, x[1][1] or "", x[0]))[1][0] if history else "new"


def replay(status: str | None, history: list[tuple], first_seen: str | None, commands: Iterable[dict], statuses: tuple = STATUSES) -> tuple[str, list[str]]:
    """Run an entity's commands in order on its history, in place: its status then, and what was refused and why."""
    status = status or _current(history)
    refused: list[str] = []
    for c in commands:
        event, seen, place, why = (c["status"], c["day"]), (c["seen_status"], c["seen_day"]), c["place"], None
        place = -1 if place is None else int(place)
        if c["kind"] in ("set", "edit") and c["status"] not in statuses:
            why = "unknown status"
        elif c["kind"] == "set":
            if status != c["status"] and not history and status in statuses:
                history.append((status, first_seen if status == "new" else None))
            if (status != c["status"] or c["day"] is not None) and event not in history:
                history.append(event)
        elif c["kind"] in ("edit", "delete"):
            if not 0 <= place < len(history):
                why = "no such event"
            elif history[place] != seen:
                why = "changed meanwhile"
            elif c["kind"] == "edit" and event in history[:place] + history[place + 1 :]:
                why = "event exists"
            elif c["kind"] == "edit":
                history[place] = event
            else:
                history.pop(place)
        elif c["kind"] == "undo":
            if status in APPLICATIONS or any(s in APPLICATIONS for s, _ in history):
                why = "an application"
            elif status != "ignored" or not history or history[-1][0] != "ignored":
                why = "changed meanwhile"
            else:
                history.pop()
        else:
            why = "unknown command"
        if why:
            refused.append(f"{c['seq']}: {why}")
        else:
            status = _current(history)
    return status, refused


_COMMAND = ("seq", "kind", "status", "day", "place", "seen_status", "seen_day")
_BATCH = 10_000


def _emitted(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as OUT has them."""
    events = pa.list_(pa.struct([("status", pa.string()), ("day", pa.string())]))
    ids, status, first_seen, histories, refused, changed = zip(*rows)
    shown = [None if h is None else [{"status": s, "day": d} for s, d in h] for h in histories]
    columns = [*(pa.array(x, pa.string()) for x in (ids, status, first_seen)), pa.array(shown, events), pa.array(refused, pa.list_(pa.string())), pa.array(changed)]
    return pa.RecordBatch.from_arrays(columns, ["id", "status", "first_seen", "history", "refused", "changed"])


def _folder(statuses: tuple, null_is_id: bool):
    def entity(key, states: list[tuple], commands: list[dict]) -> list[tuple]:
        if not commands or key is None and not null_is_id:
            out = [(key, status, first_seen, None if h is None else [(e["status"], e["day"]) for e in h], [], False) for status, first_seen, h in states]
            states = []
            if not commands:
                return out
        else:
            out = []
        status, first_seen, known = states[0] if states else (None, None, None)
        history = [(e["status"], e["day"]) for e in known or []]
        status, refused = replay(status, history, first_seen, commands, statuses)
        return [*out, (key, status, first_seen, history, refused, True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, states, commands = None, [], []
        for batch in batches:
            ids, own, first, known = (batch.column(c).to_pylist() for c in ("id", "own", "first_seen", "history"))
            columns = [batch.column(c).to_pylist() for c in _COMMAND]
            for key, is_state, first_seen, history, *command in zip(ids, own, first, known, *columns):
                if key != now:
                    done += entity(now, states, commands)
                    now, states, commands = key, [], []
                    if len(done) >= _BATCH:
                        yield _emitted(done)
                        done = []
                if is_state:
                    states.append((command[2], first_seen, history))
                else:
                    commands.append(dict(zip(_COMMAND, command)))
        done += entity(now, states, commands)
        if done:
            yield _emitted(done)

    return run


def fold(state: DataFrame, commands: DataFrame, statuses: tuple = STATUSES) -> DataFrame:
    """state(id, status, first_seen, history) and commands(id, seq, kind, status, day, place, seen_status, seen_day) ->
    (id, status, history, refused).

    kind set: append an event; the first change of a new entity also records where it came from. edit and delete: the
    event at place must still be the one seen; an edit may not repeat another event. undo: the entity must still be
    ignored, by its last event, and no application. An event that is there already is not repeated.

    Entities and commands are dealt by id and sorted, each entity before its commands, and a task reads them in one
    go: nothing is set up for an entity of its own, and only one entity's commands are held at a time.
    """
    return advance(state, commands, statuses, False).select("id", "status", "history", "refused")


def advance(state: DataFrame, commands: DataFrame, statuses: tuple = STATUSES, null_is_id: bool = True) -> DataFrame:
    """As fold, with the columns of a state to go on from and whether there were commands: (id, status, first_seen, history,
    refused, changed). null_is_id: rows of a null id are one entity; else its commands meet no state."""
    none = lambda kind: F.lit(None).cast(kind)
    events = "array<struct<status:string,day:string>>"
    own = state.select(F.col("id").cast("string").alias("id"), F.lit(True).alias("own"), "first_seen", F.transform("history", lambda e: F.struct(e["status"].alias("status"), e["day"].alias("day"))).cast(events).alias("history"), none("long").alias("seq"), none("string").alias("kind"), "status", *[none("int" if c == "place" else "string").alias(c) for c in _COMMAND[3:]])
    todo = commands.select(F.col("id").cast("string").alias("id"), F.lit(False).alias("own"), none("string").alias("first_seen"), none(events).alias("history"), F.col("seq").cast("long").alias("seq"), "kind", "status", "day", F.col("place").cast("int").alias("place"), "seen_status", "seen_day")
    dealt = own.unionByName(todo).repartition("id").sortWithinPartitions("id", F.desc("own"), F.asc_nulls_last("seq"))
    return dealt.mapInArrow(_folder(statuses, null_is_id), OUT)
