"""Event streams of runs: one reducer for a run, applied per run in batch or as state of a stream, and folds that need no state.

An event row: run_id, seq, kind, task_id, message_id, output, is_final, is_reasoning, is_sequence, checkpoint_id, waiting.
Kinds: user, message, token, delete, start, end, stopping, released, overlay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = (
    "run_id string, seq long, kind string, task_id string, message_id string, output string, is_final boolean, is_reasoning boolean, "
    "is_sequence boolean, checkpoint_id string, waiting boolean"
)
CHANGE = "run_id string, seq long, change string, message_id string, text string, status string"
FIELDS = [c.split()[0] for c in EVENT.split(", ")]
DONE = ("succeeded", "failed", "cancelled")
FINALISE_MS = 10_000


@dataclass
class Message:
    """What a run holds of a message besides its text: place in the order of first sight, turn for which it is final (0: none)."""

    position: int
    final: int = 0
    streamed: bool = False
    completed: bool = False
    alive: bool = True


class Messages:
    """A run's messages in memory. A stream keeps them as keyed state instead, under the same four methods."""

    def __init__(self):
        self.held: dict[str, Message] = {}
        self.texts: dict[str, list[str]] = {}

    def get(self, name: str) -> Message | None:
        return self.held.get(name)

    def put(self, name: str, message: Message, text: str | None = None, more: str | None = None) -> None:
        """Keep a message; its text is replaced by text, or more is added to it, or stays."""
        self.held[name] = message
        if text is not None:
            self.texts[name] = [text]
        elif more is not None:
            self.texts[name].append(more)

    def text(self, name: str) -> str:
        return "".join(self.texts[name])

    def drop(self, name: str, message: Message) -> None:
        """Forget a message and its text, but for the fact that it has been completed."""
        del self.texts[name]
        if message.completed:
            self.held[name] = replace(message, alive=False, final=0, streamed=False)
        else:
            del self.held[name]

    def finals(self, turn: int) -> Iterable[tuple[int, str]]:
        """Position and name of the final messages of a turn; only asked for when the latest one is deleted."""
        return ((m.position, name) for name, m in self.held.items() if m.alive and m.final == turn)


@dataclass
class Run:
    """State of one run without its messages: some scalars, whatever its length."""

    status: str = "submitting"
    task: str | None = None
    ended: bool = False
    cancel: bool = False
    announced: bool = False
    latest_checkpoint: str | None = None
    answered: str | None = None
    waiting: bool = False
    turn: int = 1
    seen: int = 0
    final: str | None = None
    final_position: int = 0
    deadline: int | None = None
    messages: Messages = field(default_factory=Messages, repr=False, compare=False)

    def _stale(self, task: str | None) -> bool:
        return task is not None and self.task is not None and task != self.task

    def _complete(self) -> list[tuple[str, str | None, str]]:
        """The run succeeds once its task has ended and a final message of the present turn is there; once per message."""
        last = self.final
        if not self.ended or last is None or self.cancel or self.status in DONE:
            return []
        message = self.messages.get(last)
        if message.completed:
            return []
        self.status = "succeeded"
        self.messages.put(last, replace(message, completed=True))
        return [("completed", last, self.messages.text(last))]

    def step(self, e: dict) -> list[tuple[str, str | None, str]]:
        """Takes one event in; returns the changes (kind, message, text) that follow from it."""
        kind, task, message = e["kind"], e.get("task_id"), e.get("message_id")
        if kind == "user":
            self.turn += 1
            self.ended, self.final = False, None
            if self.status == "succeeded":
                self.status = "running"
            return []
        if kind == "start":
            if self.status in DONE:
                return []
            self.task, self.ended = task or self.task, False
            self.status = "cancelling" if self.cancel else "running"
            return [("started", None, "")]
        if kind == "end":
            if self.status in ("failed", "cancelled") or self._stale(task):
                return []
            self.task, self.ended = task or self.task, True
            if self.cancel:
                self.status = "cancelling"
                return []
            return self._complete()
        if kind == "stopping":
            if self.status in DONE or self._stale(task):
                return []
            self.cancel, self.task, self.status = True, task or self.task, "cancelling"
            first, self.announced = not self.announced, True
            return [("cancelling", None, "")] if first else []
        if kind == "released":
            if not self.cancel or self.status == "cancelled" or self._stale(task):
                return []
            self.task, self.status, self.waiting = task or self.task, "cancelled", False
            return [("cancelled", None, "")]
        if kind == "overlay":
            return self._overlay(e.get("checkpoint_id"), bool(e.get("waiting")))
        if message is None:
            return []
        held = self.messages.get(message)
        if held is not None and not held.alive:
            held = replace(held, position=0)
        if kind == "delete":
            return self._delete(message, held)
        if kind == "token":
            return self._token(message, held, e)
        return self._message(message, held, e) if kind == "message" else []

    def _overlay(self, checkpoint: str | None, waiting: bool) -> list[tuple[str, str | None, str]]:
        if checkpoint and self.latest_checkpoint and checkpoint < self.latest_checkpoint:
            return []
        if waiting and checkpoint is not None and self.answered is not None and checkpoint <= self.answered:
            return []
        self.latest_checkpoint = checkpoint or self.latest_checkpoint
        was, self.waiting = self.waiting, waiting
        return [("needs_input", None, checkpoint or "")] if waiting and not was else []

    def _delete(self, name: str, held: Message | None) -> list[tuple[str, str | None, str]]:
        if held is None or not held.alive:
            return []
        self.messages.drop(name, held)
        if self.final == name:
            self.final_position, self.final = max(self.messages.finals(self.turn), default=(0, None))
        return [("retract", name, "")] if held.streamed else []

    def _token(self, name: str, held: Message | None, e: dict) -> list[tuple[str, str | None, str]]:
        if held is None or not held.alive:
            return []
        text = e.get("output") or ""
        if e.get("is_sequence"):
            return self._snapshot(name, held, text, False)
        if text:
            self.messages.put(name, replace(held, streamed=True), more=text)
        return [("append", name, text)] if text else []

    def _message(self, name: str, held: Message | None, e: dict) -> list[tuple[str, str | None, str]]:
        new = held is None or not held.alive
        if new:
            self.seen += 1
            held = Message(self.seen, completed=held is not None and held.completed)
        if e.get("is_final"):
            held = replace(held, final=self.turn)
            if self.final is None or held.position >= self.final_position:
                self.final, self.final_position = name, held.position
        return self._snapshot(name, held, e.get("output") or "", new, new and bool(e.get("is_reasoning"))) + self._complete()

    def _snapshot(self, name: str, held: Message, now: str, new: bool, show: bool = False) -> list[tuple[str, str | None, str]]:
        """A whole text: what was added, if it goes on from the old one, or all of it; nothing if nothing was added, but for the first
        sight of reasoning (show)."""
        old = "" if new else self.messages.text(name)
        if now == old and not show:
            self.messages.put(name, held, text=now if new else None)
            return []
        self.messages.put(name, replace(held, streamed=True), text=now)
        return [("append", name, now[len(old) :]) if now.startswith(old) else ("replace", name, now)]

    def expire(self) -> list[tuple[str, str | None, str]]:
        """The task ended, and no final message came in time."""
        if not self.ended or self.status in DONE or self.cancel:
            return []
        self.status = "failed"
        return [("failed", None, "no final message")]


def _fold(run_id: str, run: Run, events: Iterable[dict]) -> list[tuple]:
    return [(run_id, e["seq"], *change, run.status) for e in events for change in run.step(e)]


def _rows(pdf: pd.DataFrame) -> list[dict]:
    pdf = pdf.sort_values("seq", kind="stable")
    return [{k: (None if v is None or v != v else v) for k, v in r.items()} for r in pdf.astype(object).to_dict("records")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGE.split(", ")])


def fold_runs(events: DataFrame) -> DataFrame:
    """All changes of finished logs: each run's events in the order of seq through the reducer."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame(_fold(pdf["run_id"].iloc[0], Run(), _rows(pdf)))

    return events.select(*FIELDS).groupBy("run_id").applyInPandas(run, CHANGE)


RUN_STATE = "status string, task string, ended boolean, cancel boolean, announced boolean, latest_checkpoint string, answered string, waiting boolean, turn int, seen int, final string, final_position int, deadline long"
MESSAGE_STATE = "position int, final int, streamed boolean, completed boolean, alive boolean, pieces int"


class KeyedMessages(Messages):
    """A run's messages as map state: one entry a message, and one for each piece of its text, so a token writes its own characters only. Entries read in
    a batch are kept until its end."""

    def __init__(self, messages, pieces):
        self.state, self.pieces = messages, pieces
        self.read: dict[str, tuple[Message, int] | None] = {}

    def _entry(self, name: str) -> tuple[Message, int] | None:
        if name not in self.read:
            found = self.state.getValue((name,)) if self.state.containsKey((name,)) else None
            self.read[name] = None if found is None else (Message(*found[:5]), found[5])
        return self.read[name]

    def get(self, name: str) -> Message | None:
        entry = self._entry(name)
        return entry and entry[0]

    def put(self, name: str, message: Message, text: str | None = None, more: str | None = None) -> None:
        before = self._entry(name)
        n = before[1] if before else 0
        if text is not None:
            self._forget(name, range(1, n))
            self.pieces.updateValue((name, 0), (text,))
            n = 1
        elif more is not None:
            self.pieces.updateValue((name, n), (more,))
            n += 1
        if before != (message, n):
            self.read[name] = (message, n)
            self.state.updateValue((name,), (message.position, message.final, message.streamed, message.completed, message.alive, n))

    def text(self, name: str) -> str:
        return "".join(self.pieces.getValue((name, k))[0] for k in range(self._entry(name)[1]))

    def drop(self, name: str, message: Message) -> None:
        self._forget(name, range(self._entry(name)[1]))
        self.read[name] = None
        if message.completed:
            gone = replace(message, alive=False, final=0, streamed=False)
            self.read[name] = (gone, 0)
            self.state.updateValue((name,), (gone.position, 0, False, True, False, 0))
        else:
            self.state.removeKey((name,))

    def finals(self, turn: int) -> Iterable[tuple[int, str]]:
        return ((v[0], k[0]) for k, v in self.state.iterator() if v[4] and v[1] == turn)

    def _forget(self, name: str, numbers: Iterable[int]) -> None:
        for k in numbers:
            self.pieces.removeKey((name, k))


class RunProcessor(StatefulProcessor):
    """The reducer over keyed state: the run's scalars as one value, its messages and the pieces of their texts as maps, its deadline as a timer."""

    def __init__(self, finalise_ms: int | None, ttl_ms: int | None):
        self.finalise_ms, self.ttl_ms = finalise_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN_STATE, self.ttl_ms)
        self.messages = handle.getMapState("messages", "name string", MESSAGE_STATE, self.ttl_ms)
        self.pieces = handle.getMapState("pieces", "name string, piece int", "text string", self.ttl_ms)

    def _held(self) -> Run:
        scalars = tuple(self.run.get()) if self.run.exists() else ()
        return Run(*scalars, messages=KeyedMessages(self.messages, self.pieces))

    def _keep(self, run: Run, now_ms: int) -> None:
        if run.deadline is not None:
            self.handle.deleteTimer(run.deadline)
            run.deadline = None
        if self.finalise_ms is not None and run.ended and run.status not in DONE:
            run.deadline = now_ms + self.finalise_ms
            self.handle.registerTimer(run.deadline)
        self.run.update(tuple(getattr(run, c.split()[0]) for c in RUN_STATE.split(", ")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, parts = self._held(), list(rows)
        changes = _fold(key[0], run, _rows(pd.concat(parts))) if parts else []
        self._keep(run, timerValues.getCurrentProcessingTimeInMs())
        yield _frame(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = self._held()
        if run.deadline != expiredTimerInfo.getExpiryTimeInMs():
            yield _frame([])
            return
        changes = [(key[0], None, *change, run.status) for change in run.expire()]
        run.deadline = None
        self.run.update(tuple(getattr(run, c.split()[0]) for c in RUN_STATE.split(", ")))
        yield _frame(changes)

    def close(self) -> None:
        pass


#: The state store that keyed state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_runs(events: DataFrame, finalise_ms: int | None = FINALISE_MS, ttl_ms: int | None = None) -> DataFrame:
    """The same as a stream: changes appended as events come in; a run whose task has ended and that gets no final message within finalise_ms fails.

    Deadlines are checked by further batches, so the stream goes on without new events until it is stopped; finalise_ms = None leaves
    them out, for streams that take in what is there (trigger availableNow) and end.

    State is keyed (RunProcessor), so what a batch writes follows its new events and not the length of the runs. The session's state store
    has to be RocksDB (STATE_STORE). With ttl_ms, values not written for so long are forgotten, and runs that go on after that begin anew.
    """
    if events.sparkSession.conf.get(STATE_STORE[0], "").rpartition(".")[2] != STATE_STORE[1].rpartition(".")[2]:
        raise ValueError(f"set {STATE_STORE[0]} to {STATE_STORE[1]}")
    return events.select(*FIELDS).groupBy("run_id").transformWithStateInPandas(RunProcessor(finalise_ms, ttl_ms), CHANGE, "append", "none" if finalise_ms is None and ttl_ms is None else "processingTime")


def bounded_history(events: DataFrame, run: str, order: list[str], keep: int = 2000) -> DataFrame:
    """events with sequence (from 1 per run, in order), the last keep of each run.

    Rows are numbered from the end, so that only keep rows of a run are ranked on; a run's length, a map-side combined count, turns the numbers round.
    """
    down = [F.col(c).desc() for c in order]
    latest = events.withColumn("__back", F.row_number().over(Window.partitionBy(run).orderBy(*down))).where(F.col("__back") <= keep)
    lengths = events.groupBy(F.col(run).alias("__run")).agg(F.count("*").alias("__n"))
    return latest.join(lengths, F.col(run).eqNullSafe(F.col("__run"))).withColumn("sequence", (F.col("__n") - F.col("__back") + 1).cast("int")).drop("__run", "__n", "__back")


def replay_after(history: DataFrame, cursor: int) -> DataFrame:
    return history.where(F.col("sequence") > cursor)


def upsert_messages(messages: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, position (first seen), value (last seen)."""
    return messages.groupBy(key).agg(F.min(order).alias("position"), F.max_by(value, order).alias(value))


def deltas(snapshots: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Cumulative snapshots as changes: append what was added, or replace all; empty appends are left out."""
    before = F.lag(text).over(Window.partitionBy(*by).orderBy(order))
    old = F.coalesce(before, F.lit(""))
    grows = F.startswith(F.col(text), old)
    change = snapshots.withColumn("change", F.when(grows, "append").otherwise("replace")).withColumn("delta", F.when(grows, F.substring(F.col(text), F.length(old) + 1, F.length(text))).otherwise(F.col(text)))
    return change.where((F.col("change") == "replace") | (F.col("delta") != ""))


def latest_after_user(messages: DataFrame, conversation: str, order: str, role: str, chosen: Column) -> DataFrame:
    """Per conversation the last chosen row after the last user row, if any."""
    w = Window.partitionBy(conversation)
    last_user = F.max(F.when(F.col(role) == "user", F.col(order))).over(w)
    rows = messages.withColumn("__user", last_user).where(chosen & (F.col("__user").isNull() | (F.col(order) > F.col("__user"))))
    latest = rows.withColumn("__last", F.max(order).over(w)).where(F.col(order) == F.col("__last"))
    return latest.drop("__user", "__last")


def monotone_checkpoints(events: DataFrame, run: str, order: str, checkpoint: str) -> DataFrame:
    """Rows whose checkpoint (compared as text) is not older than any before it in the run."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(checkpoint).over(w)
    return events.withColumn("__best", best).where(F.col("__best").isNull() | (F.col(checkpoint) >= F.col("__best"))).drop("__best")


def latest_error(messages: DataFrame, conversation: str, order: str, role: str, kind: str) -> DataFrame:
    """Per conversation the last row of kind error after the last user row, if any."""
    return latest_after_user(messages, conversation, order, role, F.col(kind) == "error")


def latest_stop(messages: DataFrame, conversation: str, order: str, role: str, kind: str) -> DataFrame:
    """Per conversation the last row of kind stopped (a stop by hand) after the last user row, if any."""
    return latest_after_user(messages, conversation, order, role, F.col(kind) == "stopped")


def completions(changes: DataFrame, time: str | None = None, late: str = "1 day") -> DataFrame:
    """One completion per run and final message. Over a stream, time names its event time: completions are told apart within the
    watermark, and older ones are forgotten, so the state does not grow for ever; a stream without it raises ValueError."""
    done = changes.where("change = 'completed'")
    if not changes.isStreaming:
        return done.dropDuplicates(["run_id", "message_id"])
    if time is None:
        raise ValueError("completions of a stream need an event time")
    return done.withWatermark(time, late).dropDuplicatesWithinWatermark(["run_id", "message_id"])


PROGRESS = "struct<done:boolean,phases:array<struct<id:string,kind:string,state:string,label:string,detail:string,count:struct<done:bigint,total:bigint>,started_at:double,duration_s:double>>>"


def progress_phases(messages: DataFrame, metadata: str) -> DataFrame:
    """Progress cards from JSON metadata: done, phases (those with id, kind, state and label), active (label of the first running
    phase), message ('label (done/total)'). Rows that are no progress card are left out."""
    parsed = messages.withColumn("__m", F.from_json(metadata, f"struct<section:string,progress:{PROGRESS}>")).where("__m.section = 'progress'")
    good = F.filter(F.coalesce(F.col("__m.progress.phases"), F.from_json(F.lit("[]"), PROGRESS.split("phases:")[1][:-1])), lambda p: p["id"].isNotNull() & p["kind"].isNotNull() & p["state"].isNotNull() & p["label"].isNotNull())
    out = parsed.withColumn("phases", good).withColumn("done", F.coalesce(F.col("__m.progress.done"), F.lit(False)))
    active = F.get(F.filter("phases", lambda p: p["state"] == "active"), F.lit(0))
    label = F.when(active["count"]["total"].isNotNull(), F.concat(active["label"], F.lit(" ("), F.coalesce(active["count"]["done"], F.lit(0)), F.lit("/"), active["count"]["total"], F.lit(")"))).otherwise(active["label"])
    return out.withColumn("active", active["label"]).withColumn("message", label).drop("__m")


def event_counts(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts per tumbling window of event time; rows later than the watermark are dropped. For batches and streams alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")
