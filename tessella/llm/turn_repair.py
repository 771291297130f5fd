"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate, by a fold in Spark SQL.

Roles have to read (s?(ua)+)?: nothing, or a system turn or none and pairs of user and assistant. The pattern has four states: nothing said
yet, after the system turn, after a user, after an assistant. Faults of turns come from windows; the turns of a chunk are collected as
sorted structs, and aggregate() carries one (cost, audit) struct for each state through least(). Of equal costs, no audit is
the beginning of another one, so comparing beginnings is comparing whole audits, and folds of neighbouring chunks can be joined: a conversation of many
turns is folded in chunks from each of the four states, and those are joined in a tree.

Inside, an audit tells the role of each edit: D deletes, I and J insert a user or an assistant, K, L and M keep a user, an assistant or a
system turn, R and S give a turn the role of user or assistant. The order of these letters is that of D, I, K, R.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import in_bitmap, materialise, without_ids

#: Turn numbers to a chunk; folded chunks that are joined at once.
CHUNK, FAN = 64, 64
STATES = range(4)
BLANKS = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE = 2, 2, 3
#: More than any conversation costs.
FAR = 1 << 40


@dataclass
class Repaired:
    """summary: one row per conversation with turns (key, gaps, blank, duplicate, truncated, illegal, cost, audit); turns: the repaired
    turns (key, chunk, whole, said: array of role and text), all in one row where whole is true, else in rows by chunk."""

    summary: DataFrame
    turns: DataFrame


def key_of(column: Column) -> Column:
    """A conversation's key: its id as text behind '=', the empty text for a null id."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _edit(v: Column, cost, letter) -> Column:
    return F.struct(F.least(v["cost"] + cost, F.lit(FAR)).alias("cost"), F.concat(v["audit"], letter if isinstance(letter, Column) else F.lit(letter)).alias("audit"))


def _vector(*states: Column) -> Column:
    return F.struct(*[s.alias(f"q{k}") for k, s in enumerate(states)])


def _start(state: Column) -> Column:
    return _vector(*[F.struct(F.when(state == k, 0).otherwise(FAR).cast("long").alias("cost"), F.lit("").alias("audit")) for k in STATES])


def _matrix(parts: str, step) -> Column:
    """parts folded from each of the four states."""
    return F.transform(F.array(*map(F.lit, STATES)), lambda k: F.aggregate(parts, _start(k), step))


def _inserted(v: Column) -> Column:
    """v with the insertions that are of use before the next turn."""
    user = F.least(v["q2"], *[_edit(v[f"q{k}"], INSERT, "I") for k in (0, 1, 3)])
    return _vector(v["q0"], v["q1"], user, F.least(v["q3"], _edit(user, INSERT, "J")))


def _step(v: Column, turn: Column) -> Column:
    def on(c: Column) -> Column:
        drop = [_edit(c[f"q{k}"], DELETE, "D") for k in STATES]
        to_user = [_edit(c[f"q{k}"], turn["u_cost"], turn["u"]) for k in (0, 1, 3)]
        return _vector(drop[0], F.least(drop[1], _edit(c["q0"], turn["s_cost"], "M")), F.least(drop[2], *to_user), F.least(drop[3], _edit(c["q2"], turn["a_cost"], turn["a"])))

    return let(_inserted(v), on)


def _joined(v: Column, matrix: Column) -> Column:
    """v carried on through a folded chunk: matrix has, for each state before it, the four states behind it."""
    through = lambda q, r: _edit(v[f"q{q}"], matrix[q][f"q{r}"]["cost"], matrix[q][f"q{r}"]["audit"])
    return _vector(*[F.least(*[through(q, r) for q in STATES]) for r in STATES])


def _closed(v: Column) -> Column:
    """The cheapest (cost, audit) of a whole conversation."""
    return let(_inserted(v), lambda c: F.least(c["q0"], c["q3"]))


def faults(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None) -> DataFrame:
    """Each different (turn, role, text) of a conversation once: key, turn, role, text, copies, blank, again (said by an earlier turn)."""
    # rows that repeat are counted before they move, and stay one turn with a number of copies
    copies = F.col(f"`{copies_col}`").cast("long") if copies_col else F.lit(1).cast("long")
    turns = rows.select(key_of(F.col(f"`{conv_col}`")).alias("key"), F.col(f"`{turn_col}`").cast("long").alias("turn"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))], copies.alias("copies"))
    each = turns.groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    nth = F.row_number().over(Window.partitionBy("key", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    return each.withColumn("blank", F.rtrim("text", F.lit(BLANKS)) == "").withColumn("again", nth > 1)


def chunks(turns: DataFrame) -> DataFrame:
    """The turns of each chunk as sorted structs, and what they count for: key, chunk, turns, blank, duplicate, truncated, illegal, extra (cost of deleting copies)."""
    initial, last = F.substring("role", 1, 1), F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    must = F.col("blank") | F.col("again")
    short = (~must & ~last.isin(".", "!", "?")).cast("long")
    cost = lambda letter, other: F.when(must, FAR).when(initial == letter, short).otherwise(other)
    turn = F.struct(
        "turn", "role", "text", "copies", initial.alias("initial"), "blank", must.alias("must"), short.alias("truncated"),
        cost("s", F.lit(FAR)).cast("long").alias("s_cost"), cost("u", REROLE + short).cast("long").alias("u_cost"), cost("a", REROLE + short).cast("long").alias("a_cost"),
        F.when(initial == "u", "K").otherwise("R").alias("u"), F.when(initial == "a", "L").otherwise("S").alias("a"),
    )
    chunk = F.coalesce(F.shiftright("turn", CHUNK.bit_length() - 1), F.lit(-(1 << 62)))
    some = turns.select("key", chunk.alias("chunk"), turn.alias("t")).groupBy("key", "chunk").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    total = lambda f: F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + f(t))
    n = F.size("turns")
    adjacent = F.zip_with(F.slice("turns", 1, n - 1), F.slice("turns", 2, n), lambda a, b: F.concat(a["initial"], b["initial"]))
    return some.withColumns(
        {
            "blank": total(lambda t: F.when(t["blank"], t["copies"]).otherwise(0)),
            "duplicate": total(lambda t: F.when(t["blank"], 0).otherwise(t["copies"] - F.when(t["must"], 0).otherwise(1))),
            "truncated": total(lambda t: t["truncated"]),
            "extra": total(lambda t: (t["copies"] - 1) * DELETE),
            "illegal": total(lambda t: t["copies"] - 1) + F.size(F.filter(adjacent, lambda p: ~p.isin("su", "ua", "au"))),
            "distinct_turns": F.size(F.array_distinct(F.filter("turns.turn", lambda t: t.isNotNull()))),
        }
    )


def _pieces(audit: Column) -> Column:
    """The edits of an audit by turn, each with the insertions before it."""
    return F.regexp_extract_all(audit, F.lit("[IJ]*[DKLMRS]"), F.lit(0))


def _tail(audit: Column) -> Column:
    return F.regexp_extract(audit, "[IJ]*$", 0)


def _said(pieces: Column, turns: Column) -> Column:
    """Role and text of what the edits of each turn say."""
    letters = lambda p: F.filter(F.split(p, ""), lambda x: ~x.isin("D", ""))
    role = lambda x, t: F.when(x.isin("I", "R"), "user").when(x.isin("J", "S"), "assistant").otherwise(t["role"])
    text = lambda x, t: F.when(x.isin("I", "J"), "").otherwise(t["text"])
    return F.flatten(F.zip_with(pieces, turns, lambda p, t: F.transform(letters(p), lambda x: F.struct(role(x, t).alias("role"), text(x, t).alias("text")))))


def _said_last(tail: Column) -> Column:
    return F.transform(F.filter(F.split(tail, ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "I", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))


def _shown(pieces: Column, turns: Column) -> Column:
    """The part of the audit that users see: one initial per edit, copies deleted one by one."""
    return F.array_join(F.zip_with(pieces, turns, lambda p, t: F.concat(F.translate(p, "JLMS", "IKKR"), F.repeat(F.lit("D"), (t["copies"] - 1).cast("int")))), "")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> Repaired:
    """The cheapest repair of every conversation, and its faults.

    Turns are taken by number (nulls first), then role, then text. A turn is blank (no characters but white space), else a duplicate (role and text
    seen earlier in the conversation), else truncated (its last other character is not . ! or ?). Edits: keep a turn (K, free), give it
    the role of user or assistant (R, 2), delete it (D, 3; blank turns and duplicates have to go), insert an empty user or assistant turn (I, 2);
    a truncated turn that stays adds 1. Of the cheapest edits that give roles whose initials read (s?(ua)+)?, the audit that comes first in ASCII is taken.
    illegal counts adjacent roles whose initials are not su, ua or au; gaps are numbers missing between the first and the last turn, nulls left
    aside. Null roles and texts are one space. Rows that repeat are duplicates (copies_col: how many times a row counts, 1 at least). A null id is a
    conversation of its own; other columns are not read; an empty table gives empty results.

    A conversation is collected in chunks of CHUNK turn numbers; only its audit, one letter a turn, is in one row. Rows of one conversation with
    the same turn number but different texts are in one chunk.
    """
    parts = materialise(chunks(faults(rows, conv_col, turn_col, role_col, text_col, copies_col)), "chunks")
    by_chunk = Window.partitionBy("key").orderBy("chunk")
    number = F.col("turns.turn")
    marks = materialise(
        parts.select("key", "chunk", "blank", "duplicate", "truncated", "extra", "illegal", "distinct_turns", F.size("turns").alias("n"), F.array_min(number).alias("low"), F.array_max(number).alias("high"), F.col("turns")[0]["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last"))
        .withColumn("place", F.row_number().over(by_chunk) - 1)
        .withColumn("offset", F.sum("n").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .withColumn("border", F.concat(F.lag("last").over(by_chunk), "first")),
        "chunk-marks",
    )
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("distinct_turns"), F.lit(0)).cast("long")
    border = F.count(F.when(~F.col("border").isin("su", "ua", "au"), 1))
    counts = marks.groupBy("key").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "extra")], (F.sum("illegal") + border).alias("illegal"))
    long = materialise(marks.where("place > 0").select("key").distinct(), "long-conversations")

    folded = without_ids(parts.select("key", "chunk", "turns"), "key", long).withColumn("best", _closed(F.aggregate("turns", _start(F.lit(0)), _step)))
    pieces = _pieces(F.col("best.audit"))
    short = folded.select("key", "chunk", F.col("best.cost").alias("cost"), F.concat(_shown(pieces, F.col("turns")), F.translate(_tail(F.col("best.audit")), "J", "I")).alias("audit"), F.concat(_said(pieces, F.col("turns")), _said_last(_tail(F.col("best.audit")))).alias("said"))
    short = materialise(short, "short-repairs")

    n = marks.agg(F.max("place")).first()[0] or 0
    if not n:
        summary = counts.join(short.select("key", "cost", "audit"), "key")
        return Repaired(summary.withColumn("cost", F.col("cost") + F.col("extra")).drop("extra"), short.select("key", "chunk", F.lit(True).alias("whole"), "said"))
    shared = in_bitmap(parts.select("key", "chunk", "turns"), "key", long).join(long, "key", "left_semi")
    matrices = shared.select("key", "chunk", _matrix("turns", _step).alias("m")).join(marks.select("key", "chunk", "place"), ["key", "chunk"]).select("key", "place", "m")
    while n > 0:
        grouped = matrices.groupBy("key", F.floor(F.col("place") / FAN).alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "m"))).alias("ms"))
        matrices = materialise(grouped.select("key", "place", _matrix("ms", lambda v, b: _joined(v, b["m"])).alias("m")), "matrices")
        n //= FAN
    best = matrices.select("key", _closed(F.col("m")[0]).alias("best"))
    places = marks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk", "offset", "n"))).alias("places"))
    dealt = best.join(places, "key").withColumn("edits", _pieces(F.col("best.audit")))
    of_chunk = F.transform("places", lambda p: F.struct(p["chunk"].alias("chunk"), F.slice("edits", (p["offset"] + 1).cast("int"), p["n"]).alias("edits")))
    last = F.array(F.struct(F.lit((1 << 63) - 1).alias("chunk"), F.array(_tail(F.col("best.audit"))).alias("edits")))
    dealt = dealt.select("key", F.col("best.cost").alias("cost"), F.explode(F.concat(of_chunk, last)).alias("e")).select("key", "cost", "e.*")
    at_end = F.col("turns").isNull()
    rendered = dealt.join(shared, ["key", "chunk"], "left").select(
        "key", "chunk", "cost",
        F.when(at_end, F.translate(F.col("edits")[0], "J", "I")).otherwise(_shown(F.col("edits"), F.col("turns"))).alias("audit"),
        F.when(at_end, _said_last(F.col("edits")[0])).otherwise(_said(F.col("edits"), F.col("turns"))).alias("said"),
    )
    rendered = materialise(rendered, "long-repairs")
    whole = rendered.groupBy("key").agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    repaired = short.select("key", "cost", "audit").unionByName(whole)
    summary = counts.join(repaired, "key").withColumn("cost", F.col("cost") + F.col("extra")).drop("extra")
    turns = short.select("key", "chunk", F.lit(True).alias("whole"), "said").unionByName(rendered.select("key", "chunk", F.lit(False).alias("whole"), "said"))
    return Repaired(summary, turns)


def digests(turns: DataFrame) -> DataFrame:
    """key and repaired_sha256 of each conversation of Repaired.turns: the hex digest of its "role:text" lines. Conversations in several rows stream
    through a running hash in order, so their length needs no memory; one task reads those of one conversation, as its one hash asks for."""
    text = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    lines = turns.select("key", "chunk", "whole", text.alias("lines"), F.size("said").alias("n"))
    streamed = lines.where(~F.col("whole")).repartition("key").sortWithinPartitions("key", "chunk").select("key", "lines", "n")

    def run(batches):
        now, digest, begun, done = None, None, False, []
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], names=["key", "repaired_sha256"])
        for batch in batches:
            for key, lines, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest, begun = key, hashlib.sha256(), False
                if n:
                    digest.update(("\n" + lines if begun else lines).encode())
                    begun = True
            if len(done) >= 1000:
                yield emit()
                done.clear()
        if now is not None:
            done.append((now, digest.hexdigest()))
        if done:
            yield emit()

    whole = lines.where("whole").select("key", F.sha2(F.col("lines").cast("binary"), 256).alias("repaired_sha256"))
    return whole.unionByName(streamed.mapInArrow(run, "key string, repaired_sha256 string"))


def damage(rows: DataFrame) -> DataFrame:
    """Faults set into conversations for tests and measurements, as a hash of id and turn decides: one row in twenty each is dropped, emptied,
    left without . ! ?, said twice (copies: 2), or given the role of user. Null roles and texts are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    kept = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return kept.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
