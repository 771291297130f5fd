"""Chat formatting: nested-path fingerprints select a declarative mapping to canonical turns, which one template renders."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns.

    needs: field paths at which a record must hold a value of any shape, [] marking the items of a list. turns: path of the list of
    turns, with the names of its role and text fields; or fixed: (role, paths) pairs, of which the texts are
    joined by a line break and empty ones left out; or a row that is itself one turn, when both are empty.
    """

    name: str
    needs: frozenset[str]
    turns: str = ""
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("messages", frozenset({"messages[].role", "messages[].content"}), turns="messages"),
    Layout("conversations", frozenset({"conversations[].from", "conversations[].value"}), turns="conversations", role="from", text="value"),
    Layout("turns", frozenset({"turns[].role", "turns[].text"}), turns="turns", text="text"),
    Layout("instruction", frozenset({"instruction", "output"}), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt_response", frozenset({"prompt", "response"}), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", frozenset({"prompt", "completion"}), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", frozenset({"question", "answer"}), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("turn_row", frozenset({"role", "text"}), text="text"),
)
#: Other names of the three roles in the layouts that have turn lists.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value) -> set[str]:
    """Paths of all leaves of a parsed JSON value; list items share one path. The walk keeps its own stack, however deep the value."""
    out, todo = set(), [("", value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}.{k}" if at else k, x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            todo += [(f"{at}[]", x) for x in v]
        else:
            out.add(f"{at}[]" if isinstance(v, list) else at)
    return out


def holds(paths: set[str], need: str) -> bool:
    """Whether a record with these leaves holds a value of any shape at the path."""
    return any(p == need or p.startswith((f"{need}.", f"{need}[]")) for p in paths)


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode(errors="surrogatepass")).hexdigest()[:16]


def whole_characters(text: str) -> str:
    """The text with every lone surrogate, which is no character and has no UTF-8 form, replaced by U+FFFD."""
    return text if text.isascii() else re.sub("[\ud800-\udfff]", "\ufffd", text)


def content_text(value) -> str:
    """The text of a message's content: a string itself, null the empty text, a list the texts of its parts in order, joined by line breaks. A part is a string
    or an object with a string "text"; any other value stays as its JSON text, so nothing that a record says is lost."""
    if isinstance(value, list):
        return "\n".join(content_text(v["text"] if isinstance(v, dict) and isinstance(v.get("text"), str) else v) for v in value)
    return whole_characters(value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False))


class Canonicaliser:
    """Turns of records of any known layout; the choice of layout is made once for each fingerprint."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.layouts, self.chosen = layouts, {}

    def layout(self, record: dict) -> tuple[str, Layout | None]:
        paths = field_paths(record)
        key = fingerprint(paths)
        if key not in self.chosen:
            fit = [x for x in self.layouts if all(holds(paths, need) for need in x.needs)]
            self.chosen[key] = max(fit, key=lambda x: len(x.needs), default=None)
        return key, self.chosen[key]

    def turns(self, record: dict) -> tuple[str, str, list[tuple[str, str]]]:
        """(fingerprint, layout name, [(role, text)]); an unknown layout is named 'unknown' and has no turns."""
        key, layout = self.layout(record)
        text = content_text
        if layout is None:
            return key, "unknown", []
        if layout.turns:
            rows = [x for x in record.get(layout.turns) or [] if isinstance(x, dict)]
            return key, layout.name, [(ROLES.get(r := text(x.get(layout.role)), r), text(x.get(layout.text))) for x in rows]
        if layout.fixed:
            said = [(role, "\n".join(s for p in paths if (s := text(record.get(p))))) for role, paths in layout.fixed]
            return key, layout.name, [(role, s) for role, s in said if s or role != "system"]
        return key, layout.name, [(text(record.get(layout.role)), text(record.get(layout.text)))]


def escape(text: str) -> str:
    """Puts one backslash more between '<' and '|', so no control string is left; unescape() takes it away."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    """One turn of the template and the span under the loss mask, in code points: an assistant's text."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (None, None)
    return f"{head}{body}{END}\n", *span


TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of formatted text, exactly as they went in; raises ValueError on anything else."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


PIECE = "conv_id string, turn long, part int, fingerprint string, layout string, piece string, loss_start int, loss_end int, unformatted string"


def format_records(records: DataFrame, id_col: str, record_col: str, turn_col: str | None = None) -> DataFrame:
    """One formatted piece per turn of JSON records of mixed layouts.

    Returns conv_id, turn (turn_col, or 0), part (place of the turn in its record), fingerprint, layout, piece, the span of the piece under the loss mask, and
    unformatted: the whole record where it gives no piece. The content of a message may be a list of parts, each message's in its own way. Pieces of a conversation in the order of (turn, part, piece)
    make up its formatted text. Null or unparsable records, those nested deeper than the parser goes (some thousand levels), and unknown
    layouts give one row with a null piece; null texts are empty; null roles are the empty role; escapes of lone
    surrogates become U+FFFD. Texts of any length are formatted whole; repeated rows give repeated pieces; ids are returned as text, null ids too;
    other columns are not read; an empty table gives an empty result.
    """
    turn = F.col(turn_col).cast("long") if turn_col else F.lit(0).cast("long")
    rows = records.select(F.col(id_col).cast("string").alias("conv_id"), turn.alias("turn"), F.col(record_col).cast("string").alias("record"))

    def run(batches):
        canonical = Canonicaliser()
        for batch in batches:
            out = {k.split()[0]: [] for k in PIECE.split(", ")}
            for conv, turn, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    record = json.loads(raw) if raw is not None else None
                    key, name, turns = canonical.turns(record) if isinstance(record, dict) else (None, "unknown", [])
                except (ValueError, RecursionError):
                    key, name, turns = None, "unknown", []
                for part, (role, text) in enumerate(turns):
                    for k, v in zip(out, (conv, turn, part, key, name, *render(role, text), None), strict=True):
                        out[k].append(v)
                if not turns:
                    for k, v in zip(out, (conv, turn, 0, key, name, None, None, None, raw), strict=True):
                        out[k].append(v)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return rows.mapInArrow(run, PIECE)


DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its formatted pieces.

    Rows stream through in order and each conversation holds two running hashes, so its length needs no memory. One task reads a
    conversation's pieces, as its one hash asks for. Null pieces count as no turn; pieces that repeat, or whose order (turn, part) ties, follow
    each other by their text; rows with a null conv_id are one conversation; an empty table gives an empty result.
    """
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "piece").select("conv_id", "piece", "loss_start", "loss_end")

    def run(batches):
        now, row = object(), None
        done: list[tuple] = []
        close = lambda r: (r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5])
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [k.split()[0] for k in DIGEST.split(", ")]
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for conv, piece, begin, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if row is None or conv != now:
                    if row is not None:
                        done.append(close(row))
                    now, row = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if piece is None:
                    continue
                for role, text in parse(piece):
                    row[1] += 1
                    row[2].update(f"{role}\n{text}\n".encode())
                row[5] += len(piece)
                if begin is not None:
                    said = unescape(piece[begin:end])
                    row[3] += len(said)
                    row[4].update(said.encode())
            if len(done) >= 1000:
                yield emit()
                done.clear()
        if row is not None:
            done.append(close(row))
        if done:
            yield emit()

    return ordered.mapInArrow(run, DIGEST)
