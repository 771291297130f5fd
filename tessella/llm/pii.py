"""Personal data: base patterns, and candidate spans judged by gradient-boosted trees on format and context.

The trees learn from all candidates of the corpus itself that base patterns, checksums and telling words nearby label, by sums over
them, and from made-up candidates of all kinds, since a corpus may lack some.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import drop_table, materialise

#: Kinds in the order in which spans are listed; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "national_id", "iban")
BASE = KINDS[:4]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base patterns, leftmost and non-overlapping per kind, in code points, end exclusive.

    Linear in the text: e-mails are found from their '@' back and forth, dotted numbers from whole chains.
    """
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out["email"].append((begin, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                quad = parts[k : k + 4]
                end = at + sum(map(len, quad)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in quad):
                    out["ip"].append((at, end))
                at = end + 1
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


#: What a generator's spans hold; texts without it are not searched by that generator.
DIGIT, COLON, COLONS = re.compile("[0-9]"), re.compile(":"), re.compile("::")
#: Spelled-out e-mail addresses, of any length, and the signs that stand for '@' in them.
SPELLED = re.compile(r"[A-Za-z0-9._%+-]++\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]++(?:(?:\s?(?:\(dot\)|\[dot\])\s?|\sdot\s|\.)[A-Za-z]{2,}+)+")
AT = re.compile(r"\(at\)|\[at\]|\sat\s")
#: Generators of further candidates beyond the base patterns: high recall, precision is left to the trees.
GENERATORS = (
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), COLON),
    ("ip", re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|:(?::[0-9A-Fa-f]{1,4}){1,7})(?![0-9A-Za-z:])"), COLONS),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[ .-]?[0-9]{4}){3}|3[0-9]{3}[ .-]?[0-9]{6}[ .-]?[0-9]{5})(?![0-9])"), DIGIT),
    ("phone", re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"), DIGIT),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{20,128}(?![A-Za-z0-9])"), DIGIT),
    # whole runs that the one before leaves out, of any length and with digits anywhere; tried once a run
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])(?:(?=[A-Za-z_-]{41,}+[0-9])[A-Za-z0-9_-]++|(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{129,}+)"), DIGIT),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), DIGIT),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), DIGIT),
)
#: Words near a span that speak for a kind, and words that speak against personal data.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address", "login"), "card": ("card", "visa", "mastercard", "credit", "payment"), "phone": ("phone", "tel", "call", "fax", "mobile", "whatsapp"),
    "secret": ("token", "key", "secret", "password", "passwd", "bearer", "auth"), "national_id": ("ssn", "social security", "national id", "tax id"), "iban": ("iban", "account", "bank", "transfer"),
}
AGAINST = ("order", "invoice", "isbn", "version", "serial", "part no", "sha", "commit", "hash", "checksum", "figure", "page", "doi", "uuid", "date", "item")
NEAR = 32
DOMAIN_ENDS = frozenset({"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu"})


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(kind: str, text: str, begin: int, end: int) -> list[float]:
    span = text[begin:end]
    before, after = text[max(0, begin - NEAR) : begin].lower(), text[end : end + NEAR].lower()
    digits = [c for c in span if c.isdigit()]
    freq = [span.count(c) / len(span) for c in set(span)]
    return [
        *(float(kind == k) for k in KINDS),
        len(span),
        len(digits),
        len(digits) / len(span),
        len(re.findall("[0-9]+", span)),
        sum(c in " .-()" for c in span),
        -sum(f * math.log2(f) for f in freq),
        float(bool(before[-1:]) and before[-1].isalnum()),
        float(bool(after[:1]) and after[0].isalnum()),
        float(before[-1:] in ("=", ":", '"', "'") or before[-2:] in ("= ", ": ")),
        float(any(w in before for w in CONTEXT[kind])),
        float(any(w in after for w in CONTEXT[kind])),
        float(any(w in before for w in AGAINST)),
        float(13 <= len(digits) <= 19 and luhn("".join(digits))),
        float(kind == "iban" and iban_valid(span)),
        len(set(digits)),
        float("." in before[-1:] or "." in after[:1] and after[1:2].isdigit()),
        float(bool(re.search(r"[\[(]|\bdot\b", span))),
        float(span.rpartition(".")[2].rpartition(" ")[2].lower() in DOMAIN_ENDS),
    ]


#: Fixed cut points of each feature, in the order of features(): trees split there only, so gradients are summed by the cells between them.
HALVES = np.arange(64) + 0.5
LENGTHS = np.append(HALVES, np.array([72, 80, 96, 112, 128, 160, 192, 256, 512, 1024, 4096]) + 0.5)
CUTS = [*[HALVES[:1]] * len(KINDS), LENGTHS, LENGTHS, np.arange(64) / 64, HALVES[:32], HALVES[:32], np.arange(192) / 32 + 0.01, *[HALVES[:1]] * 8, HALVES[:10], *[HALVES[:1]] * 3]
#: First cell of each feature, and the number of cells; a feature has one cell more than cut points.
FIRST = np.concatenate([[0], np.cumsum([len(c) + 1 for c in CUTS])])
CELLS = int(FIRST[-1])
#: Gradients are summed in whole 2^-20ths and leaves are whole 2^-10ths, so that no sum depends on the order of its terms.
UNIT, STEP = 1 << 20, 1 << 10


def to_codes(x: np.ndarray) -> np.ndarray:
    """The cell of each feature, as bytes: how many cut points lie below it."""
    return np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(CUTS)]).astype(np.uint8)


def from_codes(codes: np.ndarray) -> np.ndarray:
    """Features with these codes: each is the upper end of its cell, which every tree sends the same way as the rest of the cell."""
    return np.column_stack([np.append(c, np.inf)[codes[:, j]] for j, c in enumerate(CUTS)])


@dataclass
class BoostedTrees:
    """Gradient-boosted trees of fixed depth for the logistic loss, with Platt-calibrated probabilities.

    Trees are stored as heap arrays: node i has children 2i+1 and 2i+2. Leaves are whole multiples of 1/STEP, one at most.
    """

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    platt: tuple[float, float] = (1.0, 0.0)

    def fit(self, sums: Callable[[BoostedTrees, tuple, int], np.ndarray]) -> BoostedTrees:
        """sums(model, tree, level) gives what sums_by_cell() gives, over all rows."""
        size = 2 ** (self.depth + 1) - 1
        for _ in range(self.rounds):
            tree = np.full(size, -1), np.zeros(size), np.zeros(size)
            for level in range(self.depth):
                for k, cells in enumerate(sums(self, tree, level)):
                    self._split(tree, 2**level - 1 + k, cells)
            self.trees.append(tree)
        return self

    def _leaf(self, g, h):
        return np.rint(np.clip(self.rate * g / (h + 1.0), -1, 1) * STEP) / STEP

    def _split(self, tree, node: int, cells: np.ndarray) -> None:
        feat, cut, value = tree
        n, g, h = cells[: FIRST[1]].sum(axis=0) / (1, UNIT, UNIT)
        value[node] = self._leaf(g, h)
        if n < 20:
            return
        best, place = 1e-6, None
        for j, cuts in enumerate(CUTS):
            left = np.cumsum(cells[FIRST[j] : FIRST[j + 1] - 1], axis=0)
            (nl, gl, hl), held = (left / (1, UNIT, UNIT)).T, g * g / (h + 1)
            score = np.where((nl > 0) & (nl < n), gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - held, 0)
            k = int(np.argmax(score))
            if score[k] > best:
                best, place = score[k], (j, cuts[k], self._leaf(gl[k], hl[k]), self._leaf(g - gl[k], h - hl[k]))
        if place:
            feat[node], cut[node], value[2 * node + 1], value[2 * node + 2] = place

    def node(self, tree, x: np.ndarray) -> np.ndarray:
        """The node without a split that each row comes to."""
        feat, cut, _ = tree
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            split = feat[node] >= 0
            right = x[np.arange(len(x)), np.maximum(feat[node], 0)] > cut[node]
            node = np.where(split, 2 * node + 1 + right, node)
        return node

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((t[2][self.node(t, x)] for t in self.trees), np.zeros(len(x)))

    def calibrate(self, raw: np.ndarray, n: np.ndarray, positive: np.ndarray) -> BoostedTrees:
        """Fits Platt's two numbers to raw scores of n rows each, positive of them with label 1."""
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * raw + b)))
            w, miss = n * (p * (1 - p) + 1e-9), positive - n * p
            hess = np.array([[np.sum(w * raw * raw) + 1e-3, np.sum(w * raw)], [np.sum(w * raw), np.sum(w) + 1e-3]])
            step = np.linalg.solve(hess, [np.sum(miss * raw) - 1e-3 * (a - 1), np.sum(miss) - 1e-3 * b])
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.platt = (float(a), float(b))
        return self

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.platt[0] * raw + self.platt[1], -500, 500)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.raw(x))


def sums_by_cell(model: BoostedTrees, tree: tuple, level: int, codes: np.ndarray, n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Whole numbers per node of a level of the tree that grows, cell and: rows, gradient, second derivative (both in 1/UNIT). A row
    stands for n candidates with the same codes, positive of them with label 1."""
    x = from_codes(codes)
    p = 1 / (1 + np.exp(-model.raw(x)))
    up, down, h = np.rint(UNIT * (1 - p)), np.rint(UNIT * p), np.rint(UNIT * p * (1 - p))
    node = model.node(tree, x) - (2**level - 1)
    here, width = node >= 0, 2**level * CELLS
    at = (node[:, None] * CELLS + FIRST[:-1] + codes)[here].ravel()
    each = [np.repeat(v[here], len(CUTS)) for v in (n, positive * up - (n - positive) * down, n * h)]
    return np.stack([np.bincount(at, v, width) for v in each], axis=1).reshape(2**level, CELLS, 3).astype(np.int64)


def training_set(n: int = 6000, seed: int = 11, compressed: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """n labelled candidates made from rules: personal data in its usual forms and contexts, and look-alikes of it; with compressed,
    IPv6 addresses with a "::" and look-alikes of those only."""
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda a=3, b=9: "".join(pick("abcdefghilmnoprstu") for _ in range(int(rng.integers(a, b))))
    hexa = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))

    def card_number():
        body = num(15)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def iban():
        body = num(18)
        check = 98 - int(body + "131400") % 97
        return f"DE{check:02d}{body}"

    def positive(kind):
        sep = pick(" .-")
        return {
            "email": lambda: f"{word()}.{word()} {pick(['(at)', '[at]', 'at'])} {word()}{pick([' (dot) ', ' [dot] ', ' dot ', '.'])}{pick(['com', 'org', 'net', 'de'])}",
            "ip": lambda: ":".join(hexa(4) for _ in range(8)),
            "card": lambda: (lambda c: sep.join(c[i : i + 4] for i in range(0, 16, 4)))(card_number()),
            "phone": lambda: pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0049 {num(3)} {num(3)} {num(4)}"]),
            "secret": lambda: pick([hexa(32), hexa(40), f"sk_{hexa(36)}", f"ghp_{hexa(36)}"]),
            "national_id": lambda: f"{num(3)}-{num(2)}-{num(4)}",
            "iban": iban,
        }[kind]()

    def negative(kind):
        sep = pick(" .-")
        return {
            "email": lambda: f"{word()} at {word()}.{pick(['The', 'And', 'It', word(2, 5), 'to'])}",
            "ip": lambda: ":".join(num(2) for _ in range(5)),
            "card": lambda: sep.join(num(4) for _ in range(4)),
            "phone": lambda: pick([f"{num(4)}-{num(3)}-{num(3)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(3)} {num(3)} {num(3)}"]),
            "secret": lambda: pick([hexa(32), hexa(40), num(24), f"{word(5, 9)}-{word(5, 9)}-{num(4)}-{word(5, 9)}"]),
            "national_id": lambda: f"{num(3)}-{num(2)}-{num(4)}",
            "iban": lambda: f"{pick(['AB', 'XK', 'PN'])}{num(2)} {num(4)} {num(4)} {num(4)}",
        }[kind]()

    def short_ip(label):
        groups = lambda a, b: ":".join(hexa(int(rng.integers(1, 5))) for _ in range(int(rng.integers(a, b))))
        if label:
            return pick([f"2001:db8:{groups(1, 3)}::{groups(0, 4)}", f"2001:db8::{groups(0, 4)}", f"fe80::{groups(1, 5)}", f"{hexa(4)}:{groups(1, 4)}::{groups(0, 3)}", f"{hexa(4)}::{groups(1, 3)}"])
        name = lambda: "".join(pick("abcdef") for _ in range(int(rng.integers(1, 5))))
        return pick([f"{name()}::{name()}", f"{num(2)}::{num(2)}", f"::{name()}", f"{name()}::", f"{num(1)}::{num(1)}"])

    xs, ys, kinds = [], [], []
    for i in range(n):
        kind, label = "ip" if compressed else KINDS[i % len(KINDS)], int(rng.random() < 0.5)
        span = short_ip(label) if compressed else positive(kind) if label else negative(kind)
        near = label and kind in ("secret", "national_id") or label and rng.random() < 0.7
        if near:
            lead = f"{word()} {word()} {pick(CONTEXT[kind])}{pick([' = ', ': ', ' ', '=', ' is '])}" + pick(["", '"'])
        elif not label and rng.random() < 0.6:
            lead = f"{word()} {word()} {pick(AGAINST)}{pick([' ', ': ', ' no. '])}"
        else:
            lead = f"{word()} {word()} {word()} "
        text = f"{lead}{span}{pick([' ', '. ', chr(34), ', '])}{word()} {word()}"
        xs.append(features(kind, text, len(lead), len(lead) + len(span)))
        ys.append(label)
        kinds.append(kind)
    return np.array(xs), np.array(ys, dtype=float), kinds


#: A made-up candidate counts once more for each so many labelled ones of its kind in the corpus, so that a large corpus, whose labels are
#: one-sided for some kinds, does not drown them.
MADE_UP_PER = 2000
#: Rows of different candidates (50 bytes each) that a task takes in a sum.
TASK_ROWS = 100_000


def weak_label(kind: str, text: str, begin: int, end: int, base: dict) -> int | None:
    """1 or 0 where something other than the trees can tell: a base span of that kind, a checksum, a word nearby that speaks for
    the kind or against personal data. None where nothing does, and those candidates teach nothing."""
    span, before = text[begin:end], text[max(0, begin - NEAR) : begin].lower()
    if any(b < end and begin < e for b, e in base.get(kind, ())):
        return 1
    if kind == "card":
        return int(luhn(re.sub("[^0-9]", "", span)))
    if kind == "iban":
        return int(iban_valid(span))
    if kind == "ip":
        try:
            ipaddress.IPv6Address(span)
        except ValueError:
            return 0
        return None
    if kind == "email" and re.search(r"[\[(]", span):
        return int(span.rpartition(".")[2].rpartition(" ")[2].lower() in DOMAIN_ENDS)
    speaks, against = (any(w in before for w in words) for words in (CONTEXT[kind], AGAINST))
    return int(speaks) if speaks != against else None


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per labelled candidate of all whole texts: codes of its features (x), label (y), and whether it only calibrates (held): a
    quarter of the texts, by their hash, so that copies stay together."""
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("text"), (F.pmod(F.xxhash64(text), F.lit(4)) == 0).alias("held")).where("text is not null")

    def run(batches):
        for batch in batches:
            x, y, held = [], [], []
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ANY.search(text) and (found := candidates(text)):
                    base = base_spans(text)
                    for kind, b, e in found:
                        if (label := weak_label(kind, text, b, e, base)) is not None:
                            x.append(features(kind, text, b, e))
                            y.append(label)
                            held.append(h)
            codes = [c.tobytes() for c in to_codes(np.array(x))] if x else []
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in ((codes, pa.binary()), (y, pa.int32()), (held, pa.bool_()))], names=["x", "y", "held"])

    return rows.mapInArrow(run, "x binary, y int, held boolean")


def corpus_candidates(docs: DataFrame, text_col: str = "text", per_kind: int = 2000) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features (as from_codes() has them), labels and kinds of labelled candidates, to look at: per_kind of a kind, those with the smallest
    hash. Nothing is learned from them; fit() takes all."""
    table = materialise(labelled(docs, text_col).select("x", "y"), "candidates")
    parts = [table.where(F.substring("x", k + 1, 1) == F.lit(b"\x01")).orderBy(F.xxhash64("x", "y"), "x", "y").limit(per_kind) for k in range(len(KINDS))]
    got = [(kind, r) for kind, part in zip(KINDS, parts, strict=True) for r in part.collect()]
    drop_table(table)
    codes = np.frombuffer(b"".join(r["x"] for _, r in got), dtype=np.uint8).reshape(len(got), len(CUTS))
    return from_codes(codes), np.array([r["y"] for _, r in got], dtype=float), [kind for kind, _ in got]


class Candidates:
    """All labelled candidates of a corpus, equal ones counted together in a written table, and made-up ones; sums over both."""

    def __init__(self, docs: DataFrame | None, text_col: str):
        x, y, kinds = made_up()
        self.table, found = None, {}
        if docs is not None:
            groups = labelled(docs, text_col).groupBy("x", "held").agg(F.count("*").alias("n"), F.sum("y").alias("positive"))
            written = materialise(groups, "candidate-groups")
            per_kind = written.groupBy(F.substring("x", 1, len(KINDS)).alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
            found = {KINDS[bytes(r["kind"]).index(1)]: r["n"] for r in per_kind}
            # read by each of many jobs, so dealt by its size, not by the number of shuffle partitions
            self.table = materialise(written.coalesce(1 + sum(r["rows"] for r in per_kind) // TASK_ROWS), "candidates")
            drop_table(written)
        self.found = found
        n = np.array([1 + found.get(k, 0) // MADE_UP_PER for k in kinds], dtype=np.int64)
        held = np.random.default_rng(3).random(len(y)) < 0.25
        own = to_codes(x), n, n * y.astype(np.int64)
        self.taught, self.held = [v[~held] for v in own], [v[held] for v in own]

    def sums(self, model: BoostedTrees, tree: tuple, level: int) -> np.ndarray:
        """sums_by_cell() over all rows that are not held back."""
        total = sums_by_cell(model, tree, level, *self.taught)
        if not self.found:
            return total
        shape = total.shape

        def run(batches):
            part = np.zeros(shape, dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    part += sums_by_cell(model, tree, level, *_columns(batch))
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], names=["sums"])

        parts = self.table.where("not held").select("x", "n", "positive").mapInArrow(run, "sums binary").rdd
        return total + parts.map(lambda row: np.frombuffer(row[0], dtype=np.int64)).treeReduce(np.add).reshape(shape)

    def scores(self, model: BoostedTrees) -> np.ndarray:
        """Kind, raw score in 1/STEP, rows and positive rows, of those held back: as many rows as there are scores, whatever the data."""

        def score(codes, n, positive):
            return codes[:, : len(KINDS)].argmax(axis=1), np.rint(model.raw(from_codes(codes)) * STEP).astype(np.int64), n, positive

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in score(*_columns(batch))], names=["kind", "raw", "n", "positive"])

        got = np.column_stack(score(*self.held))
        if self.found:
            rows = self.table.where("held").select("x", "n", "positive").mapInArrow(run, "kind long, raw long, n long, positive long")
            more = rows.groupBy("kind", "raw").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).toPandas()
            got = np.concatenate([got, more.to_numpy(dtype=np.int64).reshape(-1, 4)])
        keys, group = np.unique(got[:, :2], axis=0, return_inverse=True)
        counts = np.zeros((len(keys), 2), dtype=np.int64)
        np.add.at(counts, group.ravel(), got[:, 2:])
        return np.concatenate([keys, counts], axis=1)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, len(CUTS))
    return codes, *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])


def fit(docs: DataFrame | None = None, text_col: str = "text", precision: float = 0.97) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees, and per kind a threshold: of the probabilities from which at least that share of calibration rows are positive, the one
    with the best F1 on them, moved half way (in log odds) to the next probability below.

    Every labelled candidate of the corpus (docs) counts, however many they are: a job per level of a tree sums gradients by cell over
    their table, and only those sums and counts by score come to the driver. One text in four, and one made-up candidate in four,
    calibrates and is not trained on. An empty or missing corpus leaves the made-up candidates.
    """
    own = Candidates(docs, text_col)
    try:
        model = BoostedTrees().fit(own.sums)
        kinds, raw, n, positive = own.scores(model).T
    finally:
        if own.table is not None:
            drop_table(own.table)
    raw = raw / STEP
    p = model.calibrate(raw, n, positive).calibrated(raw)
    thresholds = {}
    for j, kind in enumerate(KINDS):
        order = np.flatnonzero(kinds == j)
        order = order[np.argsort(-p[order], kind="stable")]
        good, taken = np.cumsum(positive[order]), np.cumsum(n[order])
        f1 = np.where(good >= precision * taken, 2 * good / (taken + good[-1:]), 0)
        ranked = np.append(p[order], 0.0).clip(1e-9, 1 - 1e-9)
        k = int(np.argmax(f1)) if f1.any() else None
        thresholds[kind] = 1.1 if k is None else float(1 / (1 + np.sqrt((1 / ranked[k] - 1) * (1 / ranked[k + 1] - 1))))
    return model, thresholds


@functools.cache
def made_up() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(parts) for parts in zip(training_set(), training_set(900, 12, compressed=True), strict=True))


def spelled_emails(text: str) -> list[tuple[int, int]]:
    """Spans of SPELLED, leftmost and non-overlapping, found from the signs for '@' back and forth, so other text costs nothing."""
    out, free = [], 0
    for m in AT.finditer(text):
        end = m.start() - (m.start() > free and text[m.start() - 1].isspace())
        begin = end
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < end and (found := SPELLED.match(text, begin)):
            out.append(found.span())
            free = found.end()
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans proposed by the generators."""
    holds = {p: bool(p.search(text)) for p in (DIGIT, COLON, COLONS)}
    return [("email", b, e) for b, e in spelled_emails(text)] + [(kind, *m.span()) for kind, pattern, part in GENERATORS if holds[part] for m in pattern.finditer(text)]


def all_spans(text: str, base: dict, judged: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and judged candidates that overlap none of them nor a likelier candidate; ordered by kind, then start."""
    taken = sorted((b, e) for spans in base.values() for b, e in spans)
    kept = [(k, b, e) for k, spans in base.items() for b, e in spans]
    for _, kind, b, e in sorted(judged, key=lambda c: (-c[0], c[2], -c[3], c[1])):
        if all(e <= x or b >= y for x, y in taken):
            taken.append((b, e))
            kept.append((kind, b, e))
    return sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


OUT = "n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_sha256 string, spans string, redacted string"
#: What every span of a base pattern or generator has: a digit, a sign for '@', two colons, or groups of letters as in an address.
ANY = re.compile(rf"[0-9@]|::|{AT.pattern}|(?:[A-Fa-f]{{1,4}}:){{4}}")


def find_pii(docs: DataFrame, model: tuple[BoostedTrees, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", redact: bool = True) -> DataFrame:
    """Personal data in every whole text, by a model of fit() (None: fitted on docs).

    Returns doc_id, base counts per kind, the number of all spans, base_sha256, spans (base spans and accepted candidates as
    kind:start:end in code points, end exclusive) and, if asked for, the text with each span replaced by its kind. Null
    text counts as empty and has no spans; repeated rows are read each on its own; ids may be of any type; other columns are not read; an
    empty table gives an empty result.
    """
    trees, thresholds = model or fit(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = {k: [] for k in BASE}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(1).to_pylist()
                found = [base_spans(t) if ANY.search(t) else none for t in texts]
                proposed = [(i, *c) for i, t in enumerate(texts) if ANY.search(t) for c in candidates(t)]
                judged: dict[int, list] = {}
                if proposed:
                    p = trees.probability(np.array([features(k, texts[i], b, e) for i, k, b, e in proposed]))
                    for (i, k, b, e), q in zip(proposed, p, strict=True):
                        if q >= thresholds[k]:
                            judged.setdefault(i, []).append((q, k, b, e))
                out: list[list] = [[] for _ in range(8)]
                for i, (text, base) in enumerate(zip(texts, found, strict=True)):
                    spans = all_spans(text, base, judged.get(i, []))
                    listed = ",".join(f"{k}:{b}:{e}" for k in BASE for b, e in base[k])
                    clean = None
                    if redact:
                        parts, last = [], 0
                        for k, b, e in sorted(spans, key=lambda s: (s[1], -s[2])):
                            if e > last:
                                parts.append(text[last : max(b, last)])
                                parts.append(f"[{k.upper()}]" if b >= last else "")
                                last = e
                        clean = "".join(parts) + text[last:]
                    values = [*(len(base[k]) for k in BASE), len(spans), hashlib.sha256(listed.encode()).hexdigest(), ",".join(f"{k}:{b}:{e}" for k, b, e in spans), clean]
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                kinds = [pa.int64()] * 5 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=["doc_id", *(c.split()[0] for c in OUT.split(", "))])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {OUT}")
