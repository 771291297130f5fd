"""Token counts: byte-pair merging with a heap over a linked list; no identifiers of tokens are made.

A text is split where the byte-level pattern splits it, by classes of its code points, in whole Arrow slices at once. Each different piece is
merged once per worker: its bytes are the first symbols, adjacent pairs lie in a heap by rank and place, and the lowest is popped until none is
left. A piece has as many tokens as it has bytes, less the merges made.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._common import as_strings, text_slices

#: A vocabulary file above this size is refused, since it is broadcast.
VOCABULARY_BYTES = 64 << 20
#: Pieces whose counts a worker remembers; longer ones than PIECE bytes are counted anew each time.
MEMO, PIECE = 1_000_000, 64
#: Texts are cut into segments of about so many characters, where the pattern splits them anyway.
SEGMENT = 1 << 20

#: What stands behind the last symbol of a piece: in no pair of the ranks, which have fewer than 2^20 symbols.
END = -2

SPACE, LETTER, NUMBER, OTHER = range(4)
#: White space of Unicode.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16 added, which Python's tables may lack; the library of the vocabulary knows them.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    of = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            found[first : last + 1] = kind
    found[list(WHITE_SPACE)] = SPACE
    return found


def piece_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which code points start a piece. begins: the first code point of each segment, ascending; segments don't see each other.

    Pieces are runs of letters, of numbers or of other characters, each with one space before it if there is one, and runs of white
    space; a run of white space before something else leaves its last character apart. An apostrophe that starts a piece takes the ending
    of an English contraction with it.
    """
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[begins] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:] & ~first[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    at = np.flatnonzero(start & (points == ord("'")))
    at = at[~first[at + 1]]
    one = at[np.isin(points[at + 1], [ord(c) for c in "stmd"])]
    two = at[~first[np.minimum(at + 2, n)]]
    pair = points[two + 1].astype(np.int64) << 32 | points[two + 2]
    two = two[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    for found, length in ((one, 2), (two, 3)):
        start[found + 1] = False
        end = found + length
        start[end[end < n]] = True
    return start


class Merger:
    """Token counts of pieces under the ranked merges of a byte-level vocabulary file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
        if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer") or any((model.get(k) or None) != (v or None) for k, v in plain.items()):
            raise ValueError("only plain byte-level BPE files without a normaliser are counted")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in white space aren't counted")
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        self.symbols = [number(c) for c in byte_characters()]
        if any(c not in model["vocab"] for c in byte_characters()):
            raise ValueError("the vocabulary lacks bytes")
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[number(left) << 20 | number(right)] = rank
            self.merged.append(number(left + right))
        self.specials = [t["content"] for t in added]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if added else None
        self.memo: dict[bytes, int] = {}

    def count(self, piece: bytes) -> int:
        """Tokens of one piece. Heap entries are rank and place in one number; an entry is stale if the pair at its place has another rank by
        now, as it has once one of its symbols is gone (-1) or where the piece ends (END)."""
        n, rank_of, merged = len(piece), self.ranks.get, self.merged
        symbols = [self.symbols[b] for b in piece]
        symbols.append(END)
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        left, right, merges = list(range(-1, n)), list(range(1, n + 2)), 0
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j, symbol = right[i], symbols[i]
            if rank_of(symbol << 20 | symbols[j]) != entry >> 32:
                continue
            merges += 1
            symbols[i] = symbol = merged[entry >> 32]
            symbols[j] = -1
            k = right[i] = right[j]
            left[k] = i
            if (r := rank_of(symbol << 20 | symbols[k])) is not None:
                heappush(heap, r << 32 | i)
            h = left[i]
            if h >= 0 and (r := rank_of(symbols[h] << 20 | symbol)) is not None:
                heappush(heap, r << 32 | h)
        return n - merges

    def counts(self, pieces: np.ndarray) -> np.ndarray:
        memo, found = self.memo, np.empty(len(pieces), dtype=np.int64)
        for k, piece in enumerate(pieces):
            n = memo.get(piece)
            if n is None:
                n = self.count(piece)
                if len(piece) <= PIECE:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = n
            found[k] = n
        return found


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level files: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


@lru_cache(2)
def merger(raw: bytes) -> Merger:
    return Merger(raw)


CUT = re.compile(r"(?<=[^\s])[ \t\n]")


def segments(text: str, special: re.Pattern | None) -> tuple[list[str], int]:
    """What lies between the added tokens of a text, cut further before white space about every SEGMENT characters, and how many added tokens."""
    parts = special.split(text) if special else [text]
    found = []
    for part in parts:
        at = 0
        while len(part) - at > SEGMENT and (m := CUT.search(part, at + SEGMENT)):
            found.append(part[at : m.start()])
            at = m.start()
        found.append(part[at:])
    return found, len(parts) - 1


def slice_counts(texts: pa.Array, vocabulary: Merger) -> np.ndarray:
    """Tokens of each text of a large_string array without nulls."""
    odd = pc.greater(pc.binary_length(texts), SEGMENT)
    for s in vocabulary.specials:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    total = np.zeros(len(texts), dtype=np.int64)
    plain = ~odd.to_numpy(zero_copy_only=False)
    _add(total, np.flatnonzero(plain), texts.filter(pa.array(plain)), vocabulary)
    for i in np.flatnonzero(~plain):
        parts, added = segments(texts[i].as_py(), vocabulary.special)
        total[i] += added
        for k in range(0, len(parts), 1024):
            some = parts[k : k + 1024]
            for _, few in text_slices(pa.array(some, pa.large_string()), 4 * SEGMENT):
                _add(total, np.full(len(few), i), few, vocabulary)
    return total


def _add(total: np.ndarray, owner: np.ndarray, texts: pa.Array, vocabulary: Merger) -> None:
    """Add the tokens of texts to their owners' totals."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return
    points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), dtype=np.uint32)
    place = np.flatnonzero(raw & 0xC0 != 0x80)
    full = np.flatnonzero(np.diff(offsets))
    starts = place[piece_starts(points, np.searchsorted(place, offsets[full]))]
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(data)])
    coded = pc.dictionary_encode(pieces)
    counts = vocabulary.counts(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
    of = full[np.searchsorted(offsets[full], starts, side="right") - 1]
    total += np.bincount(owner[of], weights=counts, minlength=len(total)).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every text, one row per input row: doc_id, n_bytes, n_tokens, over_limit (more tokens than limit).

    vocabulary is the path of a byte-level BPE file (JSON) on the driver; its content is broadcast, VOCABULARY_BYTES at most. Counts are those of
    its library without begin, end or padding: added tokens found inside a text are one token each. Null texts are empty and have no
    token; texts of any length are counted whole, in segments that end where the pattern ends a piece. Null and repeated ids and repeated rows go
    through; other columns are not read and can't clash; an empty table gives an empty result.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has more than {VOCABULARY_BYTES} bytes")
    Merger(raw)
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens"))])

    def run(batches):
        tokens = merger(shared.value)
        for batch in batches:
            for at, texts in text_slices(as_strings(batch.column(1))):
                n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), n_bytes, pa.array(slice_counts(texts, tokens))], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, counts).withColumn("over_limit", F.col("n_tokens") > limit)
