"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit verification.

Distances are edits of words. An item of n words matches a text if some stretch of it is within k = floor(rate * n)
edits. Windows are taken where they can match at all: cut an item into k + 1 blocks, and a stretch within k edits
has one block unharmed, so every match has a block of its item at the block's distance from the window's start. The number of keys
follows from the recall that is measured on edited items; where no number reaches the target, windows skip the keys and meet all items of
their size.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm._common import as_strings, materialise, mix64, split_words, text_slices, word_hashes

TRIM = ".,;:!?()[]{}<>\"'#$%&*|=+-_/\\~`"
#: Items and words of them that are broadcast at once; larger benchmarks are searched for in blocks.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
#: Random walks, sampled coordinates in a key, and most keys of a walk.
WALKS, COORDINATES, MAX_KEYS = 4, 2, 64
#: Coordinates are sampled from so many steps a word: a walk over n words takes about 2 n, and what comes after its end tells nothing.
SPAN = 1.8


def normal_words(texts: pa.Array):
    """Per slice: first row, offsets, and a 64-bit hash of each word without case and outer punctuation; bare punctuation is no word."""
    for at, part in text_slices(as_strings(texts)):
        offsets, codes, table = split_words(part, lower=False)
        norm = pc.utf8_trim(pc.utf8_lower(table), characters=TRIM)
        hashes, there = word_hashes(norm), np.asarray(pc.not_equal(norm, ""))[codes]
        kept = np.concatenate([[0], np.cumsum(there)])
        yield at, len(part), kept[offsets], hashes[codes[there]]


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, walk: int) -> np.ndarray:
    """Sampled coordinates of CGK embeddings: at each step the word under the pointer is emitted, and a random bit of (walk, step,
    word) moves the pointer on. Equal words after an edit come back into step by chance, so few edits leave most coordinates equal.

    One row per window words[start:end]; places are the steps to sample, per row; past a window's end zeros are emitted. Only sampled
    steps are kept, and a window is walked no further than its own last one, so memory and time don't follow the longest window.
    """
    out = np.zeros(places.shape, dtype=np.uint64)
    if not places.size or not len(words):
        return out
    order = np.argsort(-places.max(axis=1), kind="stable")
    last = places.max(axis=1)[order]
    at, ends, places = starts[order].copy(), ends[order], places[order]
    want = np.argsort(places, axis=None, kind="stable")
    cuts = np.searchsorted(places.ravel()[want], np.arange(int(last[0]) + 2))
    live_rows = np.searchsorted(-last, -np.arange(int(last[0]) + 1), side="right")
    for j, k in enumerate(live_rows.tolist()):
        live = at[:k] < ends[:k]
        now = np.where(live, words[np.minimum(at[:k], len(words) - 1)], np.uint64(0))
        row, column = np.divmod(want[cuts[j] : cuts[j + 1]], places.shape[1])
        out[order[row], column] = now[row]
        at[:k] += live & ((mix64(now + np.uint64(0x9E3779B97F4A7C15 * (walk * 4096 + j + 1) % 2**64)) >> np.uint64(40)) & np.uint64(1)).astype(bool)
    return out


def lsh_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, n_keys: int) -> np.ndarray:
    """n_keys * WALKS keys per window: hashes of COORDINATES sampled coordinates of its embedding for items of that size."""
    keys = np.zeros((len(starts), WALKS * n_keys), dtype=np.uint64)
    shares = np.random.default_rng(17).random((WALKS, MAX_KEYS, COORDINATES))[:, :n_keys]
    for walk in range(WALKS):
        e = embed(words, starts, ends, (shares[walk].reshape(1, -1) * (SPAN * sizes[:, None])).astype(np.int64), walk)
        for k in range(n_keys):
            key = np.full(len(starts), walk * MAX_KEYS + k + 1, dtype=np.uint64) + sizes.astype(np.uint64) * np.uint64(1_000_003)
            for c in range(COORDINATES):
                key = mix64(key + e[:, k * COORDINATES + c] * np.uint64(2 * c + 3))
            keys[:, walk * n_keys + k] = key
    return keys


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest edits between item and a stretch of text, and where that stretch ends: Myers' bit vectors, free ends in text."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text.tolist(), 1):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1, mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class ItemIndex:
    """What the search needs of a block of items: their words, anchors per gram size, and LSH keys. recall is what the keys reach on edited
    items; below the target, exact is set and the keys are the sizes of the items, which their windows share."""

    ids: list
    offsets: np.ndarray
    words: np.ndarray
    limits: np.ndarray
    anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    n_keys: int
    keys: np.ndarray
    key_items: np.ndarray
    recall: float
    exact: bool = False

    def keys_of(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return sizes[:, None].astype(np.uint64) if self.exact else lsh_keys(words, starts, ends, sizes, self.n_keys)


def grams(words: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q words from each place on."""
    if len(words) < q:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - q + 1, dtype=np.uint64)
    for k in range(q):
        out = mix64(out + words[k : len(words) - q + 1 + k])
    return out


def edited(words: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(k):
        kind, at = int(rng.integers(3)), int(rng.integers(max(len(out), 1)))
        fresh = int(rng.integers(1, 2**62))
        if kind == 0 or not out:
            out.insert(at, fresh)
        elif kind == 1:
            out[at] = fresh
        elif len(out) > 1:
            del out[at]
    return np.array(out, dtype=np.uint64)


def build_index(ids: list, items: list[np.ndarray], rate: float, recall: float, trials: int = 400) -> ItemIndex:
    """The index of a block. The number of keys is the least (a power of two) with which the share of items with k random
    edits whose window shares a key with its item reaches the target recall."""
    sizes = np.array([len(x) for x in items], dtype=np.int64)
    limits = np.floor(rate * sizes + 1e-9).astype(np.int64)
    offsets, words = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([np.zeros(0, dtype=np.uint64), *items])
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i, (n, k) in enumerate(zip(sizes, limits, strict=True)):
        q = min(int(n // (k + 1)), 8)
        if q:
            g = grams(items[i], q)
            for block in range(k + 1):
                at = int(block * n // (k + 1))
                found.setdefault(q, []).append((int(g[at]), at, int(n)))
    anchors = {}
    for q, rows in found.items():
        rows = sorted(set(rows))
        anchors[q] = (np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    rng, n_keys, got = np.random.default_rng(23), 4, 0.0
    if len(items):
        picks = rng.integers(len(items), size=trials)
        tries = [edited(items[i], int(limits[i]), rng) for i in picks]
        ends = np.cumsum([len(t) for t in tries])
        flat = np.concatenate(tries)
        while True:
            a = lsh_keys(words, offsets[picks], offsets[picks + 1], sizes[picks], n_keys)
            b = lsh_keys(flat, ends - [len(t) for t in tries], ends, sizes[picks], n_keys)
            got = float((a == b).any(axis=1).mean())
            if got >= recall or n_keys >= MAX_KEYS:
                break
            n_keys *= 2
    none = np.zeros(0, dtype=np.uint64)
    index = ItemIndex(ids, offsets, words, limits, anchors, n_keys, none, none, got, bool(len(items)) and got < recall)
    keys = index.keys_of(words, offsets[:-1], offsets[1:], sizes)
    order = np.argsort(keys, axis=None, kind="stable")
    index.keys, index.key_items = keys.ravel()[order], np.repeat(np.arange(len(items)), keys.shape[1])[order]
    return index


def windows(words: np.ndarray, index: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (start, size) of the windows that have an anchor of an item of that size at its place; starts may lie outside."""
    starts, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for q, (hashes, places, lengths) in index.anchors.items():
        g = grams(words, q)
        low = np.searchsorted(hashes, g, side="left")
        hit = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == g))
        n = np.searchsorted(hashes, g[hit], side="right") - low[hit]
        row = np.repeat(hit, n)
        which = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts.append(row - places[which])
        sizes.append(lengths[which])
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(sizes)]), axis=1)
    return both[0], both[1]


def search(offsets: np.ndarray, words: np.ndarray, index: ItemIndex, chunk: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, end word) of the best match of each item in each text, in offsets of the text."""
    starts, sizes = windows(words, index)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for at in range(0, len(starts), chunk):
        s, n = starts[at : at + chunk], sizes[at : at + chunk]
        middle = np.clip(s + n // 2, 0, len(words) - 1)
        doc = np.searchsorted(offsets, middle, side="right") - 1
        low, high = np.maximum(s, offsets[doc]), np.minimum(s + n, offsets[doc + 1])
        keys = index.keys_of(words, low, high, n)
        left, right = (np.searchsorted(index.keys, keys.ravel(), side=side) for side in ("left", "right"))
        hits = right - left
        window = np.repeat(np.arange(keys.size) // keys.shape[1], hits)
        place = np.repeat(left, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        pairs = np.unique(window * len(index.ids) + index.key_items[place])
        for w, item in zip((pairs // len(index.ids)).tolist(), (pairs % len(index.ids)).tolist(), strict=True):
            d, k = int(doc[w]), int(index.limits[item])
            if best.get((d, item), (1, 0, 0))[0] == 0:
                continue
            a, b = max(int(low[w]) - k, int(offsets[d])), min(int(high[w]) + k, int(offsets[d + 1]))
            edits, end = best_match(index.words[index.offsets[item] : index.offsets[item + 1]], words[a:b])
            if edits <= k:
                m = int(index.offsets[item + 1] - index.offsets[item])
                stop = a + end - int(offsets[d])
                best[d, item] = min(best.get((d, item), (1 << 30, 0, 0)), (edits, max(0, stop - m), stop))
    return [(d, item, *found) for (d, item), found in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, first_word, end_word (counted from end_word by the item's length) of every leaked item in every document.

    Whole texts are searched; words are compared without case and outer punctuation. Items without words match nothing; null
    and empty texts hold nothing; items and documents with a null id are searched like others, and ids may be of any type; equal items
    are all reported; repeated rows are searched each on its own; other columns are not read; an empty table gives an empty result.

    A benchmark of more than BLOCK_ITEMS items or BLOCK_WORDS words is searched for in blocks of that size, one after the other: each block's
    index is built by a task, broadcast (bounded by these two), used in one scan of the documents and given up.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    match = f"doc_id {dict(text.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, edits int, first_word long, end_word long"

    def index_of(block: list[tuple[object, np.ndarray]]):
        """The broadcast index of a block."""

        def build(batches):
            for batch in batches:
                ids, words = pickle.loads(batch.column(0)[0].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(build_index(ids, words, rate, recall))], pa.binary())], names=["index"])

        packed = pickle.dumps(([i for i, _ in block], [w for _, w in block]))
        built = spark.createDataFrame([(bytearray(packed),)], "block binary").mapInArrow(build, "index binary").first()[0]
        return spark.sparkContext.broadcast(pickle.loads(built))

    def matches(index) -> DataFrame:
        def run(batches):
            for batch in batches:
                doc: list[int] = []
                rows: list[tuple[int, ...]] = []
                for at, _, offsets, words in normal_words(batch.column(1)):
                    for d, i, *rest in search(offsets, words, index.value):
                        doc.append(at + d)
                        rows.append((index.value.ids[i], *rest))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = [item_type, pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "item_id", "edits", "first_word", "end_word"])

        return text.mapInArrow(run, match)

    def written(block) -> DataFrame:
        index = index_of(block)
        out = materialise(matches(index), "leaks")
        index.destroy()
        return out

    parts: list[DataFrame] = []
    block: list[tuple[object, np.ndarray]] = []
    size = 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        for _, _, _, words in normal_words(pa.array([row["text"]])):
            if len(words):
                block.append((row["item_id"], words))
                size += len(words)
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            parts, block, size = [*parts, written(block)], [], 0
    if not parts:
        return matches(index_of(block))
    parts += [written(block)] if block else []
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
