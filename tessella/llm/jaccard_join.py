"""N-gram Jaccard join: signature trees over token bitmaps prune pairs, exact sets decide, classes come back per document.

A document is represented by the 128-bit digest of its shingle set, so copies are one representative; sets are hashed once, written, and
read by all later steps. Representatives are dealt over partitions by their prefix: pairs that can reach the threshold share a shingle
among the first n - ceil(t * n) + 1 of each set in any fixed order of shingles; the order here puts frequent ones last. In each
partition, representatives of one size range make one signature tree, whose nodes hold the range of sizes and two OR-combined
bitmaps: of the dealt shingles that brought the members here, and of their whole sets. Trees are traversed against themselves and
against the tree of the next size range, and node pairs whose largest possible overlap is too small are pruned. Connected classes
of what is left are small closed worlds, in which the exact sets are compared. Results are exact up to collisions of 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import as_strings, drop_table, in_bitmap, join_groups, materialise, mix64, split_words, text_slices, word_hashes

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Counters of the frequency sketch (16 bits each); slices in which it is summed.
COUNTERS, SLICES = 1 << 19, 16
#: Prefix entries that one task groups by shingle; entries of shared shingles to a partition of trees.
SLOT_ENTRIES, PART_ENTRIES = 400_000, 8_000
#: A shingle with more prefix entries than this, by the sketch, is dealt over pairs of salts, so that no task gets many more than twice as many of them.
HOT_ENTRIES = 50_000
#: Digests that a task remembers, so as to write equal sets once.
KNOWN = 100_000
#: Bits per shingle of a set's bitmap, log2 of its greatest width (wider sets are folded), members of a leaf, children of a node, node pairs examined at once.
BITS, WIDEST, LEAF, FANOUT, FRONTIER = 2, 16, 16, 8, 1 << 14
#: Shingles of the sets that one task compares: an even share of all, within these bounds.
LEAST_TASK_SHINGLES, TASK_SHINGLES = 200_000, 4_000_000


def least_overlap(a, b):
    """Fewest common shingles with which sets of sizes a and b link: 100 * i >= 75 * (a + b - i), in whole numbers."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def shingle_sets(texts: pa.Array):
    """Per slice: first row, offsets, and the sorted distinct shingle hashes of each text.

    A shingle hashes five words in order; a text with fewer words has the whole sequence as its one shingle, of a hash that also
    depends on its length; a text without words has none.
    """
    for at, part in text_slices(as_strings(texts), 2 << 20):
        offsets, codes, table = split_words(part)
        words = word_hashes(table)[codes]
        size = np.diff(offsets)
        n = len(words)
        h = np.zeros(max(n - SHINGLE + 1, 0), dtype=np.uint64)
        for k in range(SHINGLE):
            h = mix64(h + words[k : n - SHINGLE + 1 + k]) if len(h) else h
        grams = np.maximum(size - SHINGLE + 1, 0)
        doc = np.repeat(np.arange(len(size)), grams)
        first = np.repeat(offsets[:-1], grams)
        run = np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
        hashes = h[first + run] if len(doc) else np.zeros(0, dtype=np.uint64)
        short = np.flatnonzero((size > 0) & (size < SHINGLE))
        extra = np.zeros(len(short), dtype=np.uint64)
        for j, i in enumerate(short):
            x = np.array([size[i]], dtype=np.uint64)
            for w in words[offsets[i] : offsets[i + 1]]:
                x = mix64(x + w)
            extra[j] = x[0]
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, extra])
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        doc, hashes = doc[new], hashes[new]
        yield at, np.searchsorted(doc, np.arange(len(size) + 1)), hashes


def set_digests(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each set as a row of two numbers: sums of two mixes of its members, mixed once more with each other."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes + np.uint64(s)), dtype=np.uint64)]) for s in (0x51ED, 0xC0DE)]
    a, b = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
    first = mix64(a + mix64(b))
    return np.stack([first, mix64(b + mix64(first))], axis=1)


def as_binary(rows: np.ndarray) -> pa.Array:
    """Rows of two numbers as 16-byte strings."""
    flat = np.ascontiguousarray(rows, dtype=np.uint64)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def bitmap_class(n: np.ndarray) -> np.ndarray:
    """log2 of the number of bitmap bits for sets of n members: at least BITS * n bits, within 6 and WIDEST. Sizes within 3 : 4 are
    of the same class or of neighbouring ones."""
    return np.clip(np.ceil(np.log2(np.maximum(BITS * np.asarray(n), 64))).astype(np.int64), 6, WIDEST)


def bitmap(hashes: np.ndarray, bits: int) -> bytes:
    out = np.zeros(1 << bits, dtype=bool)
    out[(hashes & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def fold(words: np.ndarray, to: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to so many words; a shingle's bit is its hash modulo the width, so halves are OR-ed."""
    while words.shape[1] > to:
        half = words.shape[1] // 2
        words = words[:, :half] | words[:, half:]
    return words


class Level:
    """Nodes of one level of a tree: OR of the members' set bitmaps, range of their sizes, largest excess of a size over its number of
    bits, OR of the bitmaps of dealt shingles (None for the members themselves), first child and first member of each."""

    def __init__(self, bits, low, high, extra, dealt, children, members):
        self.bits, self.low, self.high, self.extra, self.dealt, self.children, self.members = bits, low, high, extra, dealt, children, members

    def __len__(self):
        return len(self.low)


class SignatureTree:
    """Levels of nodes from the members up to one root. Members that share dealt shingles stand next to each other, then those of like size.

    ids: the members; entry_member and entry_shingle: which member has which dealt shingle (numbered from 0 to n_shingles).
    """

    def __init__(self, ids: np.ndarray, bits: np.ndarray, sizes: np.ndarray, entry_member: np.ndarray, entry_shingle: np.ndarray, n_shingles: int):
        first = np.full(len(ids), n_shingles)
        np.minimum.at(first, entry_member, entry_shingle)
        order = np.lexsort((*bits.T[:2], sizes, first))
        self.ids, bits, sizes = ids[order], bits[order], sizes[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        ends = np.arange(len(order) + 1)
        self.levels = [Level(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64), None, ends, ends)]
        at = np.arange(0, len(order), LEAF)
        shingles = np.zeros((len(at), -(-max(n_shingles, 1) // 64) * 64), dtype=bool)
        shingles[place[entry_member] // LEAF, entry_shingle] = True
        dealt = np.packbits(shingles, axis=1, bitorder="little").view(np.uint64)
        while True:
            below = self.levels[-1]
            if below.dealt is not None:
                at = np.arange(0, len(below), FANOUT)
                dealt = np.bitwise_or.reduceat(below.dealt, at, axis=0)
            ends = np.append(at, len(below))
            self.levels.append(Level(np.bitwise_or.reduceat(below.bits, at, axis=0), np.minimum.reduceat(below.low, at), np.maximum.reduceat(below.high, at), np.maximum.reduceat(below.extra, at), dealt, ends, below.members[ends]))
            if len(at) == 1:
                return

    def one_class(self, level: int, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest class among the members of each node."""
        label, at = classes.labels()[self.ids], self.levels[level].members[:-1]
        return np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)

    def expand(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of the nodes, and how many each has."""
        low = self.levels[level].children[nodes]
        n = self.levels[level].children[nodes + 1] - low
        return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), n


def possible(x: Level, i: np.ndarray, y: Level, j: np.ndarray) -> np.ndarray:
    """Whether nodes i of x and nodes j of y may hold a linking pair of this partition: the largest overlap that sizes, dealt shingles and
    set bitmaps leave possible against the smallest that a link needs."""
    need = least_overlap(x.low[i], y.low[j])
    ok = (np.minimum(x.high[i], y.high[j]) >= need) & (DENOMINATOR * x.high[i] >= NUMERATOR * y.low[j]) & (DENOMINATOR * y.high[j] >= NUMERATOR * x.low[i])
    at = np.flatnonzero(ok)
    if x.dealt is not None and y.dealt is not None:
        meet = (x.dealt[i[at]] & y.dealt[j[at]]).any(axis=1)
        ok[at[~meet]] = False
        at = at[meet]
    common = np.bitwise_count(x.bits[i[at]] & y.bits[j[at]]).sum(axis=1).astype(np.int64)
    ok[at] = np.minimum(x.extra[i[at]], y.extra[j[at]]) + common >= need[at]
    return ok


class Classes:
    """Union-find over 0..n-1, fed with arrays of pairs; links are the pairs that joined two classes. seen and pruned count node pairs."""

    def __init__(self, n: int):
        self.root, self.links, self.seen, self.pruned = np.arange(n), [], 0, 0

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def labels(self) -> np.ndarray:
        while not ((up := self.root[self.root]) == self.root).all():
            self.root = up
        return self.root

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            for x, y in zip(i[:64].tolist(), j[:64].tolist(), strict=True):
                a, b = self.find(x), self.find(y)
                if a != b:
                    self.root[max(a, b)] = min(a, b)
                    self.links.append((x, y))
            i, j = i[64:], j[64:]
            if len(i):
                label = self.labels()
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]


def traverse(a: SignatureTree, b: SignatureTree, la: int, lb: int, i: np.ndarray, j: np.ndarray, classes: Classes) -> None:
    """Dual traversal from nodes i of level la of a and j of level lb of b; member pairs that nothing rules out join classes.

    A node pair is pruned if its largest possible overlap is too small, or if all its members are in one class already. Two nodes of
    one class each need one possible pair only, so their first members are tried first: a mass of near copies costs its length,
    not its square. Node pairs wait on a stack and are expanded FRONTIER at a time, so memory stays bounded.
    """
    todo = [(la, lb, i, j)]
    while todo:
        la, lb, i, j = todo.pop()
        if len(i) > FRONTIER:
            todo.append((la, lb, i[FRONTIER:], j[FRONTIER:]))
            i, j = i[:FRONTIER], j[:FRONTIER]
        x, y = a.levels[la], b.levels[lb]
        keep = possible(x, i, y, j)
        if la or lb:
            classes.seen, classes.pruned = classes.seen + len(i), classes.pruned + int((~keep).sum())
        i, j = i[keep], j[keep]
        if la == lb == 0:
            classes.add(a.ids[i], b.ids[j])
            continue
        if not len(i):
            continue
        (low_a, high_a), (low_b, high_b) = a.one_class(la, classes), b.one_class(lb, classes)
        one = (low_a[i] == high_a[i]) & (low_b[j] == high_b[j])
        open_ = ~(one & (low_a[i] == low_b[j]))
        i, j, one = i[open_], j[open_], np.flatnonzero(one[open_])
        p, q = x.members[i[one]], y.members[j[one]]
        hit = possible(a.levels[0], p, b.levels[0], q)
        classes.add(a.ids[p[hit]], b.ids[q[hit]])
        left = np.ones(len(i), dtype=bool)
        left[one[hit]] = False
        i, j = i[left], j[left]
        down_a, down_b = la >= lb, lb >= la
        if down_a:
            i, n = a.expand(la, i)
            j = np.repeat(j, n)
        if down_b:
            j, n = b.expand(lb, j)
            i = np.repeat(i, n)
        if a is b and la == 1:
            i, j = i[i < j], j[i < j]
        if len(i):
            todo.append((la - down_a, lb - down_b, i, j))


def join_self(tree: SignatureTree, classes: Classes) -> None:
    """All pairs of a tree's members: leaves against themselves, then, level by level upwards, children of one node against each other."""
    leaves = np.arange(len(tree.levels[1]))
    traverse(tree, tree, 1, 1, leaves, leaves, classes)
    for level in range(1, len(tree.levels) - 1):
        parent = np.repeat(np.arange(len(tree.levels[level + 1])), np.diff(tree.levels[level + 1].children))
        nodes = np.arange(len(parent))
        for step in range(1, FANOUT):
            i = nodes[:-step][parent[:-step] == parent[step:]]
            if len(i):
                traverse(tree, tree, level, level, i, i + step, classes)


def candidate_links(sizes: np.ndarray, maps: list[bytes], entry_member: np.ndarray, entry_shingle: np.ndarray) -> Classes:
    """Classes of the representatives of a partition under the pairs that signature trees leave possible; .links is a spanning forest of those pairs.

    One tree per size range (bitmap width), joined with itself and with the tree of the next range, its bitmaps folded down.
    """
    width, n_shingles = bitmap_class(sizes), int(entry_shingle.max(initial=-1)) + 1
    classes = Classes(len(sizes))
    place = np.zeros(len(sizes), dtype=np.int64)
    rows = {c: np.flatnonzero(width == c) for c in np.unique(width).tolist()}

    def grow(c: int, words: int) -> SignatureTree:
        at = rows[c]
        place[at] = np.arange(len(at))
        own = width[entry_member] == c
        bits = np.frombuffer(b"".join(maps[i] for i in at), dtype=np.uint64).reshape(len(at), -1)
        return SignatureTree(at, fold(bits, words), sizes[at], place[entry_member[own]], entry_shingle[own], n_shingles)

    trees = {c: grow(c, 1 << (c - 6)) for c in rows}
    for tree in trees.values():
        join_self(tree, classes)
    for c in trees:
        if c + 1 in rows:
            a, b = trees[c], grow(c + 1, 1 << (c - 6))
            traverse(a, b, len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), classes)
    return classes


def exact_classes(sets: list[np.ndarray]) -> np.ndarray:
    """Class (smallest index) of each set under exact links.

    Each class grows from a first member: a member's set is compared with all sets not yet placed, those that link join
    the class and are expanded in turn. Sets already placed are compared no more, so a class of near copies costs one pass.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    label = np.full(n, -1)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    tokens, owner = flat[order], owner[order]
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        queue = [seed]
        while queue:
            x = queue.pop()
            low, high = np.searchsorted(tokens, sets[x], side="left"), np.searchsorted(tokens, sets[x], side="right")
            lengths = high - low
            rows = owner[np.repeat(low, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
            common = np.bincount(rows[label[rows] < 0], minlength=n)
            near = np.flatnonzero((common > 0) & (common >= least_overlap(sizes, sizes[x])))
            label[near] = seed
            queue.extend(near.tolist())
            if len(near) * 4 > n and (label < 0).any():
                left = label[owner] < 0
                tokens, owner = tokens[left], owner[left]
            elif not (label < 0).any():
                return label
    return label


def _batch(columns, kinds, names):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about so many shingles, or of one row."""
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n


def _summaries(text: DataFrame) -> DataFrame:
    """kind 0: doc_id, n and digest of each document, and of the first of equal sets among KNOWN in a task the bitmap and the set itself;
    kind 1: a slice (part) of the frequency sketch of a partition."""
    id_type = dict(text.dtypes)["doc_id"]

    def run(batches):
        counts, id_arrow, known = np.zeros(COUNTERS, dtype=np.int64), None, set()
        names, kinds = ["kind", "part", "doc_id", "n", "digest", "bits", "data"], [pa.int32(), pa.int32(), None, pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            id_arrow = batch.column(0).type
            if len(known) > KNOWN:
                known.clear()
            for at, offsets, hashes in shingle_sets(batch.column(1)):
                size, digest = np.diff(offsets), set_digests(offsets, hashes)
                counts += np.bincount((hashes >> np.uint64(45)).astype(np.int64), minlength=COUNTERS)
                width, maps, sets = bitmap_class(size), [], []
                for i, key in enumerate(map(bytes, digest)):
                    own = None if not size[i] or key in known else hashes[offsets[i] : offsets[i + 1]]
                    known.add(key)
                    maps.append(None if own is None else bitmap(own, int(width[i])))
                    sets.append(None if own is None else own.tobytes())
                zeros = np.zeros(len(size), dtype=np.int32)
                yield _batch([zeros, zeros, batch.column(0).slice(at, len(size)), size, as_binary(digest), maps, sets], kinds, names)
        if id_arrow is not None:
            low = np.minimum(counts, 65_535).astype(np.uint16).reshape(SLICES, -1)
            yield _batch([[1] * SLICES, list(range(SLICES)), pa.nulls(SLICES, id_arrow), [0] * SLICES, [None] * SLICES, [x.tobytes() for x in low], [None] * SLICES], kinds, names)

    return text.mapInArrow(run, f"kind int, part int, doc_id {id_type}, n long, digest binary, bits binary, data binary")


def _sketch(rows: DataFrame) -> np.ndarray:
    """The frequency sketch of all documents: COUNTERS numbers, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(COUNTERS // SLICES, dtype=np.int64), 0
        for batch in batches:
            part = batch.column(0)[0].as_py()
            for x in batch.column(1).to_pylist():
                total += np.frombuffer(x, dtype=np.uint16)
        yield _batch([[part], [total.astype(np.uint32).tobytes()]], [pa.int32(), pa.binary()], ["part", "data"])

    got = rows.where("kind = 1").select("part", F.col("bits").alias("data")).groupBy("part").applyInArrow(add, "part int, data binary").toPandas().sort_values("part")
    return np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in got["data"]]) if len(got) else np.zeros(COUNTERS, dtype=np.uint32)


def _rank(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Sort key of shingles in the common order: frequency level (12 bits), then a mix of the hash."""
    return (level[(hashes >> np.uint64(45)).astype(np.int64)].astype(np.uint64) << np.uint64(52)) | (mix64(hashes) >> np.uint64(12))


def salted(tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix entries with those of hot shingles dealt over pairs of salts: an entry with salt s of k goes under the k keys
    of (shingle, s, t), t any salt, so any two entries of a shingle still meet under one key, and a key has two in k of them."""
    hot = np.flatnonzero(salts > 1)
    if not len(hot):
        return tokens, ids, sizes
    k = salts[hot]
    own = np.repeat((mix64(ids[hot] + np.uint64(0x5A17)) % k.astype(np.uint64)).astype(np.int64), k)
    other = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    row = np.repeat(hot, k)
    key = mix64(tokens[row] + mix64((np.minimum(own, other) * 65_536 + np.maximum(own, other) + 1).astype(np.uint64)))
    cold = salts <= 1
    return np.concatenate([tokens[cold], key]), np.concatenate([ids[cold], ids[row]]), np.concatenate([sizes[cold], sizes[row]])


#: Steps of size_class() to a factor of 4 : 3.
STEPS = 3


def size_class(sizes: np.ndarray) -> np.ndarray:
    """Sizes on a logarithmic scale in one byte; sizes within 4 : 3 are at most STEPS apart, and one more for rounding."""
    return np.minimum(np.log(np.maximum(sizes, 1)) * (STEPS / math.log(DENOMINATOR / NUMERATOR)), 255).astype(np.uint8)


def _blocks(sets: DataFrame, level: np.ndarray, salts: np.ndarray, n_slots: int) -> DataFrame:
    """Distinct groups of representatives that share a prefix shingle (k0, k1: their digest; lead: the smallest member), as packed ids.

    An id is the first half of a digest. Two sets with one id are taken for one here and told apart again in _links(), where both get the
    groups of either; so only a link between two such sets can be lost, as by a collision of shingle hashes.
    """
    shared = sets.sparkSession.sparkContext.broadcast((level, salts))

    def emit(batches):
        names, kinds = ["slot", "tokens", "ids", "sizes"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for batch in (part for batch in batches for part in _slices(batch, batch.column(1).to_numpy())):
            level, salts = shared.value
            size = batch.column(1).to_numpy()
            own = np.ascontiguousarray(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64).reshape(-1, 2)[:, 0])
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64)
            doc = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((_rank(tokens, level), doc))
            doc, tokens = doc[order], tokens[order]
            place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            inside = place < (size - -(-NUMERATOR * size // DENOMINATOR) + 1)[doc]
            doc, tokens = doc[inside], tokens[inside]
            tokens, ids, sizes = salted(tokens, own[doc], size_class(size)[doc], salts[(tokens >> np.uint64(45)).astype(np.int64)])
            slot = (mix64(tokens + np.uint64(77)) % np.uint64(n_slots)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            cuts = np.searchsorted(slot[order], np.arange(n_slots + 1))
            full = np.flatnonzero(np.diff(cuts))
            pack = lambda x: [x[order[cuts[k] : cuts[k + 1]]].tobytes() for k in full]  # noqa: E731, B023
            yield _batch([full.astype(np.int32), pack(tokens), pack(ids), pack(sizes)], kinds, names)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for batch in batches for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        tokens = np.frombuffer(b"".join(x[0] for x in got), dtype=np.uint64)
        ids = np.frombuffer(b"".join(x[1] for x in got), dtype=np.uint64)
        sizes = np.frombuffer(b"".join(x[2] for x in got), dtype=np.uint8)
        del got
        order = np.lexsort((ids, sizes, tokens))
        tokens, ids, sizes = tokens[order], ids[order], sizes[order].astype(np.int64)
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])
        tokens, ids, sizes = tokens[new], ids[new], sizes[new]
        cut = np.ones(len(tokens), dtype=bool)  # a gap of sizes over 4 : 3 parts a group
        cut[1:] = (tokens[1:] != tokens[:-1]) | (np.diff(sizes) > STEPS + 1)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(tokens))
        keys = []
        for salt in (0, 0xB10C):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(ids + mix64(ids + np.uint64(salt))), dtype=np.uint64)])
            keys.append((sums[ends] - sums[starts]).view(np.int64) if len(starts) else np.zeros(0, dtype=np.int64))
        many = np.flatnonzero(ends - starts > 1)
        many = many[np.unique(np.stack([keys[0][many], keys[1][many]]), axis=1, return_index=True)[1]] if len(many) else many
        lead = np.minimum.reduceat(ids, starts).view(np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
        columns = [keys[0][many], keys[1][many], lead[many], ends[many] - starts[many], [ids[starts[b] : ends[b]].tobytes() for b in many]]
        yield _batch(columns, [pa.int64()] * 4 + [pa.binary()], ["k0", "k1", "lead", "members", "ids"])

    packed = sets.select("digest", "n", "data").mapInArrow(emit, "slot int, tokens binary, ids binary, sizes binary")
    found = packed.groupBy("slot").applyInArrow(group, "k0 long, k1 long, lead long, members long, ids binary")
    return found.dropDuplicates(["k0", "k1"])


LINKS = "a binary, b binary, seen long, pruned long"
#: Rows of a table that may be broadcast: some 25 MB of digests and numbers. Larger ones are joined by shuffling.
BROADCAST_ROWS = 250_000


def _links(blocks: DataFrame, maps: DataFrame) -> DataFrame:
    """Links (a, b) of representatives by signature trees, and one row per partition with the node pairs seen and pruned.

    Groups with one smallest member go to one partition, since they have most members in common, unless they have more than PART_ENTRIES
    entries together; then they are dealt over as many as that takes.
    """
    total = blocks.agg(F.sum("members")).first()[0] or 0
    parts = max(1, -(-total // PART_ENTRIES))
    large = blocks.groupBy("lead").agg(F.ceil(F.sum("members") / PART_ENTRIES).alias("spread")).where("spread > 1")
    place = F.pmod(F.xxhash64("lead", F.coalesce(F.pmod(F.col("k0"), F.col("spread")), F.lit(0))), F.lit(parts))

    def members(batches):
        for batch in batches:
            ids = batch.column(2).to_pylist()
            part, key = (np.repeat(batch.column(k).to_numpy(), [len(x) // 8 for x in ids]) for k in (0, 1))
            own = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(part), [None, pa.py_buffer(b"".join(ids))]).cast(pa.binary())
            yield _batch([part, key, own], [pa.int64(), pa.int64(), pa.binary()], ["part", "block", "id"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        names, shared = table.column("digest").to_pylist(), table.column("blocks").to_pylist()
        member = np.repeat(np.arange(len(names)), [len(x) for x in shared])
        shingle = np.unique(np.fromiter((k for x in shared for k in x), dtype=np.int64, count=len(member)), return_inverse=True)[1]
        found = candidate_links(table.column("n").to_numpy(), table.column("bits").to_pylist(), member, shingle)
        a, b = [names[x] for x, _ in found.links], [names[y] for _, y in found.links]
        yield _batch([[*a, None], [*b, None], [*[None] * len(a), found.seen], [*[None] * len(a), found.pruned]], [pa.binary(), pa.binary(), pa.int64(), pa.int64()], ["a", "b", "seen", "pruned"])

    listed = blocks.join(large, "lead", "left").select(place.alias("part"), "k0", "ids").mapInArrow(members, "part long, block long, id binary")
    # dealt by id once, for the grouping and for the join
    own = listed.repartition("id").groupBy("id", "part").agg(F.collect_list("block").alias("blocks"))
    maps = maps.withColumn("id", F.substring("digest", 1, 8)).repartition("id").dropDuplicates(["id", "digest"])
    return own.join(maps, "id").select("part", "digest", "n", "blocks", "bits").groupBy("part").applyInArrow(trees, LINKS)


def _connected(links: DataFrame) -> DataFrame:
    """member, root: the smallest member of each connected class of links (a, b), as a written table, by alternating stars.

    In each round every node's larger neighbours are linked to the smallest node of its neighbourhood, then its smaller ones and itself
    to the smallest of those. Classes stay as they are, and links end up as stars around the smallest members, in a number of
    rounds that grows with the logarithm of the longest path. Every round is one table in the shared folder.
    """
    edges = materialise(links.selectExpr("greatest(a, b) u", "least(a, b) v").where("u > v").distinct(), "edges")
    mark, before = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first(), None
    while mark != before:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.expr("array(struct(v as u, m as v), struct(u as u, m as v))"))).where("u > v").distinct()
        after = materialise(small, "edges")
        drop_table(edges)
        edges, before, mark = after, mark, after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    roots = materialise(edges.selectExpr("u as member", "v as root").union(edges.selectExpr("v", "v").distinct()), "roots")
    drop_table(edges)
    return roots


def representatives(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """The written summaries of all documents, and the frequency sketch of their shingles."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = materialise(_summaries(text), "summaries", {"parquet.enable.dictionary": "false"})
    return table.where("kind = 0"), _sketch(table).astype(np.float64)


def signature_links(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """Links that no bitmap rules out, as a written table of columns LINKS, whose classes hold every true link."""
    # Levels are fine steps of a counter's excess over the mean. What is shared by d documents stands d above the rest of its counter,
    # so it takes a place behind most shingles that are not, long before d is sure to be told from noise.
    level = np.clip((counts - counts.mean()) / math.sqrt(counts.mean() + 1) * 32 + 128, 0, 4095).astype(np.uint16)
    salts = np.maximum(1, np.ceil((counts - counts.mean()) / HOT_ENTRIES)).astype(np.int64)
    n_slots = max(8, math.ceil(counts.sum() / (4 * SLOT_ENTRIES)))
    blocks = materialise(_blocks(sets.where("data is not null"), level, salts, n_slots), "blocks")
    maps = sets.where("data is not null").select("digest", "n", "bits")
    links = materialise(_links(blocks, maps), "links")
    drop_table(blocks)
    return links


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row.

    Sets of 5-word shingles of whole texts, A-Z lower-cased, link from a Jaccard similarity of 0.75 on. Null texts and
    texts without words have no shingles and are linked with nothing: component_id is their own doc_id. Ids may be of any
    type that has an order. Repeated rows come back as often as they go in; null doc_ids are smaller than none and never name a class that has others;
    other columns are not read; an empty table gives an empty result. The result reads two tables in the shared folder.
    """
    sets, counts = representatives(docs, id_col, text_col)
    n_rows = sets.count()
    links = signature_links(sets, counts)
    roots = _connected(links.where("a is not null").select("a", "b")).selectExpr("member as digest", "root")
    classes = _verified(sets, roots)
    drop_table(links, roots)

    reps = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("size"))
    named = reps.join(classes, "digest", "left").withColumn("class", F.coalesce("class", "digest"))
    # classes of several representatives alone need a second grouping
    low = named.where("class_size > 1").groupBy("class").agg(F.min("first").alias("low"))
    named = named.join(low, "class", "left").select("digest", F.coalesce("low", "first").alias("component"), "size")
    out = join_groups(sets.select("doc_id", "n", "digest"), named, "digest", "size", n_rows)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")).alias("component_id"))


COMPARED = "root binary, digest binary, class binary, chunks int"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact classes of the sets of one group of rows (root, digest, data, chunks, ...); class: the smallest digest of the class."""
    table = pa.Table.from_batches(list(batches))
    sets = dict(zip(table.column("digest").to_pylist(), table.column("data").to_pylist(), strict=True))
    keys = sorted(sets)
    label = exact_classes([np.frombuffer(sets[k], dtype=np.uint64) for k in keys])
    root, chunks = table.column("root")[0].as_py(), table.column("chunks")[0].as_py()
    yield _batch([[root] * len(keys), keys, [keys[i] for i in label], [chunks] * len(keys)], [pa.binary()] * 3 + [pa.int32()], ["root", "digest", "class", "chunks"])


def _chunked(members: DataFrame, shingles: int) -> DataFrame:
    """members (root, digest, n, ...) with chunks and chunk: those of a world are dealt by digest over chunks of about so many shingles."""
    worlds = members.groupBy("root").agg(F.ceil(F.sum("n") / shingles).cast("int").alias("chunks"))
    return members.join(worlds, "root").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))


def _verified(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """digest, class (one of its digests), class_size of all representatives in the worlds (roots), by their exact sets.

    A world is dealt over chunks of at most an even share of all shingles, and each is compared for itself. Then one member stands for each
    class, and those are dealt and compared again, as long as that brings their number down. Where a world is left in
    several classes, a link that is still to be found has an end outside its largest class; so what is outside meets every
    chunk of the world. No task ever holds more than two chunks, and no link between any two members is missed.
    """
    spark = sets.sparkSession
    first = sets.where("data is not null")
    members = in_bitmap(first.select("digest", "n"), "digest", roots.select("digest")).dropDuplicates(["digest"]).join(roots, "digest")
    members = materialise(members, "members")
    total = members.agg(F.sum("n")).first()[0] or 0
    share = min(TASK_SHINGLES, max(LEAST_TASK_SHINGLES, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    places = materialise(_chunked(members, share), "places")
    few = members.count() <= BROADCAST_ROWS
    data = lambda at: in_bitmap(first.select("digest", "data"), "digest", at.select("digest")).join(F.broadcast(at) if few else at, "digest")
    # dealt before repeated sets go, so that the sets move once; a set comes at most once from each part of the documents
    label = data(places).repartition("root", "chunk").dropDuplicates(["root", "chunk", "digest"]).groupBy("root", "chunk").applyInArrow(_compare, COMPARED)
    label = materialise(label, "classes")
    large = label.where("chunks > 1")
    worlds, leaders = large.agg(F.countDistinct("root"), F.countDistinct("class")).first()
    dealt = materialise(data(places.where("chunks > 1")).dropDuplicates(["digest"]), "worlds") if leaders > worlds else None
    while leaders > worlds:
        standing = dealt.drop("chunks", "chunk").join(large.select(F.col("class").alias("digest")).distinct(), "digest", "left_semi")
        merged = _chunked(standing, share).groupBy("root", "chunk").applyInArrow(_compare, COMPARED).select(F.col("digest").alias("class"), F.col("class").alias("to"))
        after = materialise(label.join(merged, "class", "left").select("root", "digest", F.coalesce("to", "class").alias("class"), "chunks"), "classes")
        drop_table(label)
        label, large = after, after.where("chunks > 1")
        before, leaders = leaders, large.select("class").distinct().count()
        if 4 * leaders > 3 * before:
            break
    final = label.select("digest", "class")
    if leaders > worlds:
        links = _across(dealt, large, share)
        roots = _connected(links)
        final = label.join(roots.select(F.col("member").alias("class"), F.col("root").alias("to")), "class", "left").select("digest", F.coalesce("to", "class").alias("class"))
        final = materialise(final, "classes")
        drop_table(label, links, roots)
    drop_table(members, places, *([dealt] if dealt else []))
    return final.join(final.groupBy("class").agg(F.count("*").alias("class_size")), "class").select("digest", "class", "class_size")


def _across(dealt: DataFrame, label: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between the classes in which a world is left, as a written table."""
    sizes = label.groupBy("root", "class").agg(F.count("*").alias("size"))
    worlds = sizes.groupBy("root").agg(F.max_by("class", F.struct("size", "class")).alias("largest"), F.count("*").alias("classes")).where("classes > 1").select("root", "largest")
    rows = dealt.join(worlds, "root").join(label.select("digest", "class"), "digest")
    outside = rows.where("class <> largest")
    groups = outside.groupBy("root").agg(F.ceil(F.sum("n") / share).cast("int").alias("groups"))
    inside = rows.join(groups, "root").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    meeting = outside.join(groups, "root").withColumn("group", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("groups")).cast("int"))
    meeting = meeting.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ["root", "chunk", "group", "digest", "class", "data"]

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        sets = dict(zip(table.column("digest").to_pylist(), zip(table.column("class").to_pylist(), table.column("data").to_pylist(), strict=True), strict=True))
        names = [x for x, _ in sets.values()]
        found = exact_classes([np.frombuffer(x, dtype=np.uint64) for _, x in sets.values()])
        links = {(names[k], names[i]) for i, k in enumerate(found.tolist()) if names[i] != names[k]}
        yield _batch([[a for a, _ in links], [b for _, b in links]], [pa.binary()] * 2, ["a", "b"])

    return materialise(inside.select(columns).unionByName(meeting.select(columns)).groupBy("root", "chunk", "group").applyInArrow(across, "a binary, b binary"), "across")
