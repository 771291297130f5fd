"""Missing values: column fills, neighbour voting on dosages, and low-rank completion of matrices by group."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def observed(c: str) -> Column:
    """The value, or null where it is null or NaN."""
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


#: Bins of one pass over a column in search of a quantile, and values that one task may sort at the end.
BINS, SORTED = 4096, 100_000

#: Pairs of samples that a task compares at a time.
PAIRS = 1 << 22

#: Variants of a block of neighbours' windows, and bytes of windows that a task makes at a time.
BLOCK, WINDOW_BYTES = 1 << 16, 1 << 24

#: Candidates that votes meet at first and at most at a time, and different windows of candidates that are counted (more are met each time they come).
FIRST_MET, MET, REMEMBERED = 256, 4096, 1_000_000


def kth_smallest(values: DataFrame, c: str, k: int, low: float, high: float) -> float:
    """The k-th smallest (from 0) of a column without missing values, between its bounds: each pass counts equal bins of the range and goes
    on with the one that holds it, so a task holds BINS counts, or SORTED values in the end. Ends with the values themselves, however unevenly they lie."""
    below = 0
    while low < high:
        inside = values.where(F.col(c).between(low, high))
        width = (high - low) / BINS
        bin_ = F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        counts = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).orderBy("low").collect()
        for row in counts:
            if below + row["n"] > k:
                break
            below += row["n"]
        low, high = row["low"], row["high"]
        if low < high and row["n"] <= SORTED:
            return float(values.where(F.col(c).between(low, high)).agg(F.element_at(F.array_sort(F.collect_list(c)), k - below + 1)).first()[0])
    return float(low)


def median(wide: DataFrame, c: str) -> float | None:
    """The exact median over a column's observed cells."""
    values = wide.select(observed(c).alias("x")).where("x is not null")
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    lower = kth_smallest(values, "x", (n - 1) // 2, low, high)
    if n % 2:
        return lower
    upto, following = values.agg(F.count(F.when(F.col("x") <= F.lit(lower), 1)), F.min(F.when(F.col("x") > F.lit(lower), F.col("x")))).first()
    return (lower + (lower if upto > n // 2 else following)) / 2


def fill(wide: DataFrame, columns: list[str], method: str = "mean") -> DataFrame:
    """Missing cells become the column's mean or exact median over its observed cells, or zero; observed cells stay as they are.

    Means are one aggregation; a median takes some passes over its column, none of which brings the values together.
    """
    if method == "zero":
        fills = dict.fromkeys(columns, 0.0)
    elif method == "mean":
        fills = dict(zip(columns, wide.agg(*[F.avg(observed(c)) for c in columns]).first(), strict=True))
    elif method == "median":
        fills = {c: median(wide, c) for c in columns}
    else:
        raise ValueError(f"no fill {method!r}")
    return wide.select(*[F.coalesce(observed(c), F.lit(fills[c]).cast("double")).alias(c) if c in fills else F.col(f"`{c}`") for c in wide.columns])


def check_dosages(long: DataFrame, value: str = "dosage") -> DataFrame:
    """Rows whose dosage is not 0, 1, 2, -1 or missing; a valid table has none."""
    return long.where(~F.coalesce(F.col(value).isin(0, 1, 2, -1) | F.isnan(F.col(value).cast("double")), F.lit(True)))


def fully_missing(long: DataFrame, by: str, value: str = "dosage") -> DataFrame:
    """Rows or columns (values of by) without any observed cell."""
    return long.groupBy(by).agg(F.count(F.when(~F.isnan(F.col(value).cast("double")), F.col(value))).alias("n")).where("n = 0").select(by)


def _windows(s: np.ndarray, j: np.ndarray, d: np.ndarray, width: int) -> np.ndarray:
    """Dosages of each row's sample over the variants j - width to j + width (-1: missing), of rows in order of sample and variant."""
    out = np.full((len(j), 2 * width + 1), -1, dtype=np.int8)
    out[:, width] = d
    for ahead in range(1, len(j)):
        near = np.flatnonzero((s[ahead:] == s[:-ahead]) & (j[ahead:] - j[:-ahead] <= width))
        if not len(near):
            break
        near = near[j[near + ahead] > j[near]]
        step = j[near + ahead] - j[near]
        out[near, width + step] = d[near + ahead]
        out[near + ahead, width - step] = d[near]
    return out


def _first_of_each(groups: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k rows of each group, in ascending order."""
    order = np.argsort(groups, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(groups[order]) != 0]) if len(order) else order
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return np.sort(order[place < k])


def _packed(windows: np.ndarray) -> pa.Array:
    """One binary value per row of bytes."""
    ends = np.arange(len(windows) + 1, dtype=np.int32) * windows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(windows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(windows))])


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    """Rows of size bytes from binary values of that length each."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.int8)[ends[0] : ends[-1]].reshape(len(column), size)


def _codes(rows: np.ndarray) -> np.ndarray:
    """A number per row of bytes, equal for equal rows, from 0 in order of their first places."""
    return _packed(rows).dictionary_encode().indices.to_numpy()


def _candidates(j: np.ndarray, windows: np.ndarray, width: int, neighbours: int) -> np.ndarray:
    """Of rows in order of sample, the places of those that can be among the neighbours of any cell of their variant: after so many samples with the same window
    or with nothing but the variant itself, those are as near to any cell and come first."""
    bare = np.flatnonzero((windows < 0).sum(axis=1) == 2 * width)
    ends = bare[_first_of_each(j[bare], neighbours)]
    variants, place = np.unique(j, return_inverse=True)
    n, last = np.bincount(place[ends], minlength=len(variants)), np.full(len(variants), len(j))
    full = n == neighbours
    latest = np.zeros(len(variants), dtype=np.int64)
    np.maximum.at(latest, place[ends], ends)
    last[full] = latest[full]
    some = np.flatnonzero(np.arange(len(j)) <= last[place])
    return some[_first_of_each(_codes(np.hstack([windows[some].view(np.uint8), place[some].astype(np.int64)[:, None].view(np.uint8)])), neighbours)]


class _Votes:
    """Votes on missing cells of one variant, by their windows, from candidates that come in order of sample: each window holds the distances and dosages of its
    nearest so far, and is done when all of them are at distance zero. Differences are counted by products of indicator matrices, PAIRS at a time."""

    def __init__(self, windows: np.ndarray, width: int, neighbours: int):
        self.codes = _codes(windows)
        self.windows, self.width, self.k = windows[np.unique(self.codes, return_index=True)[1]], width, neighbours
        self.distance = np.full((len(self.windows), neighbours), np.iinfo(np.int32).max, dtype=np.int32)
        self.dosage = np.full((len(self.windows), neighbours), -1, dtype=np.int8)
        self.open = np.arange(len(self.windows))

    def meet(self, candidates: np.ndarray) -> None:
        values = np.unique(candidates[candidates >= 0])
        marked = lambda x: np.hstack([(x == v).astype(np.float32) for v in values])
        both, equal, theirs = (candidates >= 0).astype(np.float32).T, marked(candidates).T, candidates[:, self.width]
        step = max(1, PAIRS // len(candidates))
        for at in range(0, len(self.open), step):
            some = self.open[at : at + step]
            x = self.windows[some]
            new = np.rint((x >= 0).astype(np.float32) @ both - marked(x) @ equal).astype(np.int64)
            # earlier candidates have smaller samples: place in the row breaks ties
            key = np.hstack([self.distance[some], new]) * (self.k + len(candidates)) + np.arange(self.k + len(candidates))
            best = np.sort(np.argpartition(key, self.k - 1, axis=1)[:, : self.k], axis=1)
            dosage = np.hstack([self.dosage[some], np.broadcast_to(theirs, new.shape)])
            self.distance[some] = np.take_along_axis(key, best, axis=1) // (self.k + len(candidates))
            self.dosage[some] = np.take_along_axis(dosage, best, axis=1)
        self.open = self.open[self.distance[self.open].max(axis=1) > 0]

    def result(self) -> np.ndarray:
        """The most frequent dosage of each cell's nearest, the least of several; -1 without any."""
        values = np.unique(self.dosage[self.dosage >= 0])
        if not len(values):
            return np.full(len(self.codes), -1)
        n = np.stack([(self.dosage == v).sum(axis=1) for v in values], axis=1)
        return np.where(n.max(axis=1) > 0, values[np.argmax(n, axis=1)], -1)[self.codes]


def neighbour_windows(cells: DataFrame, width: int, neighbours: int) -> DataFrame:
    """j, known, s, window of the cells (s, j, d) that are missing and of those observed ones that can be a neighbour: the dosages of sample s over the variants
    from j - width to j + width, one byte each (-1: missing)."""
    # variants near 0 are in the middle of a block
    first, last = (F.floor((F.col("j") + BLOCK // 2 + k) / BLOCK).cast("long") for k in (-width, width))
    dealt = cells.withColumn("block", F.explode(F.sequence(first, last))).repartition("s", "block").sortWithinPartitions(F.col("s").asc_nulls_last(), "block", "j")
    kind, size = dict(cells.dtypes)["s"], 2 * width + 1

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, seen = [], 0, 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                fresh += len(batch)
                if fresh * size < WINDOW_BYTES:
                    continue
            elif not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            if not len(table):
                continue
            who = table.column("s").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            j, block = table.column("j").to_numpy(), table.column("block").to_numpy()
            part = np.cumsum(np.r_[False, (np.diff(who) != 0) | (np.diff(block) != 0)])
            d = table.column("d").fill_null(-1).to_numpy()
            windows = _windows(part, j, d, width)
            # windows of the last sample that rows to come belong to wait, with the rows they see
            wait, keep = (len(j), len(j)) if batch is None else (int(np.argmax((part == part[-1]) & (j >= j[-1] - k * width))) for k in (1, 2))
            own = np.arange(seen, wait)
            own = own[(j[own] + BLOCK // 2) // BLOCK == block[own]]
            known = own[d[own] >= 0]
            missing = own[d[own] < 0]
            known = known[_candidates(j[known], windows[known], width, neighbours)]
            both = np.r_[missing, known]
            columns = [pa.array(j[both]), pa.array(d[both] >= 0), table.column("s").take(pa.array(both)).combine_chunks(), _packed(windows[both])]
            yield pa.RecordBatch.from_arrays(columns, names=["j", "known", "s", "window"])
            held, fresh, seen = table.slice(keep).to_batches(), 0, wait - keep

    return dealt.mapInArrow(see, f"j long, known boolean, s {kind}, window binary")


def knn_dosage(long: DataFrame, sample: str = "sample", variant: str = "variant", dosage: str = "dosage", width: int = 5, neighbours: int = 5) -> DataFrame:
    """sample, variant, dosage with missing cells (null, NaN, -1) filled by the vote of the nearest samples.

    Neighbours of a cell are the samples in which its variant is observed; their distance is the number of differing
    dosages over the variants within width that both have; ties of distance go to the smaller sample id, ties of votes to the
    smaller dosage. variant is an integer position. Cells without any candidate stay null.

    A cell's neighbours depend on its window only: the dosages of its sample over the variants within width. Windows are read off cells in order of sample and
    variant (of BLOCK variants at a time, with width more on either side). Missing cells, and those observed ones that can be a neighbour at all, go to their
    variant: equal windows count once, and a window is done when its nearest are at distance zero, as none that follow come before them. A task
    holds the missing cells of one variant, while candidates stream past in order of sample; no pairs of samples are ever rows.
    """
    v = F.col(dosage).cast("double")
    d = F.when(~F.isnan(v), v).cast("int")
    cells = long.select(F.col(sample).alias("s"), F.col(variant).cast("long").alias("j"), F.when(d >= 0, d).alias("d"))
    kind, size = dict(cells.dtypes)["s"], 2 * width + 1

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing, votes, met, at = [], None, Counter(), FIRST_MET

        def begin() -> _Votes:
            return _Votes(_unpacked(pa.chunked_array([m.column("window") for m in missing]).combine_chunks(), size), width, neighbours)

        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False)
            n = int(len(known) - known.sum())
            if known[:n].any() or n and votes:
                raise RuntimeError("candidates came before missing cells")
            if n:
                missing.append(batch.slice(0, n))
            if not missing or n == len(known):
                continue
            votes = votes or begin()
            rest = batch.slice(n).column("window")
            while len(rest) and len(votes.open):
                some, rest, at = rest.slice(0, at), rest.slice(at), min(2 * at, MET)
                texts = some.to_pylist()
                fresh = []
                for k, text in enumerate(texts):
                    if met[text] < neighbours:
                        fresh.append(k)
                        if text in met or len(met) < REMEMBERED:
                            met[text] += 1
                if fresh:
                    votes.meet(_unpacked(some, size)[fresh])
        if missing:
            votes = votes or begin()
            filled = votes.result()
            s, j = (pa.chunked_array([m.column(c) for m in missing]).combine_chunks() for c in ("s", "j"))
            yield pa.RecordBatch.from_arrays([s, j, pa.array(filled, pa.int32(), mask=filled < 0)], names=["s", "j", "d"])

    seen = neighbour_windows(cells, width, neighbours)
    voted = seen.repartition("j").sortWithinPartitions("j", "known", F.col("s").asc_nulls_last()).groupBy("j").applyInArrow(vote, f"s {kind}, j long, d int")
    out = cells.where("d is not null or j is null").unionByName(voted)
    return out.select(F.col("s").alias(sample), F.col("j").alias(variant), F.col("d").alias(dosage))


def soft_impute(x: np.ndarray, shrinkage: float, iterations: int = 100, tolerance: float = 1e-3, max_rank: int | None = None) -> np.ndarray:
    """Missing cells by iterated soft-thresholding of singular values, until they change by less than tolerance relatively."""
    gaps = np.isnan(x)
    out = np.where(gaps, 0.0, x)
    for _ in range(iterations):
        u, s, vt = np.linalg.svd(out, full_matrices=False)
        s = np.maximum(s - shrinkage, 0)
        if max_rank:
            s[max_rank:] = 0
        new = (u * s) @ vt
        step, size = np.linalg.norm(new[gaps] - out[gaps]), np.linalg.norm(out[gaps])
        out[gaps] = new[gaps]
        if step <= tolerance * max(size, 1e-12):
            break
    return out


def soft_impute_cv(x: np.ndarray, strengths: int = 10, folds: int = 3, held_out: float = 0.05, seed: int = 2021) -> tuple[np.ndarray, float]:
    """soft_impute() at the strength in 10^[-2, 2] that explains most variance of held-out cells on average; ties go to the smallest."""
    rng = np.random.default_rng(seed)
    grid = np.logspace(-2, 2, strengths)
    scores = np.zeros((strengths, folds))
    for i, strength in enumerate(grid):
        for j in range(folds):
            mask = (rng.random(x.shape) < held_out) & ~np.isnan(x)
            if not mask.any():
                continue
            guess = soft_impute(np.where(mask, np.nan, x), strength)[mask]
            scores[i, j] = 1 - np.mean((x[mask] - guess) ** 2) / max(np.var(x[mask]), 1e-300)
    best = float(grid[int(np.argmax(scores.mean(axis=1)))])
    return soft_impute(x, best), best


def nuclear_norm(x: np.ndarray, tolerance: float = 1e-3, rounds: int = 500, symmetric: bool = False) -> np.ndarray:
    """Least nuclear norm among matrices within tolerance of the observed cells, by proximal steps with a falling threshold."""
    gaps = np.isnan(x)
    known = np.where(gaps, 0.0, x)
    out, level = known.copy(), np.linalg.norm(known, 2)
    for _ in range(rounds):
        level = max(level * 0.95, tolerance)
        u, s, vt = np.linalg.svd(out, full_matrices=False)
        new = (u * np.maximum(s - level, 0)) @ vt
        if symmetric:
            new = (new + new.T) / 2
        new = np.where(gaps, new, np.clip(new, known - tolerance, known + tolerance))
        done = level <= tolerance and np.linalg.norm(new - out) <= 1e-6 * max(1.0, np.linalg.norm(out))
        out = new
        if done:
            break
    return out


SOLVERS = {"soft": lambda x: soft_impute(x, 1.0), "soft_cv": lambda x: soft_impute_cv(x)[0], "nuclear": nuclear_norm}


def complete_groups(wide: DataFrame, group: str, row_id: str, columns: list[str], solver: str = "soft") -> DataFrame:
    """Each group's matrix (rows by row_id) completed by a solver; groups run in parallel, one matrix in memory per task."""
    solve = SOLVERS[solver]
    kinds = dict(wide.dtypes)
    schema = ", ".join([f"`{group}` {kinds[group]}", f"`{row_id}` {kinds[row_id]}", *(f"`{c}` double" for c in columns)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id)
        out = pdf[[group, row_id]].copy()
        out[columns] = solve(pdf[columns].to_numpy(dtype=float))
        return out

    return wide.select(group, row_id, *[F.col(f"`{c}`") for c in columns]).groupBy(group).applyInPandas(run, schema)
