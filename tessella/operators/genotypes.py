"""Packed genotypes: blocks of variants with the places and dosages of the samples that have a genotype, against one matrix of phenotypes.

A block holds the genotypes of some variants, in one order of samples; phenotypes are kept once, in the same order, and not once
per variant. Samples without a genotype take no room, so a table's size counts and not its variants times all samples. Moments by genotype are sums over a
block's rows of the phenotypes and their products.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.operators import hypothesis
from tessella.operators.moments import Moments, of_matrix
from tessella.operators.origin import LEAST, P_VALUES, bca, effect_of
from tessella.operators.replicates import SAMPLE_BYTES, broadcast_samples

#: Genotypes to a block, and numbers of phenotypes and their products that are summed at a time.
CELLS, SUMMED = 2_000_000, 8_000_000

#: Samples whose places are broadcast for their look-up.
LOOKED_UP = 1_000_000


@dataclass
class Packed:
    """blocks: variants (array) and, by variant after variant, the number of its genotypes, their samples' places in x and their dosages (binary: 8, 4 and 1 bytes
    each); x: phenotypes by sample (samples x columns), broadcast."""

    blocks: DataFrame
    variant: T.StructField
    x: Broadcast
    p: int

    def per_block(self, schema: str, call) -> DataFrame:
        """call(variants, ends, places, dosages, x, cache) for each block as columns of schema, the variants first; cache: a dictionary that lasts for a task.
        A variant's places and dosages are those from its end in ends to the next."""
        full = T.StructType([self.variant, *T.StructType.fromDDL(schema).fields])
        arrow, shared = to_arrow_schema(full), self.x

        def run(batches):
            (x,), cache = shared.value, {}
            for batch in batches:
                for variants, *packed in zip(batch.column("variants"), *(batch.column(c).to_pylist() for c in ("sizes", "places", "dosages")), strict=True):
                    sizes, places, dosages = (np.frombuffer(b, dtype=t) for b, t in zip(packed, (np.int64, np.int32, np.int8), strict=True))
                    columns = call(variants.values, np.r_[0, np.cumsum(sizes)], places, dosages, x, cache)
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return self.blocks.mapInArrow(run, full)

    def per_variant(self, schema: str, call) -> DataFrame:
        """call(dosages, x) for each variant as columns of schema, after the variant's own, from the samples that have a genotype of it."""
        kinds = [f.type for f in to_arrow_schema(T.StructType.fromDDL(schema))]

        def block(variants, ends, places, dosages, x, cache):
            rows = [call(dosages[a:b], x if b - a == len(x) else x[places[a:b]]) for a, b in itertools.pairwise(ends)]
            return [variants, *(pa.array(list(v), kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True))]

        return self.per_block(schema, block)


def pack_genotypes(genotypes: DataFrame, samples: DataFrame, variant: str, sample: str, genotype: str, phenotypes: list[str]) -> Packed:
    """Genotypes (variant, sample, whole-numbered genotype) packed against samples (sample, phenotypes), whose rows with a missing phenotype are left out.

    Phenotypes are broadcast, SAMPLE_BYTES at most, checked before they are read (else ValueError: poirot_variants() and the other functions on rows have no such
    bound). Samples that genotypes name and samples lacks are left out; samples without a genotype count as missing; of a pair that repeats the largest genotype is taken.
    Rows are dealt and sorted by variant and packed as they stream past. A block is some CELLS rows, or those of one variant, so a task's memory doesn't depend on the number of variants.
    """
    known = samples.select(F.col(f"`{sample}`").alias("__sample"), *[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(phenotypes)])
    for k in range(len(phenotypes)):
        known = known.where(F.col(f"x{k}").isNotNull() & ~F.isnan(f"x{k}"))
    n = known.count()
    if n * len(phenotypes) * 8 > SAMPLE_BYTES:
        raise ValueError(f"{n} samples of {len(phenotypes)} phenotypes are too large to be in every task ({SAMPLE_BYTES} bytes at most)")
    table = known.orderBy("__sample").toPandas()
    places = samples.sparkSession.createDataFrame(table[["__sample"]].assign(place=np.arange(n)), T.StructType([known.schema["__sample"], T.StructField("place", T.LongType())]))
    if n <= LOOKED_UP:
        places = F.broadcast(places)
    x = broadcast_samples(samples.sparkSession, table.drop(columns="__sample").to_numpy(dtype=float))
    field = T.StructField(variant, genotypes.schema[variant].dataType)
    rows = genotypes.select(F.col(f"`{variant}`").alias("v"), F.col(f"`{sample}`").alias("__sample"), F.col(f"`{genotype}`").cast("byte").alias("g")).where("g is not null")
    # place and dosage in one number: rows move and are sorted, so their size counts
    rows = rows.join(places, "__sample").select("v", (F.col("place") * 256 + F.col("g") + 128).alias("call"))
    binary = [T.StructField(c, T.BinaryType()) for c in ("sizes", "places", "dosages")]
    kind = T.StructType([T.StructField("variants", T.ArrayType(field.dataType)), *binary])
    arrow, cells = to_arrow_schema(kind), CELLS

    def block(coded: pa.DictionaryArray, calls: np.ndarray) -> pa.RecordBatch:
        codes, place = coded.indices.to_numpy().astype(np.int64), calls >> 8
        order = np.lexsort((calls, codes))
        codes, calls, place = codes[order], calls[order], place[order]
        last = np.r_[(codes[1:] != codes[:-1]) | (place[1:] != place[:-1]), True]  # the largest of a pair's genotypes
        first = int(codes[0])
        sizes = np.bincount(codes[last] - first).astype(np.int64)
        packed = sizes, place[last].astype(np.int32), ((calls[last] & 255) - 128).astype(np.int8)
        variants = coded.dictionary.slice(first, len(sizes))
        return pa.RecordBatch.from_arrays([pa.array([variants], arrow.field(0).type), *(pa.array([c.tobytes()], pa.binary()) for c in packed)], schema=arrow)

    def pack(batches):
        held, fresh, kept = [], 0, 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                fresh += len(batch)
                if fresh < max(cells, kept):
                    continue
            table = pa.Table.from_batches(held).combine_chunks() if held else []
            if not len(table):
                continue
            coded, calls = table.column("v").combine_chunks().dictionary_encode(null_encoding="encode"), table.column("call").to_numpy()
            # the last variant's rows may go on
            cut = len(calls) if batch is None else int(np.searchsorted(coded.indices.to_numpy(), len(coded.dictionary) - 1))
            if cut:
                yield block(coded.slice(0, cut), calls[:cut])
            held, fresh, kept = table.slice(cut).to_batches(), 0, len(calls) - cut

    return Packed(rows.repartition("v").sortWithinPartitions("v").mapInArrow(pack, kind), field, x, len(phenotypes))


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns' means, and 1, the centred columns and their products side by side."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    w = x - mean
    i, j = np.triu_indices(x.shape[1])
    return mean, np.column_stack([np.ones(len(x)), w, w[:, i] * w[:, j]])


def _moments(dosages: np.ndarray, x: np.ndarray, kinds: tuple[int, ...]) -> dict[int, Moments]:
    """Moments of the samples of each genotype, by one product of masks with the phenotypes' products."""
    mean, z = _centred(x)
    p, found = x.shape[1], {}
    upper = np.triu_indices(p)
    for k, sums in zip(kinds, np.stack([dosages == k for k in kinds]).astype(float) @ z, strict=True):
        if n := round(sums[0]):
            shift, c = sums[1 : p + 1] / n, np.zeros((p, p))
            c[upper] = sums[p + 1 :]
            c = c + np.triu(c, 1).T - n * np.outer(shift, shift)
            found[k] = Moments(n, mean + shift, c)
    return found


def packed_moments(packed: Packed, kinds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """variant, genotype, n, mean and covariance (upper triangle, divisor n) of each genotype of each variant, as genotype_moments() has them on rows."""
    p = packed.p
    i, j = np.triu_indices(p)

    def call(variants, ends, places, dosages, x, cache):
        if "x" not in cache:
            cache["mean"] = x.mean(axis=0)
            cache["x"] = x - cache["mean"]
        own = np.flatnonzero(np.isin(dosages, kinds))
        groups = np.repeat(np.arange(len(variants)), np.diff(ends))[own] * 256 + dosages[own] + 128
        order = np.argsort(groups, kind="stable")
        own, groups = own[order], groups[order]
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]][: len(groups)])
        n = np.diff(np.r_[starts, len(groups)])
        mean, covariance = np.zeros((len(n), p)), np.zeros((len(n), len(i)))
        # whole groups of so many rows at a time, larger ones by themselves
        for some in np.split(np.arange(len(n)), 1 + np.flatnonzero(np.diff((starts + n) // max(1, SUMMED // (p + len(i)))))) if len(n) else ():
            a, b = starts[some[0]], starts[some[-1]] + n[some[-1]]
            w = cache["x"][places[own[a:b]]]
            at, size = starts[some] - a, n[some][:, None]
            mean[some] = np.add.reduceat(w, at, axis=0) / size
            w -= np.repeat(mean[some], n[some], axis=0)
            covariance[some] = np.add.reduceat(w[:, i] * w[:, j], at, axis=0) / size
        lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
        kind = groups[starts] % 256 - 128
        return [variants.take(pa.array(groups[starts] // 256)), pa.array(kind), pa.array(n), lists(mean + cache["mean"]), lists(covariance)]

    return packed.per_block("genotype int, n bigint, mean array<double>, covariance array<double>", call)


def packed_effects(packed: Packed, p_value: str = "rmt4ds") -> DataFrame:
    """many_variants() on packed genotypes."""

    def call(dosages: np.ndarray, x: np.ndarray) -> tuple:
        found = _moments(dosages, x, (0, 1))
        sizes = [found[k].n if k in found else 0 for k in (0, 1)]
        if min(sizes) < LEAST:
            return *sizes, None, None
        return *sizes, effect_of(found[0], found[1]).tolist(), float(P_VALUES[p_value](found[1], found[0]))

    return packed.per_variant("n_homozygotes long, n_heterozygotes long, effect array<double>, p_value double", call)


def _group_medians(dosages: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x less the medians of each sample's genotype."""
    z = x.copy()
    for k in np.unique(dosages):
        z[dosages == k] -= np.median(x[dosages == k], axis=0)
    return z


def packed_poirot(packed: Packed) -> DataFrame:
    """poirot_variants() on packed genotypes: variant, statistic, p_value (null where the two groups are too few to be compared)."""
    i, j = np.triu_indices(packed.p)

    def call(dosages: np.ndarray, x: np.ndarray) -> tuple:
        z = _group_medians(dosages, x)
        w = z[:, i] * z[:, j]
        w = np.divide(w, np.sqrt(np.abs(w)), out=np.zeros_like(w), where=w != 0)
        homo = np.isin(dosages, (0, 2))
        het = ~homo
        if min(homo.sum(), het.sum()) == 0 or homo.sum() + het.sum() <= len(i) + 1:
            return None, None
        return hypothesis.hotelling(of_matrix(w[het]), of_matrix(w[homo]))

    return packed.per_variant("statistic double, p_value double", call)


def packed_resamples(packed: Packed, permutations: int = 1000, replicates: int = 1000, alpha: float = 0.05, seed: int = 2021) -> DataFrame:
    """resampled_variants() on packed genotypes: variant, permutation_p, low, high. A permutation or a draw is a count per sample, and many of them
    together are one matrix product with the phenotypes' products."""
    p = packed.p
    upper = np.triu_indices(p)

    def drawn(weights: np.ndarray, z: np.ndarray) -> list[Moments]:
        out = []
        for sums in weights @ z:
            n, shift, c = sums[0], sums[1 : p + 1] / sums[0], np.zeros((p, p))
            c[upper] = sums[p + 1 :]
            out.append(Moments(round(n), shift, c + np.triu(c, 1).T - n * np.outer(shift, shift)))
        return out

    def products(w: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(w)), w, w[:, upper[0]] * w[:, upper[1]]])

    def call(dosages: np.ndarray, x: np.ndarray) -> tuple:
        a, b = x[dosages == 0], x[dosages == 1]
        if min(len(a), len(b)) < LEAST:
            return None, None, None
        rng, homo, effect = np.random.default_rng(seed), of_matrix(a), effect_of(of_matrix(a), of_matrix(b))
        both, mean, above = products(np.vstack([a - a.mean(axis=0), b - b.mean(axis=0)])), b.mean(axis=0), 0
        own, draws = products(b - mean), []
        step = max(1, CELLS // len(both))
        for at in range(0, permutations, step):
            labels = np.zeros((min(step, permutations - at), len(both)))
            labels[:, : len(b)] = 1
            labels = rng.permuted(labels, axis=1)
            for het, rest in zip(drawn(labels, both), drawn(1 - labels, both), strict=True):
                above += np.linalg.norm(effect_of(rest, het)) > np.linalg.norm(effect)
        for at in range(0, replicates, step):
            counts = rng.multinomial(len(b), np.full(len(b), 1 / len(b)), size=min(step, replicates - at)).astype(float)
            draws += [effect_of(homo, m) for m in drawn(counts, own)]
        draws = np.array(draws)
        draws *= np.where(draws @ effect > 0, 1, -1)[:, None]
        ends = [bca(d, e, alpha) for d, e in zip(draws.T, effect, strict=True)]
        return above / permutations, [e[0] for e in ends], [e[1] for e in ends]

    return packed.per_variant("permutation_p double, low array<double>, high array<double>", call)
