"""ADAT text files as a data source: the head is read once for the plan, the samples in byte ranges, in parallel.

spark.read.format("adat").load(path) after register(): row_id (the file's number and where the sample's line begins, so it orders the samples whatever the
ranges), the sample fields as text, and rfu, an array of doubles in the order of the analytes. A schema given to the reader names the columns that are wanted,
and no others are parsed. Option split_bytes: size of a range. Paths are anything that pyarrow's file systems open, a file or a folder of files that have the
same sample fields and analytes; compressed files have no byte ranges and are refused (proteomics.read_adat() reads them). write_adat() writes such a folder.
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.sources.proteomics import SomascanDataset

#: Bytes of a range, samples of a batch, and the bits of row_id that hold the place in a file.
SPLIT_BYTES, BATCH_ROWS, PLACE_BITS = 64 << 20, 256, 44
#: Most analytes that write_adat() takes: their fields stand in the head of every file.
MOST_ANALYTES = 100_000


@dataclass
class Head:
    """names: sample fields. gap: the cell that holds an analyte field's name; values stand right of it. fields: analyte fields, each with its values.
    begin, end: where samples begin and the file ends."""

    names: list[str]
    gap: int
    fields: list[tuple[str, list[str]]]
    begin: int
    end: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of a folder's files by name, empty and hidden ones and those that start with _ left out; a file is the only one of its list."""
    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [(path, info.size)]
    found = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._"]
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(found, key=lambda f: f.base_name)]


def _first_head(path: str) -> Head:
    files = list_files(path)
    if not files:
        raise ValueError(f"no files in {path}")
    return read_head(files[0][0])


def _open(path: str, at: int) -> tuple[io.BufferedReader, int]:
    system, inner = _system(path)
    file = system.open_input_file(inner)
    size = file.size()
    file.seek(at)
    return io.BufferedReader(file, 1 << 20), size


def _cells(line: bytes) -> list[str]:
    return line.decode().rstrip("\r\n").split("\t")


def read_head(path: str) -> Head:
    """The lines up to the names of the sample fields; ValueError on a file without them."""
    if path.endswith((".gz", ".bz2", ".zst")):
        raise ValueError("a compressed file has no byte ranges")
    lines, size = _open(path, 0)
    at, inside, analytes = 0, False, []
    with lines:
        for line in lines:
            at += len(line)
            cells = _cells(line)
            if not inside:
                inside = cells[0].startswith("^TABLE_BEGIN")
            elif cells[0]:
                gap = next((i for i, c in enumerate(analytes[0]) if c), 0) if analytes else len(cells)
                return Head([c for c in cells if c], gap, [(a[gap], a[gap + 1 :]) for a in analytes], at, size)
            elif line.strip():
                analytes.append(cells)
    raise ValueError("no table of samples in the file")


@dataclass
class Range(InputPartition):
    path: str
    number: int
    begin: int
    end: int


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


class AdatReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, schema: T.StructType):
        self.path, self.split_bytes, self.schema, self.head = path, split_bytes, schema, _first_head(path)

    def partitions(self) -> list[Range]:
        """Ranges by the files' sizes; where samples begin is found by the tasks, so the driver opens one file whatever their number."""
        step = self.split_bytes
        return [Range(path, k, at, min(at + step, size)) for k, (path, size) in enumerate(list_files(self.path)) for at in range(0, max(size, 1), step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Samples whose line begins in the range."""
        head, names = read_head(part.path), self.schema.names
        if (head.names, head.gap, head.fields) != (self.head.names, self.head.gap, self.head.fields):
            raise ValueError(f"{part.path} has other sample fields or analytes than the first file of its folder")
        kinds = [pa.int64() if c == "row_id" else pa.list_(pa.float64()) if c == "rfu" else pa.string() for c in names]
        places = {c: k for k, c in enumerate(head.names)}
        rows: list[list] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
        at = head.begin if part.begin <= head.begin else part.begin - 1
        lines, _ = _open(part.path, at)
        with lines:
            if part.begin > head.begin:
                at += len(lines.readline())
            while at < part.end and (line := lines.readline()):
                if line.strip():
                    cells = _cells(line)
                    value = lambda c: (part.number << PLACE_BITS) + at if c == "row_id" else [_number(v) for v in cells[head.gap + 1 :]] if c == "rfu" else cells[places[c]] if places[c] < len(cells) else None  # noqa: B023, E731
                    rows.append([value(c) for c in names])
                at += len(line)
                if len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


class AdatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "adat"

    def schema(self) -> T.StructType:
        names = _first_head(self.options["path"]).names
        return T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in names), T.StructField("rfu", T.ArrayType(T.DoubleType()))])

    def reader(self, schema: T.StructType) -> AdatReader:
        return AdatReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AdatSource)


def read_adat_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> SomascanDataset:
    """The three tables of proteomics.read_adat() from byte ranges; samples and values read only their own columns."""
    register(spark)
    head = _first_head(path)
    read = lambda schema: spark.read.format("adat").option("split_bytes", split_bytes).schema(schema).load(path)
    samples = read(T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in head.names)]))
    values = read(T.StructType([T.StructField("row_id", T.LongType()), T.StructField("rfu", T.ArrayType(T.DoubleType()))]))
    rfu = values.select("row_id", F.posexplode("rfu").alias("column_id", "RFU"))
    rows = [(j, *(v[j] if j < len(v) else None for _, v in head.fields)) for j in range(max((len(v) for _, v in head.fields), default=0))]
    analytes = spark.createDataFrame(rows, T.StructType([T.StructField("column_id", T.IntegerType()), *(T.StructField(f, T.StringType()) for f, _ in head.fields)]))
    return SomascanDataset(samples, analytes, rfu)


def _text(c: Column) -> Column:
    """A field as ADAT holds it: null is empty, tabs and line breaks are spaces."""
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), "\t\r\n", "   ")


def write_adat(dataset: SomascanDataset, path: str) -> None:
    """The dataset as a folder of ADAT files, one per partition of the samples, each with the whole head, so that no file passes through one task alone.

    Analytes are the columns, in the order of column_id; a value that is null or absent is NA, and of repeated ones the largest stays. Samples without
    values have NA everywhere; values without a sample or an analyte go. Null fields are empty, and tabs and line breaks in fields are spaces, as the
    format has no other way. ValueError without sample fields, or with more than MOST_ANALYTES analytes.
    """
    samples, analytes = dataset.samples, dataset.analytes
    names, fields = [c for c in samples.columns if c != "row_id"], [c for c in analytes.columns if c != "column_id"]
    if not names or not fields:
        raise ValueError("samples and analytes need a field each")
    columns = analytes.orderBy("column_id").select("column_id", *[_text(F.col(f"`{c}`")).alias(c) for c in fields]).limit(MOST_ANALYTES + 1).collect()
    if len(columns) > MOST_ANALYTES:
        raise ValueError(f"more than {MOST_ANALYTES} analytes")
    shift = "\t" * len(names)
    head = ["^HEADER", "^TABLE_BEGIN", *(shift + "\t".join([c, *(r[c] for r in columns)]) for c in fields), "\t".join(names) + "\t" * (1 + len(columns))]
    once = dataset.rfu.where(F.col("column_id").isNotNull()).groupBy("row_id", "column_id").agg(F.max("RFU").alias("RFU"))
    values = once.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("column_id", "RFU"))).alias("values"))
    order = F.array(*[F.lit(r["column_id"]) for r in columns]).cast(T.ArrayType(dataset.rfu.schema["column_id"].dataType))
    cells = F.transform(order, lambda k: F.coalesce(F.try_element_at("values", k).cast("string"), F.lit("NA")))
    line = F.concat(F.concat_ws("\t", *[_text(F.col(f"`{c}`")) for c in names]), F.lit("\t\t"), F.array_join(cells, "\t"))
    lines = samples.join(values, "row_id", "left").select(line.alias("value"))

    def with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in itertools.chain([pa.array(head)], (b.column(0) for b in batches)):
            yield pa.RecordBatch.from_arrays([column.cast(pa.string())], names=["value"])

    alone = samples.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1)  # a file of its own, which a dataset without samples has too
    lines.mapInArrow(with_head, "value string").union(alone).write.mode("overwrite").text(path)
