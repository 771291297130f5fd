"""Annotation documents to rows: positions, records, dotted columns, carriers, exploded fields.

A document keeps every value as a list of positions of a list of records of a list of values, one such list per field; fields
of one track are a struct. Results have a static schema: identity fields are scalars, other fields without a track are
lists of values, and fields of tracks are lists of records of lists of values, whatever the counts in a row are.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the data model.
IDENTITY = ("chrom", "pos", "vcfPos", "inputRef", "alt", "type", "id")
LONGS = ("pos", "vcfPos")
CARRIERS = (("heterozygotes", 1), ("homozygotes", 2), ("missingGenos", -1))
PRIMARY_KEYS = {"gnomad.genomes": "id", "gnomad.exomes": "id", "clinvarVcf": "id", "dbSNP": "id", "nearestTss.refSeq": "name", "nearest.refSeq": "name", "refSeq": "name"}
UNSUPPORTED = ("refSeq.clinvar",)
LONGEST_DELETION = 32
NUMBER = r"^\s*[-+]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][-+]?\d+)?\s*$"


def looks_like_number(value: Column) -> Column:
    """Whether a string is written as a decimal number; '3d' and '0x1' are not, '1_0' is."""
    return F.coalesce(value.rlike(NUMBER), F.lit(False))


def n_positions(alt: Column) -> Column:
    """Rows that an allele stands for: -n is a deletion of n bases, 32 at most; two letters or more are an insertion, of 2."""
    number = F.regexp_replace(alt, "_", "").try_cast("double")
    return F.when(looks_like_number(alt), F.least(F.abs(number), F.lit(LONGEST_DELETION)).cast("int")).when(F.length(alt) >= 2, 2).otherwise(1)


def broadcast_or_index(values: Column, at: Column) -> Column:
    """The element at a place; a list of one element stands for all places."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.get(values, at))


def _depth(kind: T.DataType) -> int:
    return 1 + _depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def tracks(schema: T.StructType, at: str = "") -> dict[str, list[str]]:
    """Dotted name of every struct with list-valued leaves, and those leaves; '' holds the leaves of the document itself."""
    out: dict[str, list[str]] = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out |= tracks(f.dataType, f"{at}.{f.name}" if at else f.name)
        else:
            out.setdefault(at, []).append(f.name)
    return {k: v for k, v in out.items() if k not in UNSUPPORTED}


def _ref(track: str, field: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in [*(track.split(".") if track else []), field]))


def records(at_position: dict[str, Column], key: str | None) -> Column:
    """Records of one position as a list of structs of value lists.

    Their number is the length of the key's list; without a key, of the longest list; with a key that was not selected or is
    null, one. A field that has one entry for several records was deduplicated and stands for all; a single record
    takes all entries of each field.
    """
    lists = list(at_position.values())
    if key is None:
        count = F.greatest(*[F.coalesce(F.size(x), F.lit(0)) for x in lists]) if len(lists) > 1 else F.coalesce(F.size(lists[0]), F.lit(0))
    elif key in at_position:
        count = F.when(at_position[key].isNull(), 1).otherwise(F.size(at_position[key]))
    else:
        count = F.lit(1)

    def record(i: Column) -> Column:
        return F.struct(*[F.when(count == 1, F.flatten(x)).otherwise(broadcast_or_index(x, i)).alias(name) for name, x in at_position.items()])

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), record)).otherwise(F.array())


def field_lists(structs: Column, field: str) -> Column:
    """One field of each struct of a list."""
    return F.transform(structs, lambda s: s[field])


def with_dosage(samples: Column, dosage: int) -> Column:
    return F.transform(samples, lambda s: F.struct(s.cast("string").alias("sample"), F.lit(dosage).cast("byte").alias("dosage")))


def normalise(docs: DataFrame, primary_keys: dict[str, str] | None = None) -> DataFrame:
    """One row per position of each document.

    Identity fields become scalars (pos, vcfPos: long), locus = chrom:pos:inputRef:alt (a null part reads None), other
    fields without a track lists of values, and every field of a track a column track.field of one list of values per
    record. The only row-multiplying step is one explode of a sequence; there is no shuffle.
    """
    keys = PRIMARY_KEYS if primary_keys is None else primary_keys
    found = tracks(docs.schema)
    alt = F.get(F.get(F.get(_ref("", "alt"), F.lit(0)), F.lit(0)), F.lit(0))
    rows = docs.withColumn("__at", F.explode(F.sequence(F.lit(0), n_positions(alt) - 1)))
    at = F.col("__at")
    plain, structs = [], []
    for field in found.get("", []):
        values = F.flatten(broadcast_or_index(_ref("", field), at))
        plain.append((F.get(values, F.lit(0)).cast("long" if field in LONGS else "string") if field in IDENTITY else values).alias(field))
    for track in (t for t in found if t):
        # named apart from the document's columns: a track's alias would hide its sub-tracks from the expressions after it
        structs.append(records({f: broadcast_or_index(_ref(track, f), at) for f in found[track]}, keys.get(track)).alias(f"__{track}"))
    flat = rows.select(*plain, *structs)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    columns = [F.col(f"`{f}`") for f in found.get("", [])]
    for track in (t for t in found if t):
        columns += [field_lists(F.col(f"`__{track}`"), f).alias(f"{track}.{f}") for f in found[track]]
    return flat.select(*columns, F.concat_ws(":", *(part(c) for c in ("chrom", "pos", "inputRef", "alt"))).alias("locus"))


def melt_samples(rows: DataFrame) -> DataFrame:
    """One row per carrier: sample (string) and dosage (byte) instead of the three lists of samples; null samples and rows
    without carriers go. All three lists are exploded as one, in a single pass."""
    present = [(c, d) for c, d in CARRIERS if c in rows.columns]
    pairs = [with_dosage(F.coalesce(F.col(c), F.array().cast("array<string>")), d) for c, d in present]
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in dict(CARRIERS)]
    return rows.select(*rest, F.inline(F.filter(F.concat(*pairs), lambda p: p["sample"].isNotNull())))


def explode_field(rows: DataFrame, field: str, flatten: bool = True) -> DataFrame:
    """One row per record of a track's field; the track's other fields go along, each with its list of values of that record.

    With flatten, each value of the record's list is a row of its own and the field a scalar. A null list keeps its row,
    with nulls; an empty one drops it.
    """
    if field not in rows.columns:
        raise ValueError(f"explode_field is {field!r}, but the fields are {rows.columns}")
    track = field.rpartition(".")[0]
    kin = [c for c in rows.columns if c != field and track and c.rpartition(".")[0] == track]
    own = F.col(f"`{field}`")
    places = F.when(own.isNull(), F.array(F.lit(-1))).when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1)).otherwise(F.array().cast("array<int>"))
    out = rows.withColumn("__at", F.explode(places))
    pick = lambda c: F.when(F.col("__at") >= 0, F.get(F.col(f"`{c}`"), F.col("__at"))).alias(c)
    out = out.select(*[pick(c) if c == field or c in kin else F.col(f"`{c}`") for c in rows.columns])
    if flatten and isinstance(dict((f.name, f.dataType) for f in out.schema.fields)[field], T.ArrayType):
        value = F.when(own.isNull(), F.array(F.lit(None).cast("string"))).otherwise(own)
        out = out.select(*[F.explode(value).alias(c) if c == field else F.col(f"`{c}`") for c in out.columns])
    return out


def explode_rows_with_list(rows: DataFrame, column: str) -> DataFrame:
    """List values to one row each; an empty list drops its row, a null keeps it."""
    c = F.col(f"`{column}`")
    if not isinstance(rows.schema[column].dataType, T.ArrayType):
        return rows
    kind = rows.schema[column].dataType.elementType.simpleString()
    return rows.withColumn(column, F.explode(F.when(c.isNull(), F.array(F.lit(None).cast(kind))).otherwise(c)))


def struct_of_arrays(df: DataFrame, column: str) -> DataFrame:
    """A list of structs to one list per field, named column.field."""
    fields = df.schema[column].dataType.elementType.fieldNames()
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*rest, *[field_lists(F.col(f"`{column}`"), f).alias(f"{column}.{f}") for f in fields])


def flatten_list(values: Column, depth: int) -> Column:
    """A list nested depth deep to a plain list; depth 0 wraps a scalar."""
    if depth == 0:
        return F.array(values)
    for _ in range(depth - 1):
        values = F.flatten(values)
    return values


def sorted_keys(keys: list[str], drop_alt: bool = False) -> list[str]:
    """Keys in case-insensitive order, id first."""
    rest = sorted((k for k in keys if k != "id" and not (drop_alt and k == "alt")), key=str.lower)
    return (["id"] if "id" in keys else []) + rest


def key_value_lists(df: DataFrame, column: str, lexical: tuple[str, ...] = ()) -> Column:
    """A struct as a list of [key, value] string pairs in the order of sorted_keys(); values that look like numbers are rounded to
    4 decimals unless the key is lexical."""
    fields = {f.name: f.dataType for f in df.schema[column].dataType.fields}
    pairs = []
    for k in sorted_keys(list(fields), drop_alt=True):
        value = F.col(f"`{column}`.`{k}`")
        text = value.cast("string")
        if f"{column}.{k}" not in lexical:
            text = F.when(looks_like_number(text), F.bround(F.regexp_replace(text, "_", "").try_cast("double"), 4).cast("string")).otherwise(text)
        pairs.append(F.array(F.lit(k), text))
    return F.array(*pairs)


def project(rows: DataFrame, fields: list[str] | None) -> DataFrame:
    """Identity fields, locus, sample and dosage first; then the fields asked for that exist, in that order, or all others by name. Fields
    that are asked for and don't exist are left out with a warning."""
    missing = [f for f in dict.fromkeys(fields or ()) if f not in rows.columns]
    if missing:
        warnings.warn(f"fields that the rows don't have: {missing}", stacklevel=2)
    first = [c for c in (*IDENTITY, "locus", "sample", "dosage") if c in rows.columns]
    rest = [f for f in dict.fromkeys(fields) if f in rows.columns and f not in first] if fields is not None else sorted(c for c in rows.columns if c not in first)
    return rows.select(*[F.col(f"`{c}`") for c in first + rest])


def check_options(fields: list[str] | None, exploded: str | None, structs_of_arrays: bool = True) -> None:
    if exploded is not None and fields is not None and exploded not in fields:
        raise ValueError(f"explode_field {exploded!r} must be one of the fields {fields}")
    if not structs_of_arrays and (exploded is not None or fields is not None):
        raise ValueError("explode_field and fields need structs_of_arrays")


def include(docs: DataFrame, fields: list[str], melt: bool) -> DataFrame:
    """docs with the identity fields, carriers if melting, and the fields asked for: what the scan has to read."""
    wanted = [*IDENTITY, *(dict(CARRIERS) if melt else ()), *fields]

    def keep(schema: T.StructType, at: str, ref: str) -> list[Column]:
        out = []
        for f in schema.fields:
            name, path = f"{at}.{f.name}" if at else f.name, f"{ref}.`{f.name}`" if ref else f"`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                inner = keep(f.dataType, name, path)
                out += [F.struct(*inner).alias(f.name)] if inner else []
            elif name in wanted:
                out.append(F.col(path).alias(f.name))
        return out

    return docs.select(*keep(docs.schema, "", ""))


def query_annotations(
    docs: DataFrame,
    query: str = "*",
    fields: list[str] | None = None,
    melt: bool = True,
    exploded: str | None = None,
    flatten: bool = True,
    primary_keys: dict[str, str] | None = None,
) -> DataFrame:
    """Documents that match a query string, as rows: filter, positions, carriers, exploded field, projection; one lazy plan.

    With fields, other ones are not read; a track whose key is not among them has one record per position.
    """
    from tessella.operators.querystring import compile_query

    check_options(fields, exploded)
    found = docs.where(compile_query(query, docs.schema))
    if fields is not None:
        found = include(found, fields, melt)
    rows = normalise(found, primary_keys)
    if melt:
        rows = melt_samples(rows)
    if exploded is not None:
        rows = explode_field(rows, exploded, flatten)
    return project(rows, fields)
