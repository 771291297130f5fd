"""Registered queries of records, dotted tracks, leaves and keys of nested annotation documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import nested, reshape
from tessella.plans.registry import query, table


def _one(c):
    return F.array(F.array(F.array(c.cast("string"))))


def _parts(spark, sf_dir):
    """Part documents: two records of names in the track refSeq, one deduplicated brand, a sub-track, and an unsupported one."""
    p = table(spark, sf_dir, "part")
    track = F.struct(
        F.array(F.array(F.array(F.col("p_name"), F.col("p_type")), F.array(F.col("p_container") if "p_container" in p.columns else F.col("p_type")))).alias("name"),
        _one(F.col("p_brand")).alias("name2"),
        F.struct(_one(F.col("p_size")).alias("score")).alias("nearest"),
        F.struct(_one(F.lit("never")).alias("name")).alias("clinvar"),
    )
    hets = F.when(F.col("p_size") % 3 > 0, F.array(F.array(F.transform(F.sequence(F.lit(1), F.col("p_size") % 3), lambda k: F.concat(F.lit("s"), k)))))
    return p.select(_one(F.col("p_partkey")).alias("pos"), _one(F.lit("A")).alias("alt"), _one(F.lit("G")).alias("inputRef"), _one(F.lit("chr1")).alias("chrom"), _one(F.col("p_retailprice")).alias("price"), hets.alias("heterozygotes"), track.alias("refSeq"))


def _arity_sql() -> str:
    first = "p_name || '+' || p_type"
    both = [(kind, 2, f"{first} || '|' || p_type", "p_brand || '|' || p_brand") for kind in ("key", "keyless")] + [(kind, 1, f"{first} || '+' || p_type", "p_brand") for kind in ("short", "absent")]
    return " UNION ALL ".join(f"SELECT p_partkey AS pos, '{kind}' AS kind, {n} AS n_records, {names} AS names, {genes} AS genes FROM part" for kind, n, names, genes in both)


@query(_arity_sql())
def record_arity(spark, sf_dir):
    """Records by the key's list, by the longest list without a key, one by a key with one entry or one that is absent; a single record takes all entries,
    and one entry stands for all records."""
    docs = _parts(spark, sf_dir)
    docs = docs.withColumn("refSeq", F.col("refSeq").withField("name", F.transform("refSeq.name", lambda at: F.array(at[0], F.array(F.get(at[0], F.lit(1)))))))
    read = lambda records: F.array_join(F.transform(F.col(f"`{records}`"), lambda v: F.array_join(v, "+")), "|")
    out = None
    for kind, keys in (("key", {"refSeq": "name"}), ("keyless", {}), ("short", {"refSeq": "name2"}), ("absent", {"refSeq": "other"})):
        rows = nested.normalise(docs, keys).select("pos", F.lit(kind).alias("kind"), F.size("`refSeq.name`").alias("n_records"), read("refSeq.name").alias("names"), read("refSeq.name2").alias("genes"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT p_partkey AS pos, array_to_string([CAST(p_retailprice AS VARCHAR)], ',') AS price, CASE p_size % 3 WHEN 1 THEN 's1' WHEN 2 THEN 's1,s2' END AS carriers FROM part""")
def keyless_leaves(spark, sf_dir):
    """Fields without a track as flat lists of values; a field that is null stays so."""
    rows = nested.normalise(_parts(spark, sf_dir))
    return rows.select("pos", F.array_join("price", ",").alias("price"), F.array_join("heterozygotes", ",").alias("carriers"))


@query("""SELECT p_partkey AS pos, 'alt,chrom,heterozygotes,inputRef,locus,pos,price,refSeq.name,refSeq.name2,refSeq.nearest.score' AS fields, CAST(p_size AS VARCHAR) AS score, p_brand AS name2 FROM part""")
def dotted_tracks(spark, sf_dir):
    """Sub-tracks are columns of their own by dotted name, outside their parents; unsupported tracks are left out."""
    rows = nested.normalise(_parts(spark, sf_dir), {})
    value = lambda c: F.get(F.get(F.col(f"`{c}`"), F.lit(0)), F.lit(0))
    return rows.select("pos", F.lit(",".join(sorted(rows.columns))).alias("fields"), value("refSeq.nearest.score").alias("score"), value("refSeq.name2").alias("name2"))


@query("""SELECT p_partkey AS pos, 'alt,chrom,inputRef,pos,refSeq.nearest.score' AS plain, 'alt,chrom,heterozygotes,inputRef,pos,refSeq.nearest.score' AS melted FROM part""")
def included_fields(spark, sf_dir):
    """What is read for one field: identity fields, carriers only where samples are melted, and that field."""
    docs = _parts(spark, sf_dir)
    leaves = lambda df: ",".join(sorted(f"{t}.{f}".lstrip(".") for t, fields in nested.tracks(df.schema).items() for f in fields))
    plain, melted = (nested.include(docs, ["refSeq.nearest.score"], melt) for melt in (False, True))
    rows = nested.normalise(melted)
    return rows.select("pos", F.lit(leaves(plain)).alias("plain"), F.lit(leaves(melted)).alias("melted"))


@query("SELECT p_partkey, unnest([0, 1, 2, 3]) AS place, unnest(['id', 'Brand', 'price', 'size']) AS key, unnest([CAST(p_partkey AS VARCHAR), p_brand, p_type, p_name]) AS value FROM part")
def key_order(spark, sf_dir):
    """Keys without regard to case, id first, alt left out."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_name").alias("size"), F.col("p_type").alias("price"), F.lit("A").alias("alt"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("Brand")).alias("t"))
    pairs = part.select("p_partkey", F.posexplode(nested.key_value_lists(part, "t", ("t.id",))).alias("place", "pair"))
    return pairs.select("p_partkey", "place", F.col("pair")[0].alias("key"), F.col("pair")[1].alias("value"))


@query("""SELECT s_suppkey, unnest(['n_name', 'n_regionkey', 'r_name']) AS field, unnest([n_name, CAST(n_regionkey AS VARCHAR), r_name]) AS value FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def new_columns(spark, sf_dir):
    """The columns that a join brought, told by their names, as field and value."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), "s_name")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    both = s.join(n, "n_nationkey").join(r, "n_regionkey")
    found = reshape.column_difference(both, s.columns)
    return both.unpivot(["s_suppkey"], [F.col(c).cast("string").alias(c) for c in found], "field", "value")
