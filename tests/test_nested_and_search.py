import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.operators import joins, nested, querystring
from tessella.sources.proteomics import prepare_tmt

LEAF = "array<array<array<string>>>"
SCHEMA = (
    ", ".join(f"{f} {LEAF}" for f in (*nested.IDENTITY, "heterozygotes", "homozygotes", "missingGenos", "ref"))
    + f", refSeq struct<name:{LEAF},name2:{LEAF},siteType:{LEAF},clinvar:struct<x:{LEAF}>>, nearestTss struct<refSeq:struct<name2:{LEAF},dist:{LEAF}>>, gnomad struct<exomes:struct<id:{LEAF},AF:{LEAF}>>"
)
NONE = [[[None]]]


def one(v):
    return [[[v]]]


def doc(alt="A", pos="100", het=None, hom=None, miss=None, ref_seq=None, positions=1, **extra):
    base = {"chrom": one("chr1"), "pos": one(pos), "vcfPos": one(pos), "inputRef": one("G"), "alt": one(alt), "type": one("SNP"), "id": one("rs1"), "ref": one("G")}
    base |= {"heterozygotes": [[het]] if het else NONE, "homozygotes": [[hom]] if hom else NONE, "missingGenos": [[miss]] if miss else NONE}
    base |= {"refSeq": ref_seq or {"name": NONE, "name2": NONE, "siteType": NONE}, "nearestTss": {"refSeq": {"name2": NONE, "dist": NONE}}, "gnomad": {"exomes": {"id": NONE, "AF": NONE}}}
    return base | extra


def docs_of(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", SCHEMA).alias("d")).select("d.*")


@pytest.mark.parametrize(("alt", "n"), [("A", 1), ("-3", 3), ("-40", 32), ("+AC", 2), ("AC", 2), ("-1", 1), ("3d", 2), ("1_0", 10)])
def test_positions(spark, alt, n):
    rows = nested.normalise(docs_of(spark, [doc(alt)])).collect()
    assert len(rows) == n and {r.alt for r in rows} == {alt} and rows[0].locus == f"chr1:100:G:{alt}" and rows[0].pos == 100


def test_values_of_positions_are_indexed_or_broadcast(spark):
    d = doc("-3") | {"pos": [[["100"]], [["101"]], [["102"]]]}
    rows = nested.normalise(docs_of(spark, [d])).collect()
    assert sorted(r.pos for r in rows) == [100, 101, 102] and {r.id for r in rows} == {"rs1"}


def test_records_follow_the_key_and_deduplicated_fields_repeat(spark):
    seq = {"name": [[["NM1"], ["NM2"]]], "name2": [[["GENE"]]], "siteType": [[["exonic"], ["intronic", "splice"]]]}
    r = nested.normalise(docs_of(spark, [doc(ref_seq=seq)])).collect()[0].asDict()
    assert r["refSeq.name"] == [["NM1"], ["NM2"]] and r["refSeq.name2"] == [["GENE"], ["GENE"]] and r["refSeq.siteType"] == [["exonic"], ["intronic", "splice"]]
    assert "refSeq.clinvar.x" not in r and r["gnomad.exomes.AF"] == [[None]]


def test_one_record_without_its_key(spark):
    seq = {"name2": [[["A"], ["B"]]], "siteType": [[["x"], ["y"]]]}
    found = nested.query_annotations(docs_of(spark, [doc(ref_seq=seq | {"name": [[["1"], ["2"]]]}, het=["s1"])]), fields=["refSeq.name2", "refSeq.siteType"]).collect()[0].asDict()
    assert found["refSeq.name2"] == [["A", "B"]] and found["refSeq.siteType"] == [["x", "y"]]


def test_melt_law(spark):
    rows = [doc(het=["s1", "s2"], hom=["s3"], miss=["s4"]), doc("+AC", het=["s1"]), doc()]
    got = nested.melt_samples(nested.normalise(docs_of(spark, rows)))
    assert sorted((r.alt, r.sample, r.dosage) for r in got.collect()) == sorted([("A", "s1", 1), ("A", "s2", 1), ("A", "s3", 2), ("A", "s4", -1), ("+AC", "s1", 1), ("+AC", "s1", 1)])
    assert "heterozygotes" not in got.columns


def test_explode_in_step_and_flattened(spark):
    seq = {"name": [[["NM1"], ["NM2"]]], "name2": [[["G1"], ["G2", "G3"]]], "siteType": [[["a"], ["b"]]]}
    rows = nested.normalise(docs_of(spark, [doc(ref_seq=seq)]))
    got = nested.explode_field(rows, "refSeq.name2").select("`refSeq.name2`", "`refSeq.siteType`").collect()
    assert [(a, b) for a, b in got] == [("G1", ["a"]), ("G2", ["b"]), ("G3", ["b"])]
    assert nested.explode_field(rows, "refSeq.name2", flatten=False).count() == 2
    with pytest.raises(ValueError, match="fields"):
        nested.explode_field(rows, "nope.x")


def test_explode_rows_with_list(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k int, v array<string>")
    assert sorted((r.k, r.v or "") for r in nested.explode_rows_with_list(df, "v").collect()) == [(1, "a"), (1, "b"), (3, "")]


def test_options_and_projection(spark):
    with pytest.raises(ValueError, match="must be one of"):
        nested.check_options(["a"], "b")
    with pytest.raises(ValueError, match="structs"):
        nested.check_options(["a"], None, structs_of_arrays=False)
    rows = nested.normalise(docs_of(spark, [doc()]))
    assert nested.project(rows, ["refSeq.name", "nope", "pos"]).columns == [*nested.IDENTITY, "locus", "refSeq.name"]
    assert nested.sorted_keys(["b", "A", "id", "alt"], drop_alt=True) == ["id", "A", "b"]


def test_key_value_lists(spark):
    df = spark.createDataFrame([(("1.23456", "x", "7"),)], "t struct<b:string,A:string,id:string>")
    assert df.select(nested.key_value_lists(df, "t", ("t.id",))).first()[0] == [["id", "7"], ["A", "x"], ["b", "1.2346"]]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="0123456789._-+eEd ", max_size=8))
def test_parser_never_loops(text):
    try:
        querystring.Parser(text).parse()
    except ValueError:
        pass


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("*", {1, 2, 3}),
        ("exonic (af:<0.1 || g.af:<0.1)", {1}),
        ("(kind:del && (alt:\\-6 || alt:\\-1)) || (cadd:>40)", {2, 3}),
        ("dist:<=50000", {1, 3}),
        ("NOT kind:del", {1, 3}),
        ("-kind:del cadd:[10 TO 50]", {1, 3}),
        ("cadd:{10 TO 20}", set()),
        ("kind:d*", {2}),
        ('"splice site"', {2}),
        ("genes:BRCA2", {1}),
        ("cadd:abc", set()),
        ("kind:(snp OR del)", {1, 2, 3}),
        ("CADD:>=10 AND kind:SNP", {1, 3}),
    ],
)
def test_query_language(spark, query, ids):
    rows = [(1, "exonic", "SNP", "A", 10.0, 0.05, (0.5,), 10, ["BRCA1", "BRCA2"]), (2, "a splice  site", "DEL", "-6", 20.0, None, (0.01,), 90_000, []), (3, "intronic", "SNP", "A", 45.0, 0.5, (None,), 50_000, None)]
    df = spark.createDataFrame(rows, "id int, text string, kind string, alt string, cadd double, af double, g struct<af:double>, dist long, genes array<string>")
    assert {r.id for r in querystring.search(df, query).collect()} == ids


@pytest.mark.parametrize("query", ["a:", "(a", "a)", "x:<1", ">5"])
def test_bad_queries(spark, query):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        querystring.search(df, query)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as double) v", "'x' s").write.parquet(str(tmp_path / "t"))
    plan = querystring.search(spark.read.parquet(str(tmp_path / "t")), "v:>90").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,90.0)" in plan and "s:string" not in plan


def test_slices():
    assert [querystring.plan_slices(n) for n in (1, 10_000, 10_001, 10**9)] == [1, 1, 2, 1024]
    with pytest.raises(ValueError):
        querystring.plan_slices(0)


def test_join_of_carriers_and_tmt(spark):
    variants = spark.createDataFrame([("s1", "G1", 1, "p"), ("s2", None, 2, "q"), ("s9", "G1", 1, "r")], "sample string, `refSeq.name2` string, dosage int, note string")
    wide = spark.createDataFrame([("G1", 5, "P1", 1.0, 30.0, 30.7, 29.0), (None, 6, "P2", 1.0, 10.0, 11.0, 12.0)], "Index string, NumberPSM long, ProteinID string, MaxPepProb double, ReferenceIntensity double, s1 double, s2 double")
    notes = spark.createDataFrame([], "plex int, channel string, sample string, sample_name string, condition string, replicate int")
    tmt = prepare_tmt(wide, notes)
    got = joins.join_proteomics(variants, tmt).collect()
    assert sorted((r.sample, r["refSeq.name2"] or "-", round(r.normalized_sample_intensity, 6)) for r in got) == [("s1", "G1", 0.7), ("s2", "-", 2.0)]
    mapped = joins.join_proteomics(variants, tmt, map_variant_sample=lambda c: F.when(c == "s9", "s1").otherwise(c))
    assert mapped.count() == 3
    plain = spark.createDataFrame([("s1", "G1", "z")], "sid string, gene string, note string")
    assert joins.join_proteomics(variants, plain, protein_gene="gene", protein_sample="sid").columns == ["sample", "refSeq.name2", "dosage", "note_x", "note_y"]
    with pytest.raises(ValueError):
        joins.join_proteomics(variants, plain)


def test_match_matrices(spark):
    a = spark.createDataFrame([(k, 0, 0, float(k)) for k in range(3)], "matrix_id int, i int, j int, v double")
    assert joins.match_matrices(a, a.where("matrix_id = 1")).count() == 3 and joins.match_matrices(a, a).count() == 3
    with pytest.raises(ValueError):
        joins.match_matrices(a, a.where("matrix_id < 2"))


def test_unknown_fields_warn_and_unknown_ids_raise(spark):
    rows = spark.createDataFrame([(1, "x", 2.0)], "id int, name string, extra double")
    with pytest.warns(UserWarning, match="nmae"):
        assert nested.project(rows, ["nmae", "extra"]).columns == ["id", "extra"]
    mapping = spark.createDataFrame([("P1", "A"), ("P2", None)], "uniprot_accession string, gene_name string")
    ids = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "acc string")
    assert [r.gene_name for r in joins.lookup_genes(ids, "acc", mapping).collect()] == ["A"]
    assert [r.gene_name for r in joins.lookup_genes(ids.where("acc <> 'P3'"), "acc", mapping, strict=True).collect()] == ["A"]
    for look, names, column in ((joins.lookup_genes, ids, "acc"), (joins.lookup_proteins, spark.createDataFrame([("A",), ("Z",)], "gene string"), "gene")):
        with pytest.raises(PySparkException, match="not in the mapping"):
            look(names, column, mapping, strict=True).collect()


def test_lists_of_matrices_of_any_length_are_matched(spark):
    one = lambda n: spark.range(n).select(F.col("id").alias("matrix_id"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("id").cast("double").alias("v"))
    with pytest.raises(ValueError):
        joins.match_matrices(one(100_001), one(100_002))
    assert joins.match_matrices(one(3), one(3)).where("a = b").count() == 3 and joins.match_matrices(one(1), one(3)).count() == 3
