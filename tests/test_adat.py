import pytest

from tessella.sources import adat, proteomics

HEAD = "!Checksum\tx\n^HEADER\n!Version\t1\n^TABLE_BEGIN\n\t\tTarget\tT1\tT2\n\t\tUniProt\tP1\tP2é\nPlateId\tSampleId\t\t\t\n"


@pytest.fixture
def path(tmp_path):
    lines = [f"PL{k % 3}\tSé{k:03d}\t\t{k}.5\t{'NA' if k % 7 == 0 else k * 2}\r\n" + ("\n" if k % 10 == 0 else "") for k in range(100)]
    file = tmp_path / "a.adat"
    file.write_bytes((HEAD + "".join(lines) + "PL\tlast\t\t1\t2").encode())
    return str(file)


def plain(dataset):
    return sorted(tuple(str(r[c]) for c in ("SampleId", "PlateId", "Target", "UniProt", "RFU")) for r in dataset.melt().collect())


@pytest.mark.parametrize("split_bytes", [1, 37, 500, 1 << 20])
def test_ranges_lose_and_repeat_no_line(path, split_bytes):
    schema = adat.AdatSource({"path": path}).schema()
    reader = adat.AdatSource({"path": path, "split_bytes": str(split_bytes)}).reader(schema)
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [r["SampleId"] for r in rows] == [f"Sé{k:03d}" for k in range(100)] + ["last"]
    assert rows[7]["rfu"] == [7.5, None] and rows[8]["rfu"] == [8.5, 16.0] and [r["row_id"] for r in rows] == sorted({r["row_id"] for r in rows})


def test_tables_equal_those_of_the_line_reader(spark, path):
    got = adat.read_adat_ranges(spark, path, 300)
    assert plain(got) == plain(proteomics.read_adat(spark, path))
    assert got.samples.rdd.getNumPartitions() > 5 and got.samples.columns == ["row_id", "PlateId", "SampleId"]
    assert [r.SampleId for r in got.samples.orderBy("row_id").collect()][-2:] == ["Sé099", "last"]
    assert spark.read.format("adat").load(path).columns == ["row_id", "PlateId", "SampleId", "rfu"]


def test_files_without_samples(spark, tmp_path):
    (tmp_path / "none.adat").write_text(HEAD)
    assert adat.read_adat_ranges(spark, str(tmp_path / "none.adat")).melt().count() == 0
    (tmp_path / "broken.adat").write_text("^HEADER\n")
    with pytest.raises(ValueError, match="no table"):
        adat.read_head(str(tmp_path / "broken.adat"))
    with pytest.raises(ValueError, match="compressed"):
        adat.read_head("x.adat.gz")


def test_folder_of_files_written_and_read_back(spark, tmp_path):
    samples = spark.createDataFrame([(k, f"PL{k % 3}", None if k == 4 else f"S\t{k}") for k in range(40)], "row_id long, PlateId string, SampleId string").repartition(5)
    analytes = spark.createDataFrame([(7, "T7", "P7"), (3, "T3", None)], "column_id int, Target string, UniProt string")
    rfu = [(k, c, k + c / 2) for k in range(0, 40, 2) for c in (3, 7)] + [(1, 3, None), (5, 7, 9.5), (5, 7, 1.5), (99, 3, 1.0), (2, 8, 1.0), (3, None, 1.0)]
    data = proteomics.SomascanDataset(samples, analytes, spark.createDataFrame(rfu, "row_id long, column_id int, RFU double"))
    folder = str(tmp_path / "study")
    adat.write_adat(data, folder)
    assert len(adat.list_files(folder)) >= 1
    for split in (50, 1 << 20):
        got = adat.read_adat_ranges(spark, folder, split)
        assert got.samples.select("row_id").distinct().count() == 40
        rows = {(r.SampleId, r.PlateId, r.Target): r.RFU for r in got.melt().collect()}
        want = {("" if k == 4 else f"S {k}", f"PL{k % 3}", f"T{c}"): (k + c / 2 if k % 2 == 0 else 9.5 if (k, c) == (5, 7) else None) for k in range(40) for c in (3, 7)}
        assert rows == want
    assert {r.UniProt for r in got.analytes.collect()} == {"", "P7"}


def test_folder_with_another_head_is_refused(spark, tmp_path):
    (tmp_path / "a.adat").write_text(HEAD + "p\ts\t\t1\t2\n")
    (tmp_path / "b.adat").write_text(HEAD.replace("T2", "T9") + "p\ts\t\t1\t2\n")
    (tmp_path / "_SUCCESS").write_text("")
    with pytest.raises(Exception, match="other sample fields"):
        adat.read_adat_ranges(spark, str(tmp_path)).melt().count()
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no files"):
        adat.read_adat_ranges(spark, str(tmp_path / "none"))


def test_empty_dataset_is_written(spark, tmp_path):
    data = proteomics.SomascanDataset(spark.createDataFrame([], "row_id long, SampleId string"), spark.createDataFrame([(0, "T")], "column_id int, Target string"), spark.createDataFrame([], "row_id long, column_id int, RFU double"))
    adat.write_adat(data, str(tmp_path / "e"))
    got = adat.read_adat_ranges(spark, str(tmp_path / "e"))
    assert got.samples.count() == 0 and got.analytes.count() == 1
