import numbers
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessella.plans import catalog

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).parent.parent


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns)

    def plain(v):
        if pd.isna(v):
            return "-"
        return str(v) if isinstance(v, (str, bool)) or not isinstance(v, numbers.Number) else round(float(v), 5) + 0.0

    rows = [sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)), key=str) for df in (got, want)]
    assert rows[0] == rows[1]


def test_library_works_without_the_text_operators(tmp_path):
    """A copy without the llm folders and the pipeline still has its own queries."""
    import shutil

    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(o) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "tessella").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tessella.llm" not in path.read_text(), path
