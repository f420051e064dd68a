"""Every query with SQL agrees with DuckDB at the smallest scale; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle_sql()])
def test_agrees(spark, oracle, name):
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = oracle.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in names) for r in cur.fetchall())
    key = lambda rows: sorted(map(repr, rows))
    if key(got) != key(want):  # the last digit may differ where a rounding falls on a tie
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert all(x == y or (isinstance(x, float) and abs(x - y) < 2e-5) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", [n for n in CORE if n not in entry.oracle_sql()])
def test_runs(spark, name):
    """Training: the error traces are finite, and where bins are fitted the training error falls."""
    rows = entry.queries()[name](spark, DATA).collect()
    assert rows and all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))
    if name in ("nadam_train_small", "rows_bins_train", "bins_only_train"):
        assert rows[-1]["train"] < rows[0]["train"]


def test_errors_inside_the_subpackage_are_not_hidden(tmp_path):
    """Without the subpackage the rest registers; a broken one is an error, not an absence."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/lacunar", tmp_path / "lacunar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op')])"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    out = run()
    assert out.returncode == 0 and out.stdout.strip() == f"{len(CORE)} []"
    (tmp_path / "lacunar" / "llm").mkdir()
    (tmp_path / "lacunar" / "llm" / "__init__.py").write_text("")
    (tmp_path / "lacunar" / "llm" / "queries.py").write_text("import no_such_module\n")
    out = run()
    assert out.returncode != 0 and "no_such_module" in out.stderr


def test_entry(spark):
    assert entry.entry(spark).count() > 0
