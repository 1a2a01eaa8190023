"""Every registered query against its SQL, and the entry without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "null" if value != value else repr(round(value, 6) + 0.0)
    return "null" if value is None else str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf_dir), con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() == 200


def test_import_without_llm(tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "tessera").mkdir()
    for p in (root / "tessera").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tessera" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import __spark_entry__ as e; assert 'flagship' in e.queries() and not any(n.startswith('op') for n in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}"], check=True, cwd=tmp_path)
