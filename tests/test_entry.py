"""The driver's contract: entry runs, every SQL belongs to a query, the library stands without its subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

TOP = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"sre", "vmd", "pct_heavy"} <= set(df.columns)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_subpackage():
    for p in (TOP / "viaflux").rglob("*.py"):
        if "llm" not in p.relative_to(TOP).parts:
            assert "viaflux.llm" not in p.read_text(), p


def test_stands_alone(tmp_path):
    copy = tmp_path / "alone"
    copy.mkdir()
    for p in [TOP / "__spark_entry__.py", *(TOP / "viaflux").rglob("*.py")]:
        rel = p.relative_to(TOP)
        if "llm" not in rel.parts:
            (copy / rel).parent.mkdir(parents=True, exist_ok=True)
            (copy / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'km_by_class' in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy).returncode == 0
