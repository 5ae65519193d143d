import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_of_the_engine_has_sql():
    from textloom import queries

    assert set(queries.queries()) == set(queries.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) == 10


def test_without_the_pipeline_parts(tmp_path):
    """The entry module imports without the subpackage and its pipeline, and the library never imports them."""
    for p in ("textloom", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(ROOT / p) if p != "textloom" else (tmp_path / p).mkdir()
    for p in (ROOT / "textloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "textloom" / p.name).symlink_to(p)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any('llm' in m for m in sys.modules))"
    body = (tmp_path / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(body)
    out = subprocess.run([sys.executable, "-B", "-c", code], capture_output=True, text=True, cwd=tmp_path)
    n, m, seen = out.stdout.split()
    assert n == m and int(n) > 30 and seen == "False", out.stderr
