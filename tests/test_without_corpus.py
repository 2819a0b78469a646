import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_works_without_the_corpus_operators(tmp_path):
    """The library's queries are there when the subpackage and the pipeline are not."""
    for name in ("ridgeline", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q3_partner_day' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path), *filter(None, [os.environ.get("PYTHONPATH")])])})


def test_the_rest_passes_without_the_corpus_operators(tmp_path):
    """The library's tests run in a copy without the two folders and the pipeline.

    All but the imports of whole warehouses and most comparisons with SQL: these take minutes, and this run makes them anyway.
    """
    for name in ("ridgeline", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = [sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", *[f"tests/test_{n}.py" for n in ("expressions", "catalog", "raw_files")], "-k", "not (test_query or import_of or told_again or thousand) or q3 or e10"]
    paths = os.pathsep.join([str(tmp_path), *filter(None, [os.environ.get("PYTHONPATH")])])
    done = subprocess.run(run, cwd=tmp_path, env=os.environ | {"PYTHONPATH": paths}, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and " passed" in done.stdout, done.stdout[-2000:]


def test_only_the_entry_imports_the_corpus_operators():
    for path in (ROOT / "ridgeline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "ridgeline").parts:
            assert "ridgeline.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
