"""The entry points with and without the training-data operators."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from latticework import queries

ROOT = Path(__file__).resolve().parents[1]
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",), ("latticework/llm", "tests/llm"), ("latticework/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_survives_without_the_optional_parts(tmp_path, gone):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = at / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    found = subprocess.run([sys.executable, "-c", ASK], cwd=at, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    names, sql = map(set, json.loads(found.stdout.splitlines()[-1]))
    llm = (at / "latticework/llm/queries.py").exists()
    pipeline = llm and (at / "corpus_pipeline.py").exists()
    assert set(queries.QUERIES) <= names and set(queries.SQL) <= sql
    assert ("pipeline" in names) == pipeline
    assert any(n.startswith("op1_") for n in names) == llm
    if not llm:
        assert names == set(queries.QUERIES) and sql == set(queries.SQL)


def test_another_import_error_is_not_hidden(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    (at / "latticework/llm").mkdir(exist_ok=True)
    (at / "latticework/llm/__init__.py").touch()
    (at / "latticework/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    found = subprocess.run([sys.executable, "-c", ASK], cwd=at, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert found.returncode and "a_module_that_is_not_there" in found.stderr
