"""The named queries with and without the operators for training data."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

# What the import finds in the place of the extra package.
ABSENT = {
    "no package": [],
    "a folder without modules": ["spendlens/llm/__pycache__/x.pyc"],
    "a module that lacks what it imports": ["spendlens/llm/queries.py", "corpus_pipeline.py"],
}


@pytest.mark.parametrize("case", ABSENT)
def test_the_rest_works_without_the_extra(tmp_path, case):
    for path in ROOT.glob("*.py"):
        if path.name != "corpus_pipeline.py":
            (tmp_path / path.name).write_text(path.read_text())
    for path in (ROOT / "spendlens").rglob("*.py"):
        if "llm" not in path.parts:
            target = tmp_path / path.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(path.read_text())
    for name in ABSENT[case]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("import a_library_that_is_not_there\n")
    code = "import __spark_entry__ as e; print(e.WITH_LLM, len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    with_llm, queries, sql, pipeline = done.stdout.split()
    assert with_llm == pipeline == "False" and int(queries) > 150 and queries == sql
