"""The catalog without the training-data operators, or without what only they need."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as catalog
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OTHERS = sorted(n for area in (catalog.features, catalog.risk, catalog.governance, catalog.models, catalog.wide, catalog.retrieval, catalog.streams, catalog.jobs, catalog.questions) for n in area.QUERIES)
ASK = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); e.oracle_sql()"


def names(folder, blocked=""):
    code = f"import sys; sys.modules.update(dict.fromkeys({blocked.split()!r})); {ASK}"
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert run.returncode == 0, run.stderr[-2000:]
    return run.stdout.rpartition("NAMES")[2].split()


@pytest.mark.parametrize("gone", [("riskweave/llm", "tests/llm", "corpus_pipeline.py"), ("riskweave/llm", "tests/llm")])
def test_without_the_folders(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(g) for g in gone]))
    assert not any((copy / g).exists() for g in gone)
    assert names(copy) == OTHERS


@pytest.mark.parametrize("library", ["xxhash", "tokenizers public_tokenizers"])
def test_without_a_library(library):
    found = names(ROOT, library)
    assert set(OTHERS) <= set(found)
