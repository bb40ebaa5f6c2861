from __future__ import annotations

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def listed(place) -> list[str]:
    """Names that the entry registers when it is imported from ``place``, by a process of its own."""
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*sorted(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=place, env=os.environ | {"PYTHONPATH": str(place)}, capture_output=True, text=True, check=True)
    return done.stdout.split()


def test_entry_works_without_the_subpackage_and_the_pipeline(tmp_path):
    whole = listed(REPO)
    own = [n for n in whole if not n.startswith("op") and n != "pipeline"]
    for gone in (["latticeworks/llm", "tests/llm"], ["latticeworks/llm", "tests/llm", "corpus_pipeline.py"]):
        place = tmp_path / str(len(gone))
        shutil.copytree(REPO, place, ignore=shutil.ignore_patterns(".git", "__pycache__", *(os.path.basename(g) for g in gone)))
        assert not any((place / g).exists() for g in gone)
        assert listed(place) == own


def test_entry_registers_every_operator():
    """Where the subpackage is there, so are its twelve queries and, with its file, the pipeline."""
    names = listed(REPO)
    if os.path.isdir(os.path.join(REPO, "latticeworks", "llm")):
        assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 13))
        assert ("pipeline" in names) == os.path.exists(os.path.join(REPO, "corpus_pipeline.py"))
