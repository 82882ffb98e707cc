"""The entry works without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"


def names(folder):
    out = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True).stdout
    return [part.split() for part in out.split("|")]


def test_entry_without_training_data_folders(tmp_path):
    import jobs
    from planweave.plans import demos

    rest = {**demos.queries(), **jobs.queries()}
    for keep_pipeline in (True, False):
        home = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT / "jobs", home / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
        shutil.copytree(ROOT / "planweave", home / "planweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * keep_pipeline:
            if (ROOT / name).exists():
                shutil.copy(ROOT / name, home / name)
        queries, oracles = names(home)
        assert queries == sorted(rest) and oracles == sorted({**demos.oracle_sql(), **jobs.oracle_sql()})


def test_every_oracle_has_a_query():
    queries, oracles = names(ROOT)
    assert set(oracles) <= set(queries) and len(queries) >= 67
