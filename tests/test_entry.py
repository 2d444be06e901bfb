"""The driver's entry points, with and without the training-data operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def imported(folder, code):
    subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, check=True, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"})


NONE = "import __spark_entry__ as e; assert len(e.queries()) > 90 and e.oracle_sql(); assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"


@pytest.mark.parametrize("beside", [[], ["corpus_pipeline.py"]])
def test_imports_without_the_training_data_operators(tmp_path, beside):
    for name in ["__spark_entry__.py", *beside]:
        if (ROOT / name).exists():
            (tmp_path / name).symlink_to(ROOT / name)
    package = tmp_path / "bomweave"
    package.mkdir()
    for part in (ROOT / "bomweave").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (package / part.name).symlink_to(part)
    imported(tmp_path, NONE)


def test_imports_where_a_library_of_theirs_is_missing(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bomweave"):
        if (ROOT / name).exists():
            (tmp_path / name).symlink_to(ROOT / name)
    (tmp_path / "tokenizers.py").write_text("raise ModuleNotFoundError('no module', name='tokenizers')")
    imported(tmp_path, NONE)
