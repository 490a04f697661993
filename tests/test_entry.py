import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent
SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.engine.QUERIES))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_runs_without_training_parts(tmp_path):
    """The rest imports and lists its queries when the training subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "gleanery", tmp_path / "gleanery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.engine.QUERIES) and set(e.oracle_sql()) == set(e.engine.ORACLE)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)
