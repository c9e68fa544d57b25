"""The entry module works with and without the text operators, and without a session."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("block", ["", "sys.modules['skeinwork.llm'] = None; "])
def test_import(block):
    code = f"import sys; {block}import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'impact' in q; print(any(n.startswith('op') for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    here = (ROOT / "skeinwork" / "llm" / "queries.py").exists()
    assert done.stdout.strip() == str(here and not block)


def test_entry(spark):
    import __spark_entry__

    if not Path(__spark_entry__.SMOKE_DIR).is_dir():
        pytest.skip("no driver tables")
    assert __spark_entry__.entry(spark).columns == ["seed", "id", "depth", "parent"]
