import subprocess
import sys
from pathlib import Path


def test_entry_module_needs_no_session():
    """Names and SQL can be read before there is a session."""
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 90"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120).returncode == 0
