import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_a_session():
    said = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(o) <= set(q); print('fine')"
    done = subprocess.run([sys.executable, "-c", said], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
