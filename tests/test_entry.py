"""The driver contract loads without a running Spark session."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract_imports_without_spark():
    code = ("import sys; sys.path.insert(0, %r)\n"
            "import __spark_entry__ as E\n"
            "q, o = E.queries(), E.oracle_sql()\n"
            "assert set(o) <= set(q), set(o) - set(q)\n"
            "assert all(callable(f) for f in q.values())\n"
            "print(len(q), len(o))\n") % REPO
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n_q, n_o = map(int, out.stdout.split())
    assert n_q >= 88 and n_o >= 73
