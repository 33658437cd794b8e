"""Queries can be listed before there is a Spark session."""

import os
import subprocess
import sys


def test_names_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, text=True, check=True)
    assert int(done.stdout.split()[-2]) > 200
