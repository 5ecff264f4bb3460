"""The whole folder is collected in one run: no module of one folder hides another's."""

import os
import subprocess
import sys


def test_everything_is_collected():
    folder = os.path.dirname(os.path.abspath(__file__))
    run = subprocess.run([sys.executable, "-m", "pytest", folder, "--collect-only", "-q", "-p", "no:cacheprovider"], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stdout[-2000:]
    for name in ("test_plans", "test_queries", "test_skew"):
        assert f"{name}.py::" in run.stdout
