"""Python workers run the package's functions without having it on their path."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from phonolake.session import local_session
spark = local_session(2, "elsewhere")
for name in {names!r}:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


NAMES = ["log_mel", "ctc_score", "error_totals", "cmvn_stats", "labels_by_offset", "prepare_features", "label_offsets", "encode_tokens", "drop_oov"]


def run_elsewhere(names, folder, timeout=600):
    """Run queries from a folder that has no copy of the package, which is on no path of the workers."""
    code = [sys.executable, "-c", CODE.format(root=str(ROOT), names=names)]
    done = subprocess.run(code, cwd=folder, capture_output=True, text=True, timeout=timeout, env={"PATH": "/usr/bin:/bin", **_java()})
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_from_another_folder(tmp_path):
    run_elsewhere(NAMES, tmp_path)


def _java() -> dict[str, str]:
    import os

    return {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
