"""Python workers run every operator and the pipeline without having the package on their path."""

from __future__ import annotations

from phonolake.llm.queries import LLM_QUERIES
from tests.test_workers import run_elsewhere


def test_from_another_folder(tmp_path):
    run_elsewhere([name for name in LLM_QUERIES if name != "op10_url_filter"], tmp_path, timeout=1200)
