"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
FIND = """
import importlib.util
find = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name.startswith(("quire.llm", "corpus_pipeline")) else find(name, *a)
"""


def names(before=""):
    code = before + "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), out[1], int(out[2])


def test_imports_without_a_session_and_without_the_llm_part():
    whole, fits, extra = names()
    assert fits == "True"
    rest, fits, none = names(FIND)
    assert (rest, fits, none) == (whole - extra, "True", 0) and rest > 70


def test_nothing_else_imports_the_llm_part():
    for f in (ROOT / "quire").rglob("*.py"):
        if "llm" not in f.parts:
            text = f.read_text()
            assert "quire.llm" not in text and "from .llm" not in text and "..llm" not in text


def test_entry(spark):
    import __spark_entry__

    if Path("/root/testdata/sf0.001").exists():
        assert __spark_entry__.entry(spark).count() > 0
