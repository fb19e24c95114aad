"""The driver contract holds without the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split()


def test_imports_without_the_subpackage():
    for absent in ("loanlens.llm", "corpus_pipeline", "zstandard", "xxhash", "regex", "public_tokenizers"):
        names = run(f"import sys; sys.modules[{absent!r}] = None\n"
                    "import __spark_entry__ as e\nprint(*e.queries()); print(*e.oracle_sql())")
        assert "kpis" in names and "elbow" in names
        assert not any(n.startswith(("op1", "op2", "op9", "pipeline")) for n in names)


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "loanlens")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "loanlens.llm" not in f.read()


def test_a_lost_catalog_is_an_error():
    out = subprocess.run([sys.executable, "-c", "import sys; sys.modules['loanlens.plans.catalog_dist'] = None\n"
                          "from loanlens.plans.registry import load_all\nload_all()"],
                         cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.returncode != 0
