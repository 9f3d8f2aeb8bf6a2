"""The entry module, with the corpus operators and without them."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "orograph.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert q and o and not [k for k in q if k.startswith("op")] and "pipeline" not in q
"""


def test_entry_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for top, _, names in os.walk(os.path.join(ROOT, "orograph")):
        if os.path.basename(top) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert "orograph.llm" not in open(os.path.join(top, n)).read(), n


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 10 and all(r.rmse > 0 for r in rows)
