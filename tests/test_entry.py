import subprocess
import sys
from pathlib import Path

import __spark_entry__
from gridloom.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalog.QUERIES) <= set(queries) and set(sql) <= set(queries)


def test_registry_without_the_corpus_part():
    code = "import sys; sys.modules['gridloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_part():
    for path in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "gridloom").parts:
            assert ".llm" not in path.read_text()
