import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_core_does_not_need_the_text_operators():
    code = "import sys; sys.modules['foliospark.llm'] = None; import foliospark.plans.records, foliospark.plans.pages, foliospark.plans.runs, foliospark.sources.office; import __spark_entry__ as e; assert 'p4_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_imports_the_text_operators():
    for p in (REPO / "foliospark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "foliospark.llm" not in p.read_text()
