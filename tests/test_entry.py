"""The driver contract, also without a session and without the optional part."""

import subprocess
import sys

ROOT = __file__.rsplit("/tests/", 1)[0]


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout


def test_queries_are_listed_without_a_session():
    assert int(run("import __spark_entry__ as e; print(len(e.queries()))")) > 300


def test_the_rest_imports_without_the_optional_part():
    code = "import sys; sys.modules['docloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op1_') or k == 'pipeline' for k in q))"
    n, optional = run(code).split()
    assert int(n) > 290 and optional == "False"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
