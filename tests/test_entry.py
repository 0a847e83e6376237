"""The entry module without its optional part."""

import importlib.util
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _python(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


def test_core_queries_need_no_packages_of_the_optional_part():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q))"
    done = _python(code)
    assert done.returncode == 0, done.stderr
    count, pipeline, numbered = done.stdout.split()
    assert int(count) >= 90 and pipeline == numbered == "False"


@pytest.mark.skipif(not importlib.util.find_spec("eventmill.llm"), reason="the optional part is not there")
def test_errors_of_the_optional_part_are_not_hidden():
    done = _python("import sys; sys.modules['eventmill.llm.common'] = None; import __spark_entry__")
    assert done.returncode != 0 and "eventmill.llm.common" in done.stderr
