"""The registered queries where the optional subpackage or what it needs is missing."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:len(HIDE.split("."))] == HIDE.split("."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
names = e.queries()
print(sum(not n.startswith("op") and n != "pipeline" for n in names), len(names), set(e.oracle_sql()) <= set(names))
"""


def count(hide):
    done = subprocess.run([sys.executable, "-c", f"HIDE = {hide!r}\n{COUNT}"], cwd=ROOT, capture_output=True, text=True, check=True)
    return done.stdout.split()[-3:]


@pytest.mark.parametrize("hide", ["jobscope.llm", "corpus_pipeline", "xxhash", "tiktoken", "public_tokenizers"])
def test_library_alone(hide):
    library, total, sql = count(hide)
    assert int(library) >= 133 and int(total) >= int(library) and sql == "True"
    if hide in ("jobscope.llm", "xxhash"):
        assert total == library
