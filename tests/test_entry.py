"""The entry module without what only its optional part needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys, warnings
warnings.simplefilter("ignore")

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == "{module}" or name == "{module}":
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
names = set(entry.queries())
assert "repo_security_report" in names and "churn_history" in names
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert not any(n.startswith("op1") for n in entry.oracle_sql())
"""


@pytest.mark.parametrize("module", ["zstandard", "xxhash", "public_tokenizers", "forgelens.llm"])
def test_audit_queries_without_the_training_part(module):
    done = subprocess.run([sys.executable, "-c", CODE.format(module=module)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
