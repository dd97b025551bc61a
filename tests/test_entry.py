"""The entry module where packages are missing."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.modules[{missing!r}] = None  # its import then fails
import __spark_entry__ as contract
print(len(contract.queries()), len(contract.oracle_sql()), "pipeline" in contract.queries())
"""


def listed(missing):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(missing=missing)], capture_output=True, text=True, check=True, cwd=ROOT
    )
    queries, oracles, pipeline = done.stdout.split()
    return int(queries), int(oracles), pipeline == "True"


def test_other_queries_stay_without_the_subpackage_or_a_package_it_needs():
    from gleanery.queries import all_oracles, all_queries

    alone = (len(all_queries()), len(all_oracles()), False)
    assert listed("gleanery.llm") == alone
    assert listed("public_tokenizers") == alone
