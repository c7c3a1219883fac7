"""The entry point on its own: from another folder, and without what is optional."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
START = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", "{REPO}/__spark_entry__.py")
"""
RUN = """
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
"""


def python(code: str, folder) -> str:
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=environment, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = START + RUN + """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
found = entry.queries()["folder_inventory"](spark, entry.SMOKE_DIR).collect()
again = entry.queries()["batch_scorer"](spark, entry.SMOKE_DIR).count()
print("rows", len(found), again)
"""
    assert "rows " in python(code, tmp_path)


def test_the_entry_stands_without_an_optional_library(tmp_path):
    code = START + "sys.modules['ahocorasick'] = None\n" + RUN + "print(len(entry.queries()), 'pipeline' in entry.queries(), 'gold_join' in entry.oracle_sql())"
    number, *rest = python(code, tmp_path).split()
    assert int(number) > 100 and rest == ["False", "True"]
