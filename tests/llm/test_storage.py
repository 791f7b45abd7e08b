"""What operators write on the way is gone when the driver has ended."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": sys.argv[1] + "/warehouse", "spark.checkpoint.dir": "file://" + sys.argv[1] + "/shared"}).getOrCreate()
from arborix.llm.queries import QUERIES
for name in ("op5_line_dedup", "op8_simhash", "op10_suffix_dedup", "op3_token_binary", "op6_mpeg_audio"):
    assert QUERIES[name](spark, sys.argv[2]).count() > 0, name
try:
    from arborix.llm import linededup
    linededup.dedup_lines(spark.createDataFrame([(1, b"x")], "doc_id long, text binary").selectExpr("doc_id", "raise_error('no text') AS text"))
except Exception as e:
    assert "no text" in str(e), e
else:
    raise AssertionError("an error was expected")
assert not spark.catalog.listTables(), spark.catalog.listTables()
spark.stop()
"""


def test_nothing_stays(tmp_path, sf_dir):
    (tmp_path / "shared").mkdir()
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), sf_dir], env=os.environ | {"PYTHONPATH": str(ROOT)}, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not [p for p in (tmp_path / "shared").rglob("*") if p.is_file()]
    assert not (tmp_path / "warehouse").exists() or not any((tmp_path / "warehouse").iterdir())
