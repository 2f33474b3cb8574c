import os
import subprocess
import sys

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()
from sluice.llm.common import durable, stored
import os
rows = durable(spark.range(1000))
again, path = stored(rows, "rows")
assert rows.count() == again.count() == 1000 and len(os.listdir(sys.argv[1])) == 2
spark.stop()
"""


def test_nothing_stays_when_the_session_has_ended(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(shared), str(tmp_path / "warehouse")], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [x for x in os.listdir(shared) if not x.startswith(".")] == []
