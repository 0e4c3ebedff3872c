"""What a Spark session needs to run this package's Python code on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


#: Most bytes of a batch that goes to Python; a session's own smaller setting stays.
BATCH = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Readers and matchers hold a batch of texts several times over, in each Python worker of each core: Spark's 64 MB a batch
    would let an executor's Python grow with the rows of a partition until then."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a session, unless their Python path has it already; bounds batches."""
    bound_batches(spark)
    seen = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if str(ROOT) in seen or getattr(spark, "_tidewell_sent", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tidewell.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(ROOT.glob("tidewell/**/*.py")) + sorted(ROOT.glob("*.py")):
            z.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(archive)
    spark._tidewell_sent = True
