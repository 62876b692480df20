"""What Python workers need: the package where they cannot import it, and batches that fit texts.

Whole texts make Spark's usual Arrow batches of up to 64 MB large; both sides of each worker
hold some of them. Unless the session has its own setting, batches end at ``BATCH_BYTES``.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from roadloom.durable import fresh_path

BATCH_BYTES = "8m"
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Put the package's sources as a zip file into the shared folder and add it to the application, once."""
    if spark.conf.get(_BATCH_SETTING, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package, content = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(content, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    path = f"{fresh_path(spark, 'package', 'roadloom')}/roadloom.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(content.getvalue()))
    finally:
        out.close()
    context.addPyFile(path)
    _sent.add(context.applicationId)
