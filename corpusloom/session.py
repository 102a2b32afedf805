"""Sessions: settings the engine is meant for, and the package on every executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch between JVM and Python. By rows alone a batch of long texts would hold a whole split, on both sides.
BATCH_BYTES, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; everything else is the cluster's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, so that their Python workers can import it; bound
    Arrow batches by bytes where the session doesn't do so yet."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
