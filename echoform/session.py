"""Session settings and shipping of the package to Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings the engine is tuned for; callers may override any of them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "echoform", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


#: Rows of an Arrow batch. Batches of long texts are held several times, by the JVM and by each worker.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers once for each application, so that they can import it wherever they run."""
    context, key = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "-7") == "-7":  # the caller has set nothing
        spark.conf.set(key, BATCH_ROWS)
    if not getattr(context, "_echoform_shipped", False):
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="echoform-")) / "echoform.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        context.addPyFile(str(path))
        context._echoform_shipped = True
    return spark
