"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()
#: Bytes of a batch that Spark hands to Python, whatever the length of the texts in it.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, once an application; they may have no copy of it.

    Python gets batches bounded in bytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="loregrid-")  # the driver serves the file as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "loregrid.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, str(path.relative_to(_PACKAGE.parent)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def session(app: str = "loregrid", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``conf`` adds or overrides settings."""
    builder = SparkSession.builder.appName(app)
    for key, value in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
