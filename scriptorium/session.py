"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "spark.scriptorium.shipped"


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library is written for: UTC, adaptive execution, ANSI."""
    builder = SparkSession.builder.appName("scriptorium")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once a context, so that their Python workers can import them."""
    mark = spark.sparkContext.applicationId
    if spark.conf.get(_SHIPPED, "") == mark:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="scriptorium-")) / "scriptorium-modules.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    spark.conf.set(_SHIPPED, mark)
