"""Content-safety analytics on Spark: operators, sources, functions, plans and streams."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()
#: Rows of an Arrow batch: whole texts, of which Spark's default of 10,000 would take tens of MB per worker and direction.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark) -> None:
    """Sends this package to the Python workers, once per application, and makes Arrow batches small where
    the session has Spark's default."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "textmill.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.join("textmill", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
