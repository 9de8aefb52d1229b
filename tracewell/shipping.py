"""The package's own code, for executors that can't import it from where the driver did."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules, and those beside it, to all executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    target = Path(tempfile.mkdtemp(prefix="tracewell-")) / "tracewell_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in [*sorted((ROOT / "tracewell").rglob("*.py")), *sorted(ROOT.glob("*_pipeline.py"))]:
            z.write(path, path.relative_to(ROOT).as_posix())
    context.addPyFile(str(target))
    _DONE.add(context.applicationId)
