"""Sessions: settings that suit the plans here, and the package on every executor."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, so that functions that Spark
    pickles by reference can be imported there."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        path = Path(tempfile.mkdtemp(prefix="namewright-ship-")) / f"{root.name}.zip"
        path.write_bytes(held.getvalue())
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED[app] = str(path)
    return spark


def local_session(cpus: str = "8", shuffle_partitions: int = 8, app: str = "namewright") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
