"""Session defaults, and shipping this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def build(app: str = "clipweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is left to the cluster's own settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return b.config(map=defaults | {k: str(v) for k, v in conf.items()}).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once per application, so that workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="clipweave-src-")) / "clipweave_src.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(at))
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session, where it is unset, gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="clipweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
