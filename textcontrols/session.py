"""Session factory and shared-folder lookup."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SCRATCH: list[tempfile.TemporaryDirectory] = []
_SENT: set[str] = set()

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    master: str | None = None,
    app: str = "textcontrols",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return the active session or build one with the library defaults.

    On a cluster the session normally exists already (spark-submit); the
    defaults then only fill keys that are unset.  ``master`` is only used
    when a new local session has to be built (tests, bench).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(_DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` as the cluster names it.  Only in local
    mode (tests) an unset folder is replaced by a private scratch folder; on a
    cluster an unset folder is an error, never a machine-local path.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a shared folder for checkpoints")
        scratch = tempfile.TemporaryDirectory(prefix="textcontrols-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"),
                                              ignore_cleanup_errors=True)
        _SCRATCH.append(scratch)  # goes when the process ends
        d = scratch.name
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def send_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each application: their Python steps import it."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = Path(__file__).resolve().parent
    scratch = tempfile.TemporaryDirectory(prefix="textcontrols-code-", ignore_cleanup_errors=True)
    _SCRATCH.append(scratch)  # goes when the process ends
    archive = Path(scratch.name) / "textcontrols-modules.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(archive))
    _SENT.add(context.applicationId)
