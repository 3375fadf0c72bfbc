"""Session set-up and the few settings that plans depend on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings under which the library's own sessions run. Nothing in the operators relies on them: expressions are
#: written so that they give the same rows under any session time zone, ANSI mode or case sensitivity.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "roadloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local one is made only for a local master without one (tests)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="roadloom-checkpoint-")
        atexit.register(shutil.rmtree, configured, True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and go on from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application, wherever they run and whatever their paths hold."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="roadloom-package-")) / "roadloom.zip"  # read by this driver, served by Spark
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, str(path.relative_to(root.parent)))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` with this package present on the executors."""
    ship_package(df.sparkSession)
    return df.mapInPandas(run, schema)
