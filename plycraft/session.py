"""The session that tests and the bench use; on a cluster, bring your own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A one-process session with the settings that the engine expects (UTC, ANSI, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plycraft")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path that the driver and all executors see: below ``spark.checkpoint.dir``,
    which only a one-process session may do without."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or '/tmp/checkpoints/plycraft').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to three tasks a core, before work that costs far more than
    its few bytes, by which Spark would put it into one or a few tasks."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, unless their path has it."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    known = {Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(":")} | {Path.cwd().resolve()}
    app = spark.sparkContext.applicationId
    if root in known or app in _shipped:
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp()) / "plycraft.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted((root / "plycraft").rglob("*.py")):
            out.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
