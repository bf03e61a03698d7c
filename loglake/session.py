"""Session builder with the settings the engine is tuned for.

Nothing in the library depends on these settings for right results: timestamps
are ``TIMESTAMP_NTZ`` in UTC, so the session time zone never enters a result.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM never compiles a method of over 8000 bytes: such stages run faster in parts
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # large expressions are built in Python: do not record a call site for each part
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "loglake", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the engine's defaults; ``conf`` keys win over them.

    Keys in ``conf`` use ``__`` for dots so that they can be keyword arguments.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def compile_in_parts(spark: SparkSession) -> None:
    """Let big projections be generated as several methods in a session that ``build_session`` did not make.

    Parsing all formats is one long expression. As a single generated method it is over the
    size the JVM compiles and would be interpreted, at half the speed; results are the same.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > int(DEFAULT_CONF[name]):
        spark.conf.set(name, DEFAULT_CONF[name])


_LISTING, _OPENING = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"


def few_tasks(spark: SparkSession) -> None:
    """Some tasks a core for listing, where Spark takes up to 10,000, and many small files to a task that reads; results are the same."""
    spark.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))
    spark.conf.set(_OPENING, str(64 << 10))


@contextmanager
def many_small_files(spark: SparkSession) -> Iterator[None]:
    """Read folders of small files with few tasks; results are the same.

    Spark deals 4 MB of a task to every file, however small, and lists each of up to 10,000 folders
    or names in a task of its own, which costs more than reading the files.
    """
    before = {name: spark.conf.get(name) for name in (_OPENING, _LISTING)}
    try:
        few_tasks(spark)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names.

    The folder in ``spark.checkpoint.dir`` always wins; ``fallback`` is used only
    where the cluster sets none (local tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not fallback:
        raise ValueError("spark.checkpoint.dir is not set and no fallback folder was given")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers of the session, once, so that their functions can import it."""
    context = spark.sparkContext
    if getattr(context, "_loglake_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="run-")
    shutil.copytree(package, f"{folder}/{os.path.basename(package)}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}-package", "zip", folder))
    context._loglake_shipped = True
