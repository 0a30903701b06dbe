"""Session settings the jobs are written for."""

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # source files are wide rows: bound an Arrow batch by its size
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
LOCAL_SETTINGS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def session(name: str, master: str | None = None) -> SparkSession:
    """A session with the settings; with ``master`` it is a local one."""
    builder = SparkSession.builder.appName(name)
    settings = dict(SETTINGS)
    if master is not None:
        builder = builder.master(master)
        settings |= LOCAL_SETTINGS
        memory = os.environ.get("FORGELENS_DRIVER_MEMORY")
        if memory:
            settings["spark.driver.memory"] = memory
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if master is not None:
        spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per session.

    Functions that run there are pickled by module name, so the executors must be
    able to import the package wherever the driver was started from.  The archive
    lies in the folder that the cluster shares.
    """
    context = spark.sparkContext
    if getattr(context, "_forgelens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        path = f"{folder.rstrip('/')}/forgelens-{uuid.uuid4().hex}/forgelens.zip"
    elif context.master.startswith("local["):
        path = "file://" + os.path.join(tempfile.mkdtemp(prefix="forgelens-"), "forgelens.zip")
    else:
        return  # no folder that executors share: the package must be installed on them
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(data.getvalue())
    stream.close()
    context.addPyFile(path)
    context._forgelens_shipped = True
