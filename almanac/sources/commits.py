"""Tables that a lost job leaves as they were, on any file system that Spark reaches.

Data is written to a folder of its own first; it counts from the moment a small marker
names it. A marker is created only if it is absent, so that of two writers one succeeds and the other
starts over from what the first one left. A marker without its closing line end was never finished
and does not count.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Attempts of a writer that others keep overtaking.
TRIES = 50


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def create_once(spark: SparkSession, name: str, content: str) -> bool:
    """A small file with one line, unless there is one of that name: whether it was created."""
    fs, path = _path(spark, name)
    try:
        out = fs.create(path, False)
    except Py4JJavaError as error:
        # HDFS and local folders say it with different errors.
        if fs.exists(path):
            return False
        raise error
    out.write(bytearray(f"{content}\n".encode()))
    out.close()
    return True


def markers(spark: SparkSession, folder: str) -> dict[str, str | None]:
    """The markers of a folder by name; None for one that was not finished."""
    fs, path = _path(spark, folder)
    if not fs.exists(path):
        return {}
    found = {}
    for status in fs.listStatus(path):
        stream = fs.open(status.getPath())
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found[status.getPath().getName()] = text.rstrip("\n") if text.endswith("\n") else None
    return {k: v for k, v in found.items() if not k.startswith((".", "_"))}


def _latest(spark: SparkSession, path: str) -> tuple[int, int, str | None]:
    """Number of the newest marker, of the newest finished one, and the data folder that it names."""
    known = {int(k): v for k, v in markers(spark, f"{path}/current").items()}
    finished = max((k for k, v in known.items() if v), default=0)
    return max(known, default=0), finished, known.get(finished)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder with the table's data as it now counts; None before the first write."""
    name = _latest(spark, path)[2]
    return f"{path}/versions/{name}" if name else None


def commit(spark: SparkSession, path: str, make: Callable[[str | None], DataFrame], fmt: str = "json") -> None:
    """The next version of a table. ``make`` gets the folder of the version that counts (None at
    first) and gives the new rows; it is called again if another writer came first."""
    for _ in range(TRIES):
        newest, _, name = _latest(spark, path)
        fresh = uuid.uuid4().hex
        make(f"{path}/versions/{name}" if name else None).write.format(fmt).save(f"{path}/versions/{fresh}")
        mine = newest + 1
        # Another writer may have passed a marker of ours that was still open.
        if create_once(spark, f"{path}/current/{mine:08d}", fresh) and _latest(spark, path)[1] == mine:
            return
    raise RuntimeError(f"{path} is written by others all the time")


def append_batch(rows: DataFrame, path: str, batch: str) -> bool:
    """Rows as one batch of an append-only table: whether they were added, as a batch that is there is not added again."""
    spark = rows.sparkSession
    # Any text may name a batch.
    name = hashlib.sha256(batch.encode()).hexdigest()
    if markers(spark, f"{path}/batches").get(name):
        return False
    attempt = uuid.uuid4().hex
    rows.write.parquet(f"{path}/rows/{attempt}")
    if create_once(spark, f"{path}/batches/{name}", attempt):
        return True
    if markers(spark, f"{path}/batches")[name] is None:
        # A writer died while it wrote the marker: the batch is not there, and its name is taken.
        fs, marker = _path(spark, f"{path}/batches/{name}")
        fs.delete(marker, False)
        return create_once(spark, f"{path}/batches/{name}", attempt)
    return False


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that are there, each once; ``schema`` is that of a table without any."""
    attempts = sorted(v for v in markers(spark, f"{path}/batches").values() if v)
    if not attempts:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*[f"{path}/rows/{a}" for a in attempts])
