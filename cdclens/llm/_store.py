"""Where the operators keep what must outlive an executor: the shared folder of spark.checkpoint.dir.  Names, broadcasts and zips besides."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder.  Where the session names none, as in tests, one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def table(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared(spark, what)
    df.write.option("compression", codec).option("parquet.enable.dictionary", str(codec == "zstd").lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(), with a checkpoint folder set."""
    shared(df.sparkSession, "")
    return df.checkpoint()


#: Rows (about 40 bytes each) of a join side that may be broadcast, unless an operator says otherwise.
MAX_BROADCAST = 500_000


def hint(df: DataFrame, most: int | None = None) -> DataFrame:
    """To be broadcast if it has few rows; otherwise as it is, to be shuffled.  The rows are counted, so ``df`` should be a written table."""
    return F.broadcast(df) if df.count() <= (MAX_BROADCAST if most is None else most) else df


def names(taken: list[str] | DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores after it as makes it free, whatever the letters' case."""
    used = {c.lower() for c in (taken if isinstance(taken, list) else taken.columns)}
    out = []
    for w in wanted:
        while w.lower() in used:
            w += "_"
        used.add(w.lower())
        out.append(w)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the folders of written tables that nothing reads any more."""
    for t in tables:
        if folder := getattr(t, "folder", None):
            drop(t.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Has the shuffle files of written tables removed: Spark does that when the driver finds that nothing refers to them, which may be long after."""
    for pause in (0.5, 0):  # just after a job some of it is still held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(path: str):
    """(pyarrow file system, path in it) for executors to write and read whole files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def make(path: str) -> str:
    f, p = filesystem(path)
    f.create_dir(p, recursive=True)
    return path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def arrow_batches(spark: SparkSession) -> None:
    """Ready for Python workers: this package goes to the executors (a zip that the driver serves), and batches have
    bounded bytes, unless the session says how large."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "16777216")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if spark.sparkContext.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()  # the driver's own: it serves the file to the executors for as long as it lives
        atexit.register(shutil.rmtree, folder, True)
        to = Path(folder) / f"{root.name}.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(spark.sparkContext.applicationId)
