"""Shared storage of a session: checkpoints and work tables that outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL_DIR: list[str] = []


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per context, so that their Python workers can import it wherever the driver found it."""
    import io
    import os
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_siftline_shipped", False):
        return
    context._siftline_shipped = True
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith((".py", ".npz")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("siftline", os.path.relpath(path, root)))
    file = os.path.join(tempfile.mkdtemp(prefix="siftline-code-"), "siftline.zip")  # the driver's own; Spark serves it to executors
    with open(file, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(file)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``; a temporary one only on a local master, where that is unset."""
    conf = spark.sparkContext.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="siftline-"))
    return _LOCAL_DIR[0]


def work_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder for one job's work tables below the shared folder."""
    return f"{shared_dir(spark)}/siftline-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: later plans neither recompute them nor need the executors that made them."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows as compressed files in the shared folder, for as long as the session asks for them: smaller than a checkpoint of them."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table that is expected to be small is sent to every executor.
SMALL_ROWS = 10_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The table with a broadcast hint if a count shows that it is small; beyond that it is joined as any other, AQE splitting hot keys."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows up to which their keys are marked in bits that every executor gets, and bits a row: 32 MB at most, one in 16 others passes.
MARKED_ROWS, MARK_BITS = 16_000_000, 16


def among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of a large table whose key may be among those of ``wanted`` (all that are and a few others), so that a join of the two moves no more.

    wanted: rows that are cheap to read again. If they are so few that :func:`small` sends them to every executor the join moves nothing, and
    beyond ``MARKED_ROWS`` the table is given as it is.
    """
    from pyspark.sql import functions as F

    n = wanted.count()
    if not SMALL_ROWS < n <= MARKED_ROWS:
        return df
    place = F.pmod(F.xxhash64(key), F.lit(n * MARK_BITS))
    bucket, position = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    # all places of a bucket come together first: a bitmap is 4 kB however few of its bits are set
    marks = wanted.select(bucket.alias("_bucket"), position.alias("_position")).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_position").alias("_marks"))
    byte = F.conv(F.hex(F.substring("_marks", (F.floor(F.col("_position") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    placed = df.withColumns({"_bucket": bucket, "_position": position}).join(F.broadcast(marks), "_bucket")
    return placed.where(F.getbit(byte, F.pmod("_position", F.lit(8)).cast("int")) == 1).select(*df.columns)


_STORED: dict[tuple, object] = {}


def stored(spark: SparkSession, name: str, make):
    """What ``make()`` gives, made once in a Spark context: for indexes that many queries ask."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]
