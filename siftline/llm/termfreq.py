"""Frequencies of all terms over the shards of a corpus: recursive radix partitions, aggregated out of core with DuckDB.

1. Each shard counts once: of the rows whose maps are not null, the one written last. It is found by ids and times alone; the
   maps are read where they lie and never move.
2. The maps' entries become rows and are summed per batch, so a term that most shards hold is a few rows, and written to the
   shared folder, partitioned by the first hash bits of the term.
3. The partitions larger than ``LEAF_BYTES`` are written again by the next bits, all those of a level in one job without a
   shuffle, and so on; a partition stays whole when its bits are used up or when splitting did not divide it (one term).
4. Leaves are put together to tasks of up to ``LEAF_BYTES``: DuckDB, with a memory limit and a spill folder in the shared
   folder, sums them. (Where that folder is no plain path, DuckDB can't spill into it: leaves are then an eighth as large, so
   that they fit into its memory.)
5. The sums are kept by a checkpoint and the work folders removed.

The driver sees the partitions' sizes, never a term. Null maps of a shard count as empty beside one that is not null; a term
only in ``term_to_id`` has zero counts; null counts are zero. Bands: in fewer than ``rare`` chunks, in more than ``common`` of
all chunks, else ``useful``. Empty tables give an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.plans.shared import cut, small, work_dir

#: Hash bits of one level, levels at most, and the bytes (as stored) up to which a partition is a leaf.
BITS, LEVELS, LEAF_BYTES = 5, 6, 48 << 20
MEMORY = "400MB"
ROWS = "term string, chunks bigint, occurrences bigint"
#: Shards (some thirty bytes each) up to which what tells their rows is sent to every task.
FEW = 500_000


def _whole(states: DataFrame) -> DataFrame:
    """Rows whose maps are not null."""
    return states.where(F.col("nd").isNotNull() | F.col("term_to_id").isNotNull())


def shards(states: DataFrame) -> DataFrame:
    """``shard_id, document_count, written_at, n``: what tells the row that counts of each shard, and how many rows it tells;
    combined before the shuffles, and without the maps."""
    each = _whole(states).groupBy("shard_id", "written_at", "document_count").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("shard_id").agg(F.max(F.struct("written_at", "document_count", "n")).alias("s")).select("shard_id", "s.*")


def entries(states: DataFrame, one_each: DataFrame) -> DataFrame:
    """``term, chunks, occurrences`` for each counting row and term of any of its maps. Maps move only of shards whose last row came
    several times at one time, and then after a first choice in each task."""
    zero = F.lit(0).cast("bigint")
    some = lambda v: F.coalesce(v, F.lit(0)).cast("bigint")
    none = F.array().cast("array<struct<term:string,chunks:bigint,occurrences:bigint>>")

    def listed(name: str, chunks: bool, occurrences: bool):
        """The entries of a map as structs; a count that is not its own is zero."""
        made = lambda e: F.struct(e["key"].alias("term"), (some(e["value"]) if chunks else zero).alias("chunks"), (some(e["value"]) if occurrences else zero).alias("occurrences"))
        return F.coalesce(F.transform(F.map_entries(name), made), none)

    every = F.concat(listed("nd", True, False), listed("term_count", False, True), listed("term_to_id", False, False))
    key = small(one_each.select(*[F.col(c).alias(f"_{c}") for c in ("shard_id", "written_at", "document_count", "n")]), FEW)
    rows = _whole(states)
    same = rows["shard_id"].eqNullSafe(key["_shard_id"]) & rows["written_at"].eqNullSafe(key["_written_at"]) & rows["document_count"].eqNullSafe(key["_document_count"])
    held = rows.join(key, same).select("_shard_id", "_n", every.alias("entries"))
    once = held.where("_n = 1").select(F.inline("entries"))
    if not one_each.where("n > 1").head(1):
        return once
    return once.unionByName(held.where("_n > 1").groupBy("_shard_id").agg(F.first("entries").alias("entries")).select(F.inline("entries")))


def _combine(batches):
    """Sums of a partition's batches, so far as they are alike."""
    import pyarrow as pa

    names, held, rows = None, [], 0

    def summed():
        t = pa.Table.from_batches(held).group_by("term").aggregate([("chunks", "sum"), ("occurrences", "sum")])
        return t.select(["term", "chunks_sum", "occurrences_sum"]).rename_columns(["term", "chunks", "occurrences"])

    for batch in batches:
        names = batch.schema.names
        held.append(batch)
        rows += batch.num_rows
        if rows >= 500_000:
            t = summed()
            if t.num_rows > 250_000:
                yield from t.to_batches(max_chunksize=50_000)
                held, rows = [], 0
            else:
                held, rows = t.combine_chunks().to_batches(), t.num_rows
    if held and names:
        yield from summed().to_batches(max_chunksize=50_000)


def _sizes(spark, folder: str) -> dict[int, int]:
    """Bytes of each partition of a written level, from the file system that holds it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("radix="):
            found[int(name[6:])] = fs.getContentSummary(status.getPath()).getLength()
    return found


def remove(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def leaves(rows: DataFrame, root: str, leaf_bytes: int = LEAF_BYTES) -> list[tuple[str, int]]:
    """Write the rows in radix partitions, the oversized ones of each level again by more bits; the leaves' folders and bytes. One job a level."""
    spark = rows.sparkSession
    done, parents, level = [], {}, 0
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) >> BITS)  # tasks that write one of the first partitions
    while rows is not None:
        folder = f"{root}/level={level}"
        # the first bits of the term's hash: a partition's number begins with its parent's
        keyed = rows.withColumn("radix", F.shiftrightunsigned(F.xxhash64("term"), 64 - BITS * (level + 1)))
        if level == 0:
            keyed = keyed.repartition(F.col("radix"), F.pmod(F.xxhash64("chunks", "occurrences"), F.lit(spread)))
        keyed.write.partitionBy("radix").parquet(folder)
        sizes, again = _sizes(spark, folder), []
        for radix, size in sizes.items():
            if size <= leaf_bytes or level + 1 >= LEVELS or level and size > 0.9 * parents[radix >> BITS]:
                done.append((f"{folder}/radix={radix}", size))
            else:
                again.append(f"{folder}/radix={radix}")
        rows = spark.read.schema(ROWS).parquet(*again) if again else None
        parents, level = sizes, level + 1
    return done


def together(found: list[tuple[str, int]], size: int, least: int) -> list[list[str]]:
    """Leaves put into tasks of up to ``size`` bytes, at least ``least`` tasks if there are as many leaves."""
    room = max(1, min(size, sum(n for _, n in found) // max(1, least)))
    tasks, held = [[]], 0
    for folder, n in sorted(found):
        if tasks[-1] and held + n > room:
            tasks.append([])
            held = 0
        tasks[-1].append(folder)
        held += n
    return [t for t in tasks if t]


def local(folder: str) -> str:
    """The path of a ``file:`` folder."""
    return re.sub("^file:/*", "/", folder)


def _aggregate(memory: str, spill: str | None):
    def run(batches):
        import os
        import shutil
        import uuid

        import duckdb
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            for folders in batch.column(0).to_pylist():
                own = os.path.join(spill, uuid.uuid4().hex) if spill else ""
                con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False, "temp_directory": own})
                query = "SELECT term, sum(chunks)::BIGINT AS chunks, sum(occurrences)::BIGINT AS occurrences FROM {} GROUP BY term"
                if spill:
                    files = ", ".join("'" + local(f).replace("'", "''") + "/*.parquet'" for f in folders)
                    reader = con.sql(query.format(f"read_parquet([{files}], hive_partitioning = false)")).fetch_arrow_reader(50_000)
                else:  # another shared file system: its files, one after another, go into DuckDB's own table
                    con.execute("CREATE TABLE leaf (term VARCHAR, chunks BIGINT, occurrences BIGINT)")
                    for folder in folders:
                        fs, at = pafs.FileSystem.from_uri(folder)
                        for info in fs.get_file_info(pafs.FileSelector(at)):
                            if info.path.endswith(".parquet"):
                                part = pq.read_table(info.path, filesystem=fs, columns=["term", "chunks", "occurrences"])  # noqa: F841
                                con.execute("INSERT INTO leaf SELECT * FROM part")
                    reader = con.sql(query.format("leaf")).fetch_arrow_reader(50_000)
                yield from reader
                con.close()
                if own:
                    shutil.rmtree(own, ignore_errors=True)

    return run


def count_terms(states: DataFrame, leaf_bytes: int = LEAF_BYTES) -> tuple[DataFrame, DataFrame]:
    """All terms with ``chunks`` and ``occurrences``; and one row with the number of all chunks."""
    spark = states.sparkSession
    root = work_dir(spark, "radix")
    plain = root.startswith(("file:", "/"))
    leaf_bytes = leaf_bytes if plain else max(1, leaf_bytes // 8)
    one_each = cut(shards(states))
    rows = entries(states, one_each).where(F.col("term").isNotNull()).mapInArrow(_combine, ROWS)
    found = leaves(rows, root, leaf_bytes)
    total = one_each.agg(F.coalesce(F.sum("document_count"), F.lit(0)).alias("all_chunks"))
    if not found:
        remove(spark, root)
        return spark.createDataFrame([], ROWS), total
    tasks = together(found, leaf_bytes, spark.sparkContext.defaultParallelism)
    listed = spark.createDataFrame([(t,) for t in tasks], "folders array<string>").repartition(len(tasks))
    spill = local(f"{root}/spill") if plain else None
    terms = cut(listed.mapInArrow(_aggregate(MEMORY, spill), ROWS))
    remove(spark, root)
    return terms, total


def bands(states: DataFrame, rare: int = 3, common: float = 0.2, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``term, chunks, occurrences, band`` of every term."""
    terms, total = count_terms(states, leaf_bytes)
    marked = terms.crossJoin(F.broadcast(total))  # one row
    band = F.when(F.col("chunks") < rare, "rare").when(F.col("chunks") > common * F.col("all_chunks"), "common").otherwise("useful")
    return marked.select("term", "chunks", "occurrences", band.alias("band"))


def find(states: DataFrame) -> DataFrame:
    """The terms that are too rare or too common to be useful."""
    return bands(states).where("band <> 'useful'").select("term", "band")
