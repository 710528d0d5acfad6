"""What several operators share: table access, bounded Arrow slices, written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Rows that Spark hands to Python at once are worked on in slices of about this many characters.
SLICE_CHARS = 4_000_000

#: Rows of a small written table that share a file.
FILE_ROWS = 4096

#: Stored bytes of documents that a task takes, and writes as one file, once every core has a task.
TASK_BYTES = 64 << 20

#: Bytes of a row group that a writer holds in memory, at most, however much its task writes.
GROUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores put before it until no column has it (case does not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Hold the session's batches to sizes that leave executors room: a task has several at a time, and rows hold whole texts or sets."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20), ("spark.sql.parquet.columnarReaderBatchSize", 512)):
        at_most(spark, key, most)


def at_most(spark: SparkSession, key: str, most: int) -> None:
    now = spark.conf.get(key, None)
    digits = "".join(c for c in now or "" if c in "-0123456789")
    if not digits or not 0 < int(digits) <= most:
        spark.conf.set(key, str(most))


def crc32_mod(column: str, modulus: int):
    """crc32 of the column's text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows whose texts hold about ``limit`` bytes together, with the texts (null: empty)."""
    col = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            part = batch.slice(start, i - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        part = batch.slice(start)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def map_texts(df: DataFrame, fn, schema: T.StructType | str, column: str = "text", limit: int = SLICE_CHARS) -> DataFrame:
    """Apply ``fn(part, texts) -> dict of columns`` slice by slice; the result has ``schema``."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, column, limit):
                made = fn(part, texts)
                yield pa.RecordBatch.from_arrays([made[f.name] if isinstance(made[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only where the session has none and all tasks run on this machine."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = existing.get() if existing.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'driftwell-checkpoints')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.

    A lost executor costs nothing that was written. The caller may ``drop`` the path when no
    plan reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftwell/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, in one partition for FILE_ROWS of them and no more than it has.

    Without it a table of few rows is written as a file for each shuffle partition, and on a local
    disk Hadoop starts three processes (chmod) for each.
    """
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def merged(docs: DataFrame) -> DataFrame:
    """``docs`` in a partition for TASK_BYTES of its files, in one for each core at least and no more than it has.

    On a local disk Hadoop starts three processes (chmod) for each file written, and each shares
    its executor's memory until it has a program of its own. Row groups are held to GROUP_BYTES, so
    that a larger file takes its writer no more memory and its readers can still divide it.
    """
    spark = docs.sparkSession
    at_most(spark, "parquet.block.size", GROUP_BYTES)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # where it is unknown: some huge number
    return docs.coalesce(min(max(-(-size // TASK_BYTES), spark.sparkContext.defaultParallelism), 2**31 - 1))


def drop(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Written tables of one job. On leaving, those that its lazy result does not read are removed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, name: str, read_later: bool = False) -> DataFrame:
        out, path = written(df, name)
        self.paths[path] = read_later
        return out

    def __exit__(self, *failed) -> None:
        for path, read_later in self.paths.items():
            if failed[0] or not read_later:
                drop(self.spark, path)


def spread_join(rows: DataFrame, known: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``known`` (one row for each ``key``), without one task that gets all rows of a key.

    ``weight`` says how many of ``total`` rows have the key. Keys with more than a 64th of them are
    64 at most: they are broadcast, and their rows stay where they are. Null keys are not joined.
    """
    more = [c for c in known.columns if c != key]
    hot = known.filter(F.col(weight) * 64 > total)
    marked = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")  # 64 rows at most
    cold = marked.filter("_hot is null").select(*rows.columns).join(known.filter(F.col(weight) * 64 <= total), key, "left")
    none = rows.filter(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in more))
    order = [*rows.columns, *more]
    return marked.filter("_hot").select(*order).unionByName(cold.select(*order)).unionByName(none.select(*order))
