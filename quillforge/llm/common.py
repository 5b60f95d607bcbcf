"""Helpers that the corpus operators share: tables, the shared folder, and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a temporary folder is made once per application; on a cluster that
    is an error, as executors could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="quillforge-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return "file://" + _OWN[app]


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compact: bool = False) -> DataFrame:
    """Cut the lineage: write the frame into the shared folder and read it back.

    ``compact`` is for results much smaller than what they come from: they move once more, into files of a sensible size.
    """
    spark, path = df.sparkSession, fresh(df.sparkSession, what)
    (df.hint("rebalance") if compact else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, as single documents may be long (a session setting: it is read when a plan runs)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, under fixed names, so that other columns can't clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of an input with fewer file splits than the session has cores; larger inputs stay as they are.

    For work that costs much more a row than moving the row does. Sizes come from file metadata.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < split * cores else df


def train_side(id_col: Column) -> Column:
    """True for rows that a model may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 != 2, F.lit(False))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def lowest_hashes(df: DataFrame, key: Column, n: int, total: int | None = None) -> DataFrame:
    """At most ``n`` rows, those of the lowest hashes of the key, as a sample that is the same every time.

    A cut-off from the row count leaves about twice ``n`` rows before anything is sorted or sent, so what one task gathers
    does not grow with the table.
    """
    total = df.count() if total is None else total
    h = F.xxhash64(key)
    if total > 4 * n:
        df = df.where(h < F.lit(int(-(2**63) + 2**64 * (2 * n / total))))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if batch.num_rows:
            yield batch


def gathered(it: Iterable[pa.RecordBatch], rows: int = 4000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold that many rows or bytes, for work that gains from many rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches(it):
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def keep_rows(docs: DataFrame, text_col: str, decide: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """Rows whose text is decided to stay, with all their columns; no shuffle."""
    small_batches(docs.sparkSession)

    def run(it):
        for batch in batches(it):
            yield batch.filter(pa.array(decide(raw_texts(batch, text_col)), pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)
