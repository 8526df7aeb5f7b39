"""What the training-data operators share: reading, checkpoints, column helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Byte limit of one Arrow batch sent to a Python worker, so that a few long texts never meet in one batch.
BATCH_BYTES = "16777216"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, let shuffle files go early, and see that a checkpoint folder is set.

    On a cluster the folder comes from ``spark.checkpoint.dir``; a local one is
    made only where that is unset and the session runs inside one JVM.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # shuffle files go when the job that wrote them ends; what is read again is stored or checkpointed
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="citewright-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder; its lineage ends there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns whose names an operator is about to give to its results."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo the divisor; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def map_batches(df: DataFrame, keep: list[str], inputs: list[Column], fields: str, start) -> DataFrame:
    """The columns ``keep`` of df, and ``fields`` (DDL) as ``start()(*inputs)`` computes them.

    ``start`` is called once in a task; what it returns gets Arrow arrays of the
    inputs, batch by batch, and returns one array for each field.
    """
    prepare(df.sparkSession)
    source = df.select([F.col(f"`{c}`") for c in keep] + [c.alias(f"__in{i}") for i, c in enumerate(inputs)])
    added = StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in added]
    schema = StructType([source.schema[i] for i in range(len(keep))] + list(added))
    names, n = schema.names, len(keep)

    def run(batches):
        made = start()
        for b in batches:
            if b.num_rows:
                new = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made(*b.columns[n:]), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *new], names)

    return source.mapInArrow(run, schema)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def lowered_words(text: bytes) -> list[bytes]:
    """Words between [\\x20\\x09-\\x0D], A-Z lower-cased: what bytes.lower() and split() do."""
    return text.lower().split()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, deleted when this process ends."""
    prepare(spark)
    context = spark.sparkContext
    path = f"{context._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    jvm_path = context._jvm.org.apache.hadoop.fs.Path(path)

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may be gone, and its folders with it
            jvm_path.getFileSystem(context._jsc.hadoopConfiguration()).delete(jvm_path, True)

    atexit.register(remove)
    return path


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The rows of df as Parquet in the shared folder, in folders for each value of ``by``: lineage ends, and later reads take only their columns."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows joined to aggregates of them, one for each value of ``on``; ``size`` is a group's number of rows.

    Groups of a thousandth of the rows or more, of which there are at most a
    thousand, are broadcast, so that no task gets all rows of one. Both inputs are
    read several times and should be stored.
    """
    hot = F.col(size) * 1000 >= total
    if not groups.filter(hot).take(1):
        return rows.join(groups, on)
    marked = rows.join(F.broadcast(groups.filter(hot)), on, "left")
    rest = marked.filter(F.col(size).isNull()).select(rows.columns).join(groups.filter(~hot), on)
    return marked.filter(F.col(size).isNotNull()).unionByName(rest)
