"""Helpers the operators share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The characters that separate words, as a regular expression
# class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE_CLASS}]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session in one process gets a temporary folder; on a
    cluster it is an error, as executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="obsq-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def store(rows: DataFrame) -> DataFrame:
    """Write rows to the shared folder once and read them from there.

    Cuts the lineage: what was computed survives the loss of any executor, is
    not computed again by a second use, and has a known size.
    """
    spark = rows.sparkSession
    path = f"{scratch_dir(spark)}/obsq-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return from_scratch(spark.read.schema(rows.schema).parquet(path), path)


def from_scratch(rows: DataFrame, *paths: str) -> DataFrame:
    """Note the stored tables that rows are read from, for `discard`."""
    rows._scratch_paths = paths
    return rows


def store_buckets(rows: DataFrame, key: str) -> DataFrame:
    """As ``store``, in buckets of a key by which later joins meet without shuffling the table.

    ``rows`` are dealt by ``repartition(n, key)`` with the session's shuffle partitions.
    """
    spark = rows.sparkSession
    name = f"obsq_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(n, key).saveAsTable(name)
    table = from_scratch(spark.table(name), path)
    table._scratch_table = name
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the tables that ``store`` wrote, once what was derived from them is written."""
    for rows in tables:
        spark = rows.sparkSession
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        if hasattr(rows, "_scratch_table"):
            spark.sql(f"DROP TABLE IF EXISTS {rows._scratch_table}")
        for name in getattr(rows, "_scratch_paths", ()):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each job once it has ended, not when the driver
    comes to collect its garbage; for code that runs many jobs and stores what it keeps."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def row_key(id_column: str, text_column: str) -> Column:
    """A key that equal rows share and different ones do not (128 bits).

    Ids may be null or repeat; rows with the same id and text are one document
    twice and get the same answers.
    """
    parts = [F.col(id_column).cast("string"), F.col(id_column).isNull(), F.col(text_column), F.col(text_column).isNull()]
    return F.concat(
        F.hex(F.xxhash64(*parts)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), *parts))
    )


def map_texts(
    rows: DataFrame,
    text_column: str,
    keep: Sequence[str | Column],
    schema: str,
    per_text: Callable[[list[str]], list[list]],
) -> DataFrame:
    """Columns ``keep`` beside what ``per_text`` makes of each text, in the JVM's order.

    ``per_text`` gets the texts of one batch (null as empty) and returns one list
    per column of ``schema``. A batch is a bounded number of rows and holds whole
    texts.
    """
    text = "_text_in"
    chosen = rows.select(*keep, F.col(text_column).cast("string").alias(text))
    added = StructType.fromDDL(schema)
    kept = [f for f in chosen.schema.fields if f.name != text]
    out = StructType(kept + added.fields)
    arrow = to_arrow_schema(out)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(text).to_pylist()]
                made = per_text(texts)
                columns = [part.column(n).cast(arrow.field(n).type) for n in names]
                columns += [
                    pa.array(values, type=arrow.field(len(names) + i).type)
                    for i, values in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return chosen.mapInArrow(run, out)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    bound: int,
    id_column: str = "doc_id",
    where: Column | None = None,
) -> DataFrame:
    """Rows of ``docs`` with a label, at most ``bound`` labels, chosen by a hash of the id.

    The bound makes the broadcast of the chosen labels safe. Labels other than 0
    and 1 and null ids are left out; a repeated id takes its largest label.
    """
    usable = labels.select(
        F.col(id_column).alias("_label_id"), F.col(label).cast("int").alias("_label")
    ).filter(F.col("_label").isin(0, 1) & F.col("_label_id").isNotNull())
    if where is not None:
        usable = usable.filter(where)
    chosen = (
        usable.groupBy("_label_id").agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_label_id"), "_label_id").limit(bound)
    )
    return docs.join(F.broadcast(chosen), F.col(id_column) == F.col("_label_id"))


def map_batches(
    rows: DataFrame,
    inputs: Sequence[Column],
    keep: Sequence[str | Column],
    schema: str,
    per_batch: Callable[..., list[list]],
) -> DataFrame:
    """Columns ``keep`` beside what ``per_batch`` makes of the values of ``inputs``.

    ``per_batch`` gets one list per input, of at most 1,024 rows, and returns one
    list per column of ``schema``.
    """
    names = [f"_in_{i}" for i in range(len(inputs))]
    chosen = rows.select(*keep, *[c.alias(n) for c, n in zip(inputs, names)])
    kept = [f for f in chosen.schema.fields if f.name not in names]
    out = StructType(kept + StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = per_batch(*[part.column(n).to_pylist() for n in names])
                columns = [part.column(f.name).cast(arrow.field(f.name).type) for f in kept]
                columns += [pa.array(v, type=arrow.field(len(kept) + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return chosen.mapInArrow(run, out)
