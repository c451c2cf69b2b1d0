"""Readers, writers and shared scratch space."""

from __future__ import annotations

import contextlib
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.fs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.filters import Predicate, where_all


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); in local mode a temporary one where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark.conf.get("bilatera.local.dir", None)
        if not path:
            path = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("bilatera.local.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    run = spark.conf.get(RUN, None)
    folder = f"{shared_folder(spark).rstrip('/')}/{run}" if run else shared_folder(spark).rstrip("/")
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


#: Session setting: free the shuffle files of finished plans at every lineage cut.
TIDY = "bilatera.tidy"
#: Session setting that names the folder of the current run.
RUN = "bilatera.run"


@contextlib.contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Everything that is written to the shared folder inside the block lies in a folder of its own, which goes at its end.

    Results must be used or written elsewhere before the block ends. Blocks may be nested; each removes its own folder.
    """
    before, run = spark.conf.get(RUN, None), f"run-{uuid.uuid4().hex[:12]}"
    spark.conf.set(RUN, run)
    try:
        yield run
    finally:
        if before:
            spark.conf.set(RUN, before)
        else:
            spark.conf.unset(RUN)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{run}")
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame, *, spent: Iterable[DataFrame] = (), compression: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: survives lost executors and shortens the plan.

    Shuffle files of the written plan stay until the driver collects its garbage. Where the session sets ``TIDY``, it does so now, which
    long jobs over large tables want. ``spent`` are tables of earlier cuts that nothing reads from now on; their files go after the write.
    ``compression`` is that of the files, where it is not the session's.
    """
    spark = df.sparkSession
    path = new_path(spark, "stage")
    df.write.parquet(path, compression=compression)
    for old in spent:
        _remove_cut(old)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Where the session sets ``TIDY``, free the shuffle files of plans that nobody holds, also those that only cycles in Python hold."""
    if spark.conf.get(TIDY, "false") == "true":
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _remove_cut(table: DataFrame) -> None:
    """Remove the folder of a table as ``cut_lineage`` returned it."""
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    if len(folders) != 1 or not next(iter(folders)).rsplit("/", 1)[1].startswith("stage-"):
        raise ValueError("only a table returned by cut_lineage can be removed")
    jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(next(iter(folders)))
    path.getFileSystem(conf).delete(path, True)


def scan_measurements(
    spark: SparkSession, path: str, rules: Iterable[Predicate] = (), *, require_thickness: bool = True
) -> DataFrame:
    """Measurement scan with an explicit schema; all rules are plain predicates and reach the scan."""
    df = spark.read.schema(S.MEASUREMENTS).parquet(path)
    if require_thickness:
        df = df.where(F.col("sample_thickness_mm").isNotNull())
    return where_all(df, rules)


def read_batch_rules(spark: SparkSession, path: str) -> DataFrame:
    """Batch reference table from a JSON document with a ``batch_table`` list; one key may be null."""
    doc = spark.read.schema("batch_table array<struct<%s>>" % _ddl(S.BATCH_RULE)).option("multiLine", True).json(path)
    return doc.select(F.inline("batch_table"))


def _ddl(schema) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema.fields)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """One JSON object per row, nested structs kept; a JSON dataset, written by every task in parallel."""
    df.write.mode("errorifexists").json(path)
    return path


def text_checksum(c) -> object:
    return F.sha2(c, 256)


def file_checksums(spark: SparkSession, path: str, block: int = 1 << 20) -> DataFrame:
    """SHA-256 of input files of any size, one task per file: the digest is sequential, the buffer constant."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # names and sizes only

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for name in rows["path"]:
                store, inner = pyarrow.fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if not name.startswith("file://") else name)
                h = hashlib.sha256()
                with store.open_input_stream(inner) as f:
                    while part := f.read(block):
                        h.update(part)
                out.append(h.hexdigest())
            yield rows.assign(sha256=out)

    return files.repartition(F.col("path")).mapInPandas(digest, "path string, length long, sha256 string")


def input_sha256(spark: SparkSession, path: str) -> str:
    """Digest of an input of one or many files: over the files' digests and lengths in order, so names and folders do not count."""
    files = file_checksums(spark, path)
    one = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "length", "sha256"))), "\n"), 256).alias("d"))
    return one.first()["d"]


def write_artifact(df: DataFrame, path: str, *, config_text: str, input_sha256: str) -> str:
    """Preprocessed rows plus a one-row lineage table."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    lineage = spark.range(1).select(
        F.lit(config_text).alias("config_text"), F.sha2(F.lit(config_text), 256).alias("config_sha256"),
        F.lit(input_sha256).alias("input_sha256"),
    )
    lineage.write.mode("errorifexists").parquet(f"{path}/lineage")
    return path


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an artifact; refused when config text or input checksum is missing."""
    row = spark.read.parquet(f"{path}/lineage").first()
    if row is None or not row["config_text"] or not row["input_sha256"]:
        raise ValueError("artifact lineage is incomplete: config text and input checksum are required")
    return spark.read.parquet(f"{path}/rows")
