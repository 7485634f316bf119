"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a class of a regular expression and as characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_LOWER = str.maketrans(UPPER, LOWER)


_SHIPPED = "tidemark.llm.shipped"


def importable(spark: SparkSession) -> None:
    """Ships this package to the executors, once for each application; they need no folder of the driver's."""
    sc = spark.sparkContext
    if sc.getLocalProperty(_SHIPPED) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tidemark-package-")  # the driver serves the file from here while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{root.name}_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    sc.setLocalProperty(_SHIPPED, sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach. Only a session in one process gets a local one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Staged:
    """Tables in the shared folder, deleted by `drop` or when the application ends."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: lineage ends there, and a lost executor loses nothing.

        The shuffle files of the write go when it has ended, so disk is held for one step at a time.
        """
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
        files, where = _folder(spark, path)
        files.deleteOnExit(where)
        self.paths.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the tables; whoever calls this has read them for the last time."""
        for spark, path in self.paths:
            files, where = _folder(spark, path)
            files.delete(where, True)
        self.paths = []


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """One table in the shared folder that stays until the application ends."""
    return Staged().table(df, name)


def crc_mod(doc_id: Column | str, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null doc_id counts as an empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")) % mod


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `most` bytes of `column`, a single longer value aside."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no column that Spark would take for it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_text(docs: DataFrame, function, fields: str, into: str, text: str = "text") -> DataFrame:
    """docs with the struct column `into` that function(list of texts) gives as a pyarrow array.

    function gets whole texts (null as an empty one), a few megabytes at a time.
    """
    from pyspark.sql import types as T

    importable(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(fields))])

    def run(batches):
        for batch in slices(batches, text):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, function(texts)], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)
