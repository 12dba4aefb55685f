"""Files as resources: texts whole, other media as bytes; fetched through an injected transport where they are remote."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text

TEXT_MODALITIES = ("conversation", "text", "document")
AUDIO = ("mp3", "mp4", "mpeg", "mpga", "m4a", "wav", "webm")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(url, raw_text), one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("raw_text"))


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """(url, content, size), one row a file."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content", F.col("length").alias("size"))


def local_resources(spark: SparkSession, path: str, modality: str) -> DataFrame:
    """(url, modality, local_path, raw_text); only text modalities are read."""
    if modality in TEXT_MODALITIES:
        rows = texts(spark, path)
    else:
        rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.lit(None).cast("string").alias("raw_text"))
    return rows.select("url", F.lit(modality).alias("modality"), text.file_name(F.col("url"), F.lit(modality)).alias("local_path"), "raw_text")


def fetched(resources: DataFrame, fetch: Callable[[str], bytes], url: str = "url") -> DataFrame:
    """(url, content, error): every url through ``fetch``, on the executors, a batch a time; a failure is a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple[bytes | None, str | None]] = []
            for u in b.column(0).to_pylist():
                try:
                    got.append((fetch(u), None))
                except Exception as e:
                    got.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in got], pa.binary()), pa.array([e for _, e in got], pa.string())], ["url", "content", "error"])

    return resources.select(F.col(url).alias("url")).mapInArrow(run, "url string, content binary, error string")


def as_text(resources: DataFrame, modality: str = "modality", content: str = "content") -> DataFrame:
    """``raw_text`` of fetched text modalities, read as UTF-8."""
    return resources.withColumn("raw_text", F.when(F.col(modality).isin(*TEXT_MODALITIES), F.decode(content, "UTF-8")))


def audio_texts(files: DataFrame, transcribe: Callable[[F.Column, F.Column], F.Column], given: str = "raw_text", name: str = "url", content: str = "content") -> DataFrame:
    """The text given, else the transcript of an audio file, else the text of a text file, else null."""
    ending = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    made = F.when(ending.isin(*AUDIO), transcribe(F.when(ending.isin(*AUDIO), F.col(content)), F.col(name))).when(ending.isin("txt", "text"), F.decode(content, "UTF-8"))
    return files.withColumn("text", F.coalesce(F.nullif(F.trim(given), F.lit("")), made))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of another store; the driver jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def export_markdown(categories: DataFrame, path: str) -> None:
    """One folder per category with its summary as text."""
    rows = categories.select(F.regexp_replace("name", r"[^A-Za-z0-9_\-]+", "_").alias("name"), F.regexp_replace(F.coalesce("summary", F.lit("")), r"</?content>", "").alias("value"))
    rows.write.mode("overwrite").partitionBy("name").text(path)
