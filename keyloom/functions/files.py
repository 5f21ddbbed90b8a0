"""Files as ordered pieces: text of any size read by many tasks without a large file in one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that may be one value.
SMALL = 4 << 20
_PACKED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd)$"


def _small() -> Column:
    """Whether a file is plain and of at most ``SMALL`` bytes; Spark leaves out files by their size before it reads them."""
    return (F.col("_metadata.file_size") <= SMALL) & ~F.col("_metadata.file_name").rlike(_PACKED)


def small_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, data) of the small plain files below ``path`` that match ``pattern``, each whole, as bytes."""
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return text.where(_small()).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("data"))


def ordered_pieces(spark: SparkSession, path: str, separator: str, pattern: str = "*", above: bool = False) -> DataFrame:
    """(file, piece) of the files below ``path`` that match ``pattern``: what stands between separators, as bytes.

    ``above``: only of those that ``small_files`` leaves out.

    All pieces of a file are in one partition, in order, next to each other. Spark splits plain files
    and reads the splits in parallel, so pieces are dealt by file and sorted, on disk where need be, by
    split and place; a compressed file is one split.
    """
    text = spark.read.option("lineSep", separator).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    if above:
        text = text.where(~_small())
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("piece"))
    return rows.repartition("file").sortWithinPartitions("file", "start", "n").select("file", "piece")
