"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.shared import checkpointed, shared_folder

__all__ = ["SPACE", "checkpointed", "deleted", "literal_array", "n_words", "shared_folder", "table", "words"]

#: White space that separates words, as a Java regular expression: space and U+0009 to U+000D.
SPACE = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, as a long."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    # Only the first and the last part can be empty.
    empty = lambda x: F.when(x == "", 1).otherwise(0)
    return F.when(F.size(parts) == 1, 1 - empty(parts[0])).otherwise(F.size(parts) - empty(F.element_at(parts, 1)) - empty(F.element_at(parts, -1))).cast("long")


def deleted(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def literal_array(values) -> Column:
    """A constant array of doubles, folded once by the optimizer and not parsed again for each row."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")
