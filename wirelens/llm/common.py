"""Helpers of the training-data operators."""

import os
import urllib.parse

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wirelens.session import scratch_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ASCII texts take the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def row_key(*columns) -> Column:
    """128 bits that stand for the values of ``columns``; nulls count as values.

    Rows that agree in all of them share a key, and then also the result of any per-document
    operator, so a join on the key never multiplies or swaps rows.
    """
    flags = [F.isnull(c) for c in columns]
    return F.struct(F.xxhash64(*columns, *flags).alias("a"), F.xxhash64(F.lit("k"), *columns, *flags).alias("b"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, even where the body uses it for every array element."""
    return F.transform(F.array(value), body)[0]


def landed(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, size is known to the planner."""
    spark = df.sparkSession
    path = scratch_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def parts_for(spark: SparkSession, amount: int, each: int) -> int:
    """Number of parts of about ``each`` bytes, and no fewer than the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def file_system(uri: str):
    """Arrow file system and path of a folder that Spark names by URI."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(uri).path)
    return pafs.FileSystem.from_uri(uri)


def publish(fs, path: str, attempt: str, write) -> None:
    """Write a file under a name of this attempt and rename it, so a repeated task leaves one whole file."""
    fs.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{attempt}"
    with fs.open_output_stream(own) as out:
        write(out)
    if fs.get_file_info(path).type == pafs.FileType.File:  # an earlier attempt has published the same content
        fs.delete_file(own)
    else:
        fs.move(own, path)
