"""Labelled flow tables, dimension files and text logs."""

import re
from datetime import datetime, timedelta
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wirelens import constants as K, schemas
from wirelens.functions.numeric import named
from wirelens.operators.preparation import Scaler


def _union_promoted(parts: list[DataFrame]) -> DataFrame:
    """Tables under one another by column name; a column of several types takes the widest: whole numbers
    become long, other numbers double, anything else text."""
    types = {}
    for part in parts:
        for field in part.schema.fields:
            types.setdefault(field.name, set()).add(field.dataType)

    def common(found):
        if len(found) == 1 or not all(isinstance(t, T.NumericType) for t in found):
            return next(iter(found)) if len(found) == 1 else T.StringType()
        return T.LongType() if all(isinstance(t, T.IntegralType) for t in found) else T.DoubleType()
    wanted = {name: common(found) for name, found in types.items()}
    cast = [p.select(*[named(c).cast(wanted[c]).alias(c) for c in p.columns]) for p in parts]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), cast)


def _csv_groups(spark: SparkSession, folder: str) -> list[list[str]]:
    """The CSV files below a folder, those with the same header line together."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder)
             .select("value", "_metadata.file_path", "_metadata.file_block_start"))
    # ids rise along a split, so the smallest one of a file's first split is its header
    heads = (lines.where("file_block_start = 0").withColumn("at", F.monotonically_increasing_id())
             .groupBy("file_path").agg(F.min_by("value", "at").alias("head")))
    groups = heads.groupBy("head").agg(F.array_sort(F.collect_list("file_path")).alias("paths")).collect()
    return sorted(g.paths for g in groups)  # paths only: the driver lists them for any read


def src_flow_table(spark: SparkSession, folder: str, features: list[str] | None = None) -> DataFrame:
    """The ``train-*.parquet`` shards of a folder, else its CSV files, as one table.

    Columns meet by name (without outer blanks in CSV headers), whatever their order or type in a file; a
    column that a file lacks is null there.  CSV needs no scan to infer types when ``features`` names
    the numeric columns; all other columns are text.
    """
    shards = f"{folder}/train-*.parquet"
    try:
        return spark.read.option("mergeSchema", "true").parquet(shards)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
    except Py4JJavaError as e:
        if "CANNOT_MERGE_SCHEMAS" not in str(e.java_exception):
            raise
        files = spark.read.format("binaryFile").load(shards).select("path").collect()
        by_schema = {}
        for row in files:  # footers only; shards of one schema are read together
            by_schema.setdefault(spark.read.parquet(row.path).schema.json(), []).append(row.path)
        return _union_promoted([spark.read.parquet(*paths) for paths in by_schema.values()])
    try:
        groups = _csv_groups(spark, folder)
    except AnalysisException as e:
        raise FileNotFoundError(f"No parquet or CSV files found in {folder}") from e
    if not groups:
        raise FileNotFoundError(f"No parquet or CSV files found in {folder}")
    wanted = set(features or [])
    parts = []
    for paths in groups:
        part = spark.read.option("header", True).option("inferSchema", features is None).csv(paths)
        part = part.toDF(*[c.strip() for c in part.columns])
        parts.append(part.select(*[named(c).try_cast("double").alias(c) if c in wanted else named(c)
                                   for c in part.columns]))
    return _union_promoted(parts)


def _json_document(spark: SparkSession, path: str, schema: T.StructType):
    """One small JSON file as a row, or None if the file is absent."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition() or e):
            return None
        raise


def load_scaler(spark: SparkSession, path: str, expected: list[str] = K.FEATURES_25) -> Scaler:
    """Scaler file {mean[], scale[], features[]}; names and counts must match the contract."""
    numbers = T.ArrayType(T.DoubleType())
    row = _json_document(spark, path, T.StructType([
        T.StructField("mean", numbers), T.StructField("scale", numbers),
        T.StructField("features", T.ArrayType(T.StringType()))]))
    if row is None:
        raise FileNotFoundError(path)
    if list(row.features or []) != list(expected):
        raise ValueError("Feature name mismatch between scaler and extractor")
    return Scaler(list(row.features), list(row.mean), list(row.scale))


def load_allowlist(spark: SparkSession, path: str) -> list[dict]:
    """Rules of an allowlist file in file order; a missing file gives no rules.  Keys that are
    absent stay absent (wildcards); descriptions are ignored."""
    row = _json_document(spark, path, T.StructType([
        T.StructField("rules", T.ArrayType(T.StructType(schemas.ALLOWLIST_RULE)))]))
    rules = (row.rules if row else None) or []
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in rules]


def load_feature_manifest(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The 78 names and the reduced names; both must agree with the built-in contract."""
    names = T.ArrayType(T.StringType())
    row = _json_document(spark, path, T.StructType([
        T.StructField("features_78", names), T.StructField("features_suricata_25", names)]))
    if row is None:
        raise FileNotFoundError(path)
    if list(row.features_78) != K.FEATURES_78 or list(row.features_suricata_25) != K.FEATURES_25:
        raise ValueError("feature manifest differs from the feature contract")
    return list(row.features_78), list(row.features_suricata_25)


def sid_suppress_config(spark: SparkSession, path: str) -> DataFrame:
    """Signature ids of the ``suppress`` lines of a threshold file."""
    line = F.trim("value")
    sid = F.regexp_extract(line, r"^suppress\b.*\bsig_id\s+(\d+)", 1)
    return (spark.read.text(path).select(sid.alias("sid")).where(F.col("sid") != "")
            .select(F.col("sid").cast("long")).distinct())


def sid_limit_config(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(sid, count, seconds) of the ``threshold ... type limit, track by_src`` lines.  A threshold
    file is configuration and small; it is returned as a list for ``sid_rate_limit``."""
    lines = spark.read.text(path).where(
        F.col("value").rlike(r"^\s*threshold\b.*type\s+limit.*track\s+by_src")).collect()
    found = [tuple(int(re.search(rf"\b{name}\s+(\d+)", r.value).group(1)) for name in ("sig_id", "count", "seconds"))
             for r in lines]
    return sorted(found)


def notify_log_scan(spark: SparkSession, path: str, as_of: datetime, marker: str = "sent",
                    back: timedelta = timedelta(hours=8)) -> int:
    """Lines of a text log not older than ``back`` that contain ``marker``; lines without a
    leading time are ignored and a missing log counts none."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition() or e):
            return 0
        raise
    stamp = F.try_to_timestamp(F.substring("value", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    recent = stamp >= F.lit((as_of - back).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    return lines.where(recent & F.contains("value", F.lit(marker))).count()
