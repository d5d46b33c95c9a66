"""Written state: append-only logs, versioned tables and preparation artifacts."""

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelens import schemas
from wirelens.operators.lessons import COLUMNS
from wirelens.operators.preparation import Scaler
from wirelens.sources.eve import CORRUPT, good_lines, read_json_lines


def append_json(df: DataFrame, path: str) -> None:
    """Queue entries, alerts or classifications as JSON lines; earlier lines stay untouched."""
    df.write.mode("append").json(path)


def append_once(path: str):
    """foreachBatch sink: each batch owns one folder, so a replayed batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")
    return write


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


class StoreConflict(RuntimeError):
    """Another writer has committed since the version that a change was computed from."""


def _versions(spark: SparkSession, root: str) -> tuple[list[tuple[int, str]], int]:
    """Complete versions (number, path), and the highest number any folder has (0 without)."""
    fs, path = _file_system(spark, root)
    if not fs.exists(path(root)):
        return [], 0
    names = [status.getPath().getName() for status in fs.listStatus(path(root))]
    found = sorted((int(n.split("=")[1].partition("-")[0]), f"{root}/{n}") for n in names if n.startswith("version="))
    return [v for v in found if fs.exists(path(f"{v[1]}/_SUCCESS"))], found[-1][0] if found else 0


def _batch_of(spark: SparkSession, done: list[tuple[int, str]]) -> int:
    """The last batch that the newest of some versions holds; -1 without any."""
    if not done:
        return -1
    fs, path = _file_system(spark, done[-1][1])
    if not fs.exists(path(f"{done[-1][1]}/_batch")):  # an older store names it in the folder
        return int(done[-1][1].rpartition("-batch-")[2]) if "-batch-" in done[-1][1].rpartition("/")[2] else -1
    held = fs.open(path(f"{done[-1][1]}/_batch"))
    try:
        return int(held.readLine())
    finally:
        held.close()


def _put_if_absent(spark: SparkSession, staged: str, target: str) -> bool:
    """Rename a folder unless the new name is taken."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path
    context = hadoop.FileContext.getFileContext(path(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(path(staged), path(target), none)
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise


def replace_table(df: DataFrame, root: str, keep: int = 2, batch: int | None = None, base: int | None = None) -> int:
    """Write a whole table as the next version; readers see the old one until it is complete.

    The table is written beside the versions and then renamed to the next number, which only one writer can
    get.  With ``base``, the number that ``df`` was computed from, another writer's commit since then raises
    StoreConflict and leaves the store as it is; without it the table takes the next free number.  The path being
    read is never overwritten, so a job may read the store it replaces.  A version holds the number of the last
    ``batch`` of a stream in it, taken over from the version before where none is given, so that table and
    batch number change in one step.  Older versions beyond ``keep`` are removed.  The file system must rename folders
    in one step, as HDFS does.
    """
    spark = df.sparkSession
    fs, path = _file_system(spark, root)
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    try:
        df.write.json(staged)
    except Exception as e:
        fs.delete(path(staged), True)
        if base is not None and _versions(spark, root)[1] != base:  # what it reads may have been removed meanwhile
            raise StoreConflict(f"{root}: version {base} is no longer the newest") from e
        raise
    while True:
        done, seen = _versions(spark, root)
        last = _batch_of(spark, done) if batch is None else batch
        with_batch = fs.create(path(f"{staged}/_batch"), True)
        with_batch.writeBytes(f"{last}\n")
        with_batch.close()
        version = (seen if base is None else base) + 1
        if version > seen and _put_if_absent(spark, staged, f"{root}/version={version}"):
            break
        if base is not None:
            fs.delete(path(staged), True)
            raise StoreConflict(f"{root}: version {version} was written by another job")
    for _, old in done[: max(0, len(done) + 1 - keep)]:
        fs.delete(path(old), True)
    return version


def latest_path(spark: SparkSession, root: str) -> str | None:
    done, _ = _versions(spark, root)
    return done[-1][1] if done else None


def applied_batch(spark: SparkSession, root: str) -> int:
    """The last batch of a stream that the newest version holds; -1 without any."""
    return _batch_of(spark, _versions(spark, root)[0])


def nest_lessons(flat: DataFrame) -> DataFrame:
    """Flat lesson columns to the stored nested form."""
    return flat.select(
        "lesson_id", "status", "source", "promotion_count", "promotion_threshold",
        F.struct("rule_id", "agent", "log_keywords").alias("pattern"),
        F.struct("severity", "action", "reason").alias("classification"),
        "created_at", "last_seen_at", "last_promoted_at", "hits", "ord")


def flatten_lessons(nested: DataFrame) -> DataFrame:
    inner = {"rule_id": "pattern", "agent": "pattern", "log_keywords": "pattern",
             "severity": "classification", "action": "classification", "reason": "classification"}
    return nested.select(*[F.col(f"{inner[c]}.{c}") if c in inner else F.col(c) for c in COLUMNS])


def save_lessons(flat: DataFrame, root: str, batch: int | None = None, base: int | None = None) -> int:
    return replace_table(nest_lessons(flat), root, batch=batch, base=base)


def update_lessons(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], batch: int | None = None,
                   attempts: int = 8) -> int:
    """Commit ``change(lessons)`` on the version it was computed from, and compute it again if another writer was first.

    So any number of jobs may change one store, and no change is lost.  A ``batch`` that the newest version holds already is not
    applied again.  Returns the number of the version; after ``attempts`` conflicts StoreConflict is raised.
    """
    for left in reversed(range(attempts)):
        done, seen = _versions(spark, root)
        if batch is not None and _batch_of(spark, done) >= batch:
            return done[-1][0]
        try:
            return save_lessons(change(_lessons_at(spark, done[-1][1] if done else None)), root, batch, seen)
        except StoreConflict:
            if not left:
                raise


def _lessons_at(spark: SparkSession, path: str | None) -> DataFrame:
    if path is None:
        return flatten_lessons(spark.createDataFrame([], schemas.LESSON))
    return flatten_lessons(good_lines(read_json_lines(spark, path, schemas.LESSON)))


def src_lessons(spark: SparkSession, root: str) -> DataFrame:
    """Newest version of a lesson store; no store yet gives an empty table."""
    return _lessons_at(spark, latest_path(spark, root))


def src_lesson_file(spark: SparkSession, path: str) -> DataFrame:
    """Lessons of a plain JSON-lines file, bad lines skipped, ordered as in the file.

    The order number is the line's place in its split; a missing file gives an empty table.
    """
    try:
        lines = read_json_lines(spark, path, schemas.LESSON)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition() or e):
            return flatten_lessons(spark.createDataFrame([], schemas.LESSON))
        raise
    placed = lines.withColumn("ord", F.coalesce("ord", F.monotonically_increasing_id()))
    return flatten_lessons(placed.where(F.col(CORRUPT).isNull()))


def save_prep_artifacts(spark: SparkSession, root: str, classes: list[str], scaler: Scaler) -> None:
    """Label map, scaler and feature order as small tables."""
    labels = spark.createDataFrame(list(enumerate(classes)), "class_id int, label string")
    labels.coalesce(1).write.mode("overwrite").parquet(f"{root}/labels")
    scaler.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{root}/scaler")


def load_prep_artifacts(spark: SparkSession, root: str) -> tuple[list[str], Scaler]:
    labels = spark.read.parquet(f"{root}/labels").orderBy("class_id").collect()
    rows = spark.read.parquet(f"{root}/scaler").orderBy("pos").collect()
    return ([r.label for r in labels],
            Scaler([r.feature for r in rows], [r.mean for r in rows], [r.scale for r in rows]))


def save_mark(spark: SparkSession, root: str, **marks) -> None:
    """Watermark state (last alert id, last summary time, ...) as the next one-row version."""
    row = spark.createDataFrame([(json.dumps(marks, sort_keys=True),)], "marks string")
    replace_table(row.coalesce(1), root)


def load_mark(spark: SparkSession, root: str) -> dict:
    path = latest_path(spark, root)
    if path is None:
        return {}
    return json.loads(spark.read.schema("marks string").json(path).first().marks)


def write_report(rows: DataFrame, path: str) -> None:
    """Report lines as text files, header lines in their own folder before the audit lines."""
    rows.select("section", F.col("line").alias("value")).write.mode("overwrite").partitionBy("section").text(path)
