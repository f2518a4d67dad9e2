"""Readers. All use fixed schemas; nothing is inferred and nothing is read that is not asked for."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import DOCUMENT_SCHEMA
from ..operators.runs import RUN_LOG_SCHEMA, config_label

EVENT_SCHEMA = ("t double, event string, n int, action struct<type:string,point:array<double>,point2:array<double>,"
                "text:string,direction:string,thought:string>, ok boolean, error string, changed boolean, "
                "elapsed double, subtask string, situation string, reason string, subtasks array<string>, "
                "success boolean, n_steps int, wall_time double, retries int, instruction string, task_id string, "
                "run_id string")

WEB_COLUMNS = ("annotation_id", "action_uid", "operation", "website", "domain", "subdomain",
               "confirmed_task", "action_reprs", "target_action_index", "target_action_reprs")

SPEC_SCHEMA = ("task_id int, intent string, intent_template string, intent_template_id int, "
               "instantiation_dict map<string,string>, sites array<string>, require_login boolean, "
               "eval struct<eval_types:array<string>>")


def _path_part(path, back: int):
    return F.try_element_at(F.split(path, "/"), F.lit(-back))


def root_length(spark: SparkSession, root: str) -> int:
    """Length of a folder's full path as file names spell it, without scheme and host."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    return len(full.toUri().getRawPath().rstrip("/"))


def only_missing(e: AnalysisException) -> None:
    """A path that is not there counts as empty; anything else is an error."""
    if e.getCondition() != "PATH_NOT_FOUND":
        raise e


def read_sessions(spark: SparkSession, root: str, schema: str = DOCUMENT_SCHEMA, pattern: str = "*.json") -> DataFrame:
    """JSON documents under ``root/<split>/.../<session>/<name>.json``: a file holds one, or several as an array.

    Adds path, file_name, split and a session id (the folder's name where the document has
    none). A file that cannot be read comes through with ``_corrupt_record`` set.
    """
    d = (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
         .option("pathGlobFilter", pattern).option("mode", "PERMISSIVE").json(root)
         .withColumn("path", F.col("_metadata.file_path")))
    # what lies below the root, cut off by length: names are not patterns
    rest = F.split(F.substring(F.regexp_replace("path", r"^\w+:(//[^/]*)?", ""), root_length(spark, root) + 2, 1 << 20), "/")
    return (d.withColumn("file_name", _path_part("path", 1)).withColumn("split", F.get(rest, F.lit(0)))
            .withColumn("session_id", F.coalesce("session_id", _path_part("path", 2)))
            .withColumn("image", F.concat(F.regexp_replace("path", r"/[^/]*$", ""), F.lit("/images/"),
                                          F.coalesce("saved_image_name", F.lit(""))))
            .withColumn("width", F.col("video_width")).withColumn("height", F.col("video_height")))


def unreadable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("_corrupt_record").isNotNull())


def file_inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Paths and sizes below a folder; the content column is pruned, so no file is opened."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .load(root).select(F.col("path").alias("image"), "length"))


def read_jsonl(spark: SparkSession, path, schema: str, limit: int | None = None, order=None) -> DataFrame:
    """Strict JSON lines: a bad line is an error. With ``limit`` the first rows in ``order``."""
    d = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if limit is None:
        return d
    return (d.orderBy(*([order] if isinstance(order, str) else order)) if order else d).limit(limit)


def decode_lines(lines: DataFrame, schema: str = EVENT_SCHEMA, value: str = "value") -> DataFrame:
    """Text lines to events; blank lines and lines that are not whole JSON are left out."""
    parsed = F.from_json(F.col(value), schema + ", _corrupt_record string", {"mode": "PERMISSIVE"})
    keep = [c for c in lines.columns if c != value]
    # as a generator: a filter on the parsed columns would be pushed below them and parse every line again
    whole = F.filter(F.array(parsed), lambda e: e.isNotNull() & e["_corrupt_record"].isNull())
    return lines.filter(F.trim(F.col(value)) != "").select(*keep, F.inline(whole)).drop("_corrupt_record")


def read_event_log(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Live log read back; a half-written last line is skipped, a missing file is an empty log."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        only_missing(e)
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return decode_lines(lines, schema)


def read_web_steps(spark: SparkSession, *paths: str, columns=WEB_COLUMNS) -> DataFrame:
    """The listed columns of a wide Parquet dataset; images and markup are never read."""
    return spark.read.parquet(*paths).select(*columns)


def list_shards(spark: SparkSession, folder: str, split: str, limit: int | None = None) -> list[str]:
    """Sorted shard paths ``<split>-*.parquet`` (files or folders); only names are listed, nothing is opened."""
    try:
        found = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{split}-*.parquet")
    except AnalysisException as e:
        only_missing(e)
        return []
    shard = F.regexp_extract("path", rf"^(.*/{split}-[^/]*\.parquet)", 1)
    d = found.select(shard.alias("shard")).distinct().orderBy("shard")
    return [r.shard for r in (d.limit(limit) if limit else d).collect()]


def read_shards(spark: SparkSession, folder: str, split: str, limit: int | None = None, columns=None) -> DataFrame:
    """The first ``limit`` shards of a named split."""
    names = list_shards(spark, folder, split, limit)
    if not names:
        raise FileNotFoundError(f"no shards of {split} in {folder}")
    d = spark.read.parquet(*names)
    return d.select(*columns) if columns else d


def read_task_specs(spark: SparkSession, path: str) -> DataFrame:
    """A whole-file JSON array of nested task specifications."""
    return spark.read.schema(SPEC_SCHEMA).option("multiLine", True).json(path)


def read_metadata(spark: SparkSession, path: str, drop=("image",)) -> DataFrame:
    """Everything but the heavy columns; they are pruned from the scan."""
    d = spark.read.parquet(path)
    return d.select(*[c for c in d.columns if c not in drop])


def read_run_logs(spark: SparkSession, path: str, glob: str = "tasks_*suite*.json") -> DataFrame:
    """Log documents per configuration; ``config`` comes from the name of the file, or of the folder that holds its parts.

    A file holds one document, or several as an array.
    """
    name = F.regexp_extract("_metadata.file_path", r"/([^/]+\.json)(?:/[^/]*)?$", 1)
    return (spark.read.schema(RUN_LOG_SCHEMA + ", _corrupt_record string").option("multiLine", True)
            .json(f"{path.rstrip('/')}/{glob}").withColumn("log", name).withColumn("config", config_label(F.col("log"))))


def read_split_expr(spark: SparkSession, root: str, expression: str, schema: str | None = None) -> DataFrame:
    """Several splits at once, e.g. ``"train+val"``; other partitions are not listed or read."""
    parts = [p.strip() for p in expression.split("+")]
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(root).filter(F.col("split").isin(*parts))


def read_manifest(spark: SparkSession, path: str) -> dict:
    """Build notes; the validation part counts as held out where nothing is noted."""
    try:
        rows = spark.read.schema("train_split string, val_is_held_out boolean").json(path).limit(1).collect()
    except AnalysisException as e:
        only_missing(e)
        rows = []
    d = rows[0].asDict() if rows else {}
    return {"train_split": d.get("train_split"),
            "val_is_held_out": True if d.get("val_is_held_out") is None else d["val_is_held_out"]}
