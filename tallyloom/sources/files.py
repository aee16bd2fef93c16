"""Items, predictions, metrics, frames and manifests as files."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "item_id string, group string, category string, operands array<bigint>, carry string, params map<string,string>"
PREDICTION_TEXT = ITEM + (
    ", prompt string, response string, parsed string, truth string, rule_values map<string,string>, reference_rule string, classification string, "
    "yes_logp double, no_logp double, top_k array<struct<id:bigint,text:string,logprob:double>>, top_k_mass double"
)
TRAINING = "example_id string, a bigint, b bigint, true_sum bigint, target bigint, prompt string, completion string, carry string, answer_digits int, repeat_index int"
FRAME = (
    "run_id string, condition string, seed bigint, item string, task string, template string, category string, `group` string, coverage string, mirror_in_K boolean, "
    "answer_range string, t_coverage string, carry string, is_rule int, in_renorm_denom int, classification string, parsed string, truth string, reference_rule string, "
    "main_axis boolean, gate_id_rule_rate double, gate_id_n bigint"
)
RATES = "correct_rate double, rule_rate double, other_error_rate double, parse_fail_rate double, n_items bigint"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM).option("mode", "FAILFAST").json(path)


def write_items(items: DataFrame, path: str, order: list[str]) -> None:
    """One JSON object a line, in order, in one file: for manifests' small sets."""
    items.orderBy(*order).coalesce(1).write.mode("errorifexists").json(path)


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Predictions with their batch, the name of the file or of the folder of part files; answers that are a number, true or false, or null get a column for each type."""
    rows = spark.read.schema(PREDICTION_TEXT).json(path).withColumn("batch", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?(?:/[^/]*)?$", 1))
    for c in ("parsed", "truth"):
        rows = rows.withColumn(f"{c}_int", F.col(c).try_cast("bigint")).withColumn(f"{c}_bool", F.when(F.col(c).isin("true", "false"), F.col(c) == "true"))
    return rows.withColumn("rule_values", F.transform_values("rule_values", lambda _, v: v.try_cast("bigint"))).drop("parsed", "truth")


def read_metrics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each run, batch and rule of metrics files; no file is an error."""
    schema = (
        "run_id string, kind string, lesion_condition string, seed bigint, adapter string, "
        f"by_batch map<string,struct<`group`:string,scoring:string,n_items:bigint,primary_reference_rule:string,by_reference_rule:map<string,struct<{RATES.replace(' double', ':double').replace(' bigint', ':bigint')}>>>>"
    )
    runs = spark.read.schema(schema).option("multiLine", True).json(paths)
    if runs.isEmpty():
        raise FileNotFoundError(f"no metrics in {paths}")
    batches = runs.select("run_id", "kind", F.col("lesion_condition").alias("condition"), "seed", F.explode("by_batch").alias("batch", "b"))
    return batches.select("run_id", "kind", "condition", "seed", "batch", "b.group", "b.scoring", "b.n_items", F.explode("b.by_reference_rule").alias("reference_rule", "r")).select(
        "run_id", "kind", "condition", "seed", "batch", "group", "scoring", "reference_rule", "r.correct_rate", "r.rule_rate", "r.other_error_rate", "r.parse_fail_rate", F.col("n_items")
    )


def read_frame(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A frame with exactly its columns; a header that differs or another number of rows is an error."""
    df = spark.read.schema(FRAME).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows where the manifest has {rows}")
    return df


def write_frame(df: DataFrame, path: str) -> dict[str, Any]:
    """Write a frame where nothing is yet and give its manifest: columns and rows."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    return {"columns": df.columns, "rows": df.sparkSession.read.option("header", True).csv(path).count()}


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file of a folder, read where the data is."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_training(spark: SparkSession, path: str, sha256: str | None = None, rows: int | None = None) -> DataFrame:
    """Training rows, once the declared hash and number of rows are verified."""
    if sha256 is not None and [r.sha256 for r in file_hashes(spark, path).select("sha256").take(2)] != [sha256]:
        raise ValueError("the file's hash is not the manifest's")
    df = spark.read.schema(TRAINING).option("mode", "FAILFAST").json(path)
    if rows is not None and df.count() != rows:
        raise ValueError("the number of rows is not the manifest's")
    return df


def require(config: dict, dotted: str) -> Any:
    """A value of nested settings; a missing or null one is an error."""
    value: Any = config
    for part in dotted.split("."):
        value = value.get(part) if isinstance(value, dict) else None
        if value is None:
            raise KeyError(f"{dotted} is not set")
    return value
