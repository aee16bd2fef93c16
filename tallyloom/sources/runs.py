"""Run folders: chosen prediction files, metrics by pattern, verified frames, what a run writes, and what it was made from.

A run's folder holds config.yaml, metrics.json, timestamp.txt and predictions/<batch>.jsonl, each batch a file or a folder of part
files. Settings, metrics and manifests are small and read on the driver; predictions, frames and training pairs are tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import frames
from tallyloom.operators.compare import require_unique

from .files import FRAME, PREDICTION_TEXT, canonical_json, file_hashes, read_predictions, require, sha256_text

# Names in a run's folder, of the files of an arm and of a sweep, and the kind of run that has rates.
PREDICTIONS, METRICS, CONFIG = "predictions", "metrics.json", "config.yaml"
ARM_FILE, ARM_PARTS = "{prefix}_M{radius}_s{seed}", r"^(.+)_M(\d+)_s(\d+)$"
SWEEP_FILE, SWEEP_PARTS = "threshold_sweep.{task}", r"^threshold_sweep\.(.+)$"
FRAME_CSV, FRAME_MANIFEST = "frame.csv", "frame_manifest.json"
EVAL_KIND = "battery_eval"


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and then renamed onto it in one step."""
    fs, p = _place(spark, path)
    _, beside = _place(spark, path + ".partial")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(p), how)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole; a missing one is an error."""
    row = spark.read.text(path, wholetext=True).first()
    return "" if row is None else row[0]


def write_json(spark: SparkSession, path: str, payload: Any) -> None:
    write_text(spark, path, json.dumps(payload, ensure_ascii=False, indent=2) + "\n")


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))


def load_settings(spark: SparkSession, path: str) -> dict:
    """A YAML file."""
    import yaml

    return yaml.safe_load(read_text(spark, path)) or {}


def metrics_paths(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Metrics files that the patterns name, by themselves or by their folder, each once and in order; none at all is an error."""
    found = set()
    for pattern in patterns:
        fs, p = _place(spark, pattern)
        for status in fs.globStatus(p) or []:
            path = status.getPath()
            if status.isDirectory():
                path = spark._jvm.org.apache.hadoop.fs.Path(path, METRICS)
            if path.getName() == METRICS and fs.exists(path):
                found.add(path.toString())
    if not found:
        raise FileNotFoundError(f"no {METRICS} in {list(patterns)}")
    return sorted(found)


def _batches(spark: SparkSession, run: str, names: Iterable[str]) -> DataFrame:
    """Predictions of named batches only: other files are not listed. A missing one is an error."""
    return read_predictions(spark, [f"{run}/{PREDICTIONS}/{n}.jsonl" for n in names])


def read_keyed(spark: SparkSession, run: str) -> DataFrame:
    """All predictions of a run; a (batch, item_id) that occurs twice is an error."""
    rows = read_predictions(spark, f"{run}/{PREDICTIONS}/*.jsonl")
    require_unique(rows, ["batch", "item_id"])
    return rows


def read_arms(spark: SparkSession, run: str, arms: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Predictions of the arms (prefix, radius, seed), which are columns too."""
    rows = _batches(spark, run, [ARM_FILE.format(prefix=p, radius=r, seed=s) for p, r, s in arms])
    part = lambda i: F.regexp_extract("batch", ARM_PARTS, i)
    return rows.select("*", part(1).alias("prefix"), part(2).cast("int").alias("radius"), part(3).cast("bigint").alias("arm_seed"))


SWEEP = "sweep_cell string, coverage string, polarity string, t bigint, threshold bigint, threshold_offset bigint, answer boolean, truth boolean"


def read_sweep(spark: SparkSession, run: str, tasks: Sequence[str]) -> DataFrame:
    """Answers of a threshold sweep, with `task` from the name of each task's file."""
    schema = PREDICTION_TEXT.replace(" truth string,", "") + ", " + SWEEP
    rows = spark.read.schema(schema).json([f"{run}/{PREDICTIONS}/{SWEEP_FILE.format(task=t)}.jsonl" for t in tasks])
    return rows.withColumn("task", F.regexp_extract(_batch_name(), SWEEP_PARTS, 1))


def _batch_name() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl(?:/[^/]*)?$", 1)


def read_responses(spark: SparkSession, run: str) -> DataFrame:
    """batch, group, item_id, response of all predictions; only these fields are read. No response at all is an error."""
    rows = spark.read.schema("item_id string, `group` string, response string").json(f"{run}/{PREDICTIONS}/*.jsonl")
    if rows.isEmpty():
        raise ValueError(f"no responses in {run}")
    return rows.select(_batch_name().alias("batch"), "group", "item_id", "response")


def write_predictions(rows: DataFrame, run: str, name: str) -> None:
    """A batch's records as JSON lines, nulls included, where nothing is yet; parts are written in parallel."""
    rows.write.option("ignoreNullFields", False).mode("errorifexists").json(f"{run}/{PREDICTIONS}/{name}.jsonl")


def write_csv(rows: DataFrame, path: str) -> None:
    """A table as CSV with a header and line feeds, where nothing is yet."""
    rows.write.option("header", True).option("lineSep", "\n").mode("errorifexists").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV whose header is exactly the schema's names, in order; rows that do not fit are an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def _content_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted names and hashes of a table's files: few rows, whatever the table's size."""
    rows = file_hashes(spark, path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "sha256")
    return sha256_text(canonical_json(sorted(map(list, rows.where(~F.col("name").startswith("_")).collect()))))


def freeze_frame(frame: DataFrame, folder: str, runs: Sequence[Mapping[str, Any]] = (), problems: Sequence[str] = ()) -> dict[str, Any]:
    """Write a frame and its manifest (columns, rows, hash, runs) into a new folder. A frame with problems, or a folder that exists, is an error."""
    spark = frame.sparkSession
    if problems:
        raise ValueError(f"a frame with problems is not written: {list(problems)}")
    if exists(spark, folder):
        raise FileExistsError(folder)
    write_csv(frame, f"{folder}/{FRAME_CSV}")
    n = spark.read.option("header", True).csv(f"{folder}/{FRAME_CSV}").count()
    manifest = {"columns": frame.columns, "n_rows": n, "csv": FRAME_CSV, "csv_sha256": _content_hash(spark, f"{folder}/{FRAME_CSV}"), "runs": list(runs), "problems": []}
    write_json(spark, f"{folder}/{FRAME_MANIFEST}", manifest)
    return manifest


def read_frozen_frame(spark: SparkSession, folder: str, schema: str = FRAME) -> DataFrame:
    """A frozen frame that still is what its manifest says: hash, columns, rows, and no problems recorded."""
    manifest, path = read_json(spark, f"{folder}/{FRAME_MANIFEST}"), f"{folder}/{FRAME_CSV}"
    if manifest.get("problems"):
        raise ValueError(f"the manifest has problems: {manifest['problems']}")
    if _content_hash(spark, path) != manifest["csv_sha256"]:
        raise ValueError(f"{path} is not what was frozen")
    df = read_csv(spark, path, schema)
    if df.columns != manifest["columns"] or df.count() != manifest["n_rows"]:
        raise ValueError(f"columns or rows of {path} are not the manifest's")
    return df


def write_job_list(spark: SparkSession, path: str, settings: Mapping[str, Any], jobs: Iterable[tuple[str, str]]) -> None:
    """key=value lines and a fit=input|output line for each job, for a fitter outside. Truth values are written small, lists with commas."""

    def plain(v):
        return str(v).lower() if isinstance(v, bool) else ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)

    lines = [f"{k}={plain(v)}" for k, v in settings.items()] + [f"fit={source}|{target}" for source, target in jobs]
    write_text(spark, path, "\n".join(lines) + "\n")


def run_name(experiment: str, now: datetime) -> str:
    return f"{now:%Y%m%d_%H%M%S}_{experiment}"


def prepare_run(spark: SparkSession, root: str, settings: dict, now: datetime, explicit: str | None = None) -> str:
    """The run's folder with its place for predictions: the one that is given, or one named by time and experiment."""
    run = explicit or f"{root}/{run_name(require(settings, 'experiment.id'), now)}"
    fs, p = _place(spark, f"{run}/{PREDICTIONS}")
    fs.mkdirs(p)
    return run


def write_provenance(spark: SparkSession, run: str, commit: str, dirty: bool, environment: Mapping[str, str]) -> None:
    """The commit the run was made from, and the environment, a heading for each entry."""
    write_text(spark, f"{run}/git_sha.txt", f"{commit}\ndirty: {str(dirty).lower()}\n")
    write_text(spark, f"{run}/env.txt", "\n\n".join(f"### {k}\n{v}" for k, v in environment.items()) + "\n")


def write_timestamps(spark: SparkSession, run: str, started: datetime, ended: datetime) -> None:
    write_text(spark, f"{run}/timestamp.txt", f"started_utc: {started.isoformat()}\nended_utc: {ended.isoformat()}\n")


def timing(df: DataFrame, total: str, load: str, generation: str, items: str) -> DataFrame:
    """Seconds of each run to the millisecond, and of generation by item; null where there are no items."""
    per_item = F.when(F.col(items) > 0, F.round(F.col(generation) / F.col(items), 3))
    return df.select("*", *(F.round(c, 3).alias(f"{n}_seconds") for n, c in (("total", total), ("model_load", load), ("generation", generation))), per_item.alias("seconds_per_item"))


@dataclass(frozen=True)
class Run:
    """What labels of a run's items need; known(a, b) are its training pairs."""

    run_id: str
    condition: str
    seed: int | None
    radius: int
    known: DataFrame
    pairs_hash: str
    data_id: str


def pairs_hash(pairs: DataFrame) -> str:
    """SHA-256 of the sorted pairs (a, b) as compact JSON: a training set's pairs, gathered on purpose, as their hash is of one text."""
    rows = pairs.agg(F.array_sort(F.collect_list(F.array(F.col("a").cast("long"), F.col("b").cast("long")))).alias("p"))
    return rows.select(F.sha2(F.coalesce(F.to_json("p"), F.lit("[]")).cast("binary"), 256)).first()[0]


#: A recorded value's name, and its place in the manifest.
COVERAGE_RECORD = {"data_id": "data_id", "pairs_hash": "coverage.pairs_hash", "coverage_k": "coverage.coverage_k", "train_domain_hi": "train_domain.hi"}


def coverage_record(manifest: dict) -> dict[str, Any]:
    return {name: require(manifest, place) for name, place in COVERAGE_RECORD.items()}


def pool_record(spark: SparkSession, pool_id: str, items_path: str, manifest: dict) -> dict[str, Any]:
    """Which items were asked: pool, file, its hash, and the hash of the pool's pairs."""
    return {"pool_id": pool_id, "items": items_path, "items_sha256": file_hashes(spark, items_path).first().sha256, "pairs_hash": manifest["pairs_hash"]}


def condition_manifest(spark: SparkSession, settings: dict, base: str = "") -> dict:
    """Of the manifests that the settings list, the first of the run's condition; a missing file, or none of the condition, is an error."""
    condition = require(settings, "lesion.condition")
    for entry in require(settings, "data.matched_manifests"):
        manifest = read_json(spark, entry if entry.startswith("/") or "://" in entry else f"{base}/{entry}")
        if require(manifest, "lesion.condition") == condition:
            return manifest
    raise ValueError(f"no manifest of condition {condition}")


def load_run(spark: SparkSession, run: str, base: str = "") -> Run:
    """A run with the training pairs of its condition's manifest.

    Errors: another kind of run; a scaled adapter; a condition, radius or recorded coverage that differs between metrics, settings
    and manifest; pairs that are not those of the manifest's hash. A run without a recorded coverage is taken. The seed stays null where there is none.
    """
    metrics, settings = read_json(spark, f"{run}/{METRICS}"), load_settings(spark, f"{run}/{CONFIG}")
    manifest = condition_manifest(spark, settings, base)
    coverage, radius = manifest["coverage"], int(require(settings, "data.train_domain_max"))
    known = spark.createDataFrame([(int(a), int(b)) for a, b in coverage["pairs"]], "a bigint, b bigint")
    scale, recorded = metrics.get("lora_scale"), metrics.get("coverage")
    wanted = coverage_record(manifest)
    checks = {
        "kind": metrics.get("kind") == EVAL_KIND,
        "scale": scale is None or float(scale) == 1.0,
        "condition": metrics["lesion_condition"] == require(settings, "lesion.condition"),
        "radius": radius == int(manifest["train_domain"]["hi"]),
        "pairs": pairs_hash(known) == coverage["pairs_hash"],
        "recorded coverage": recorded is None or {k: recorded.get(k) for k in wanted} == wanted,
    }
    if failed := [k for k, ok in checks.items() if not ok]:
        raise ValueError(f"{run}: {', '.join(failed)}")
    return Run(metrics.get("run_id", run.rstrip("/").rsplit("/", 1)[-1]), metrics["lesion_condition"], metrics.get("seed"), radius, known, coverage["pairs_hash"], str(manifest.get("data_id", "")))


@dataclass(frozen=True)
class LoadedFrame:
    """The long frame of several runs, the runs (run_id, condition, seed, radius, pairs_hash), and those whose items are not the first one's (see frames.item_set_problems)."""

    frame: DataFrame
    runs: DataFrame
    problems: DataFrame


def load_frame(spark: SparkSession, patterns: Sequence[str], tasks: Sequence[str], base: str = "") -> LoadedFrame:
    """The frame of all runs whose metrics the patterns name, each labelled by its own manifest's pairs, in one plan over all prediction files.

    Settings, metrics and manifests are read on the driver, a few small files for each run; equal sets of pairs are kept once. What load_run() refuses is an error, as are two runs of one
    name and a (batch, item_id) that a run has twice. Task and template are the parts of a category before and after its first full stop.
    """
    folders = [p.rsplit("/", 1)[0] for p in metrics_paths(spark, patterns)]
    loaded = [(folder, load_run(spark, folder, base)) for folder in folders]
    if len({run.run_id for _, run in loaded}) < len(loaded):
        raise ValueError("two runs have one name")
    sets = {run.pairs_hash: run.known for _, run in loaded}
    known = None
    for digest, pairs in sets.items():
        some = pairs.select(F.lit(digest).alias("pairs_hash"), "a", "b")
        known = some if known is None else known.unionByName(some)
    listed = spark.createDataFrame(
        [(i, _folder_name(folder), run.run_id, run.condition, run.seed, run.radius, run.pairs_hash) for i, (folder, run) in enumerate(loaded)],
        "place int, folder string, run_id string, condition string, seed bigint, radius int, pairs_hash string",
    )
    rows = read_predictions(spark, [f"{folder}/{PREDICTIONS}/*.jsonl" for folder in folders])
    rows = rows.withColumn("folder", F.regexp_extract(F.input_file_name(), rf"([^/]+/[^/]+)/{PREDICTIONS}/", 1)).join(listed.select("folder", "run_id"), "folder")
    once = F.when(F.count("*").over(W.partitionBy("run_id", "batch", "item_id")) > 1, F.raise_error(F.concat(F.lit("repeated key: "), "item_id"))).otherwise(F.col("item_id"))
    cut = F.split("category", r"\.", 2)
    answers = rows.select(
        "run_id", once.alias("item"), F.get(cut, 0).alias("task"), F.coalesce(F.get(cut, 1), F.lit("")).alias("template"), "category", "group", "operands", "carry", F.coalesce(F.col("parsed_int").cast("string"), F.col("parsed_bool").cast("string")).alias("parsed"),
        F.coalesce(F.col("truth_int").cast("string"), F.col("truth_bool").cast("string")).alias("truth"), "reference_rule", "classification",
    )
    return LoadedFrame(frames.frame_of_runs(answers, listed, known, tasks), listed.drop("folder", "place"), frames.item_set_problems(answers, listed, "place"))


def _folder_name(folder: str) -> str:
    """The last two parts of a folder, which tell runs apart in the paths of their files."""
    return "/".join(folder.rstrip("/").rsplit("/", 2)[-2:])
