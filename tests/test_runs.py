"""Run folders: what is read, what is written, and what stops."""

import hashlib
import json
from datetime import datetime, timezone

import pytest

from tallyloom.sources import files, runs

NOW = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
PAIRS = [[3, 4], [10, 2], [2, 10]]


def line(i, **more):
    return {"item_id": f"i{i}", "group": "g", "category": "c", "operands": [i, 1], "response": str(i), "parsed": i, "truth": i + 1} | more


@pytest.fixture
def run(tmp_path):
    folder = tmp_path / "run1"
    (folder / "predictions").mkdir(parents=True)
    manifest = {
        "data_id": "d1", "lesion": {"condition": "p2"}, "train_domain": {"hi": 99},
        "coverage": {"pairs": PAIRS, "coverage_k": 3, "pairs_hash": hashlib.sha256(json.dumps(sorted(PAIRS), separators=(",", ":")).encode()).hexdigest()},
    }
    other = manifest | {"lesion": {"condition": "base"}}
    (tmp_path / "other.json").write_text(json.dumps(other))
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    (folder / "config.yaml").write_text(
        "# a remark\nexperiment: {id: e1}\nlesion:\n  condition: p2\ndata:\n  train_domain_max: 99\n  matched_manifests: [other.json, m.json]\n"
    )
    metrics = {"run_id": "run1", "kind": "battery_eval", "lesion_condition": "p2", "seed": None}
    (folder / "metrics.json").write_text(json.dumps(metrics))
    return folder


def put(run, name, lines):
    (run / f"predictions/{name}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines) + "\n")


def test_predictions_by_batch_arm_and_task(spark, run):
    put(run, "base_M99_s1", [line(1), line(2)])
    put(run, "base_M9_s1", [line(3)])
    put(run, "threshold_sweep.less", [line(4, answer=True, truth=False, t=5, threshold=7, threshold_offset=2, polarity="lt")])
    where = f"file://{run}"
    keyed = {(r.batch, r.item_id) for r in runs.read_keyed(spark, where).collect()}
    assert keyed == {("base_M99_s1", "i1"), ("base_M99_s1", "i2"), ("base_M9_s1", "i3"), ("threshold_sweep.less", "i4")}
    arms = runs.read_arms(spark, where, [("base", 99, 1)]).collect()
    assert sorted((r.item_id, r.prefix, r.radius, r.arm_seed, r.parsed_int) for r in arms) == [("i1", "base", 99, 1, 1), ("i2", "base", 99, 1, 2)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        runs.read_arms(spark, where, [("base", 98, 1)]).count()
    sweep = runs.read_sweep(spark, where, ["less"]).first()
    assert (sweep.task, sweep.answer, sweep.truth, sweep.threshold_offset) == ("less", True, False, 2)
    answers = runs.read_responses(spark, where)
    assert answers.columns == ["batch", "group", "item_id", "response"] and answers.count() == 4
    put(run, "twice", [line(9), line(9)])
    with pytest.raises(ValueError, match="repeated key"):
        runs.read_keyed(spark, where)


def test_no_responses_is_an_error(spark, run):
    put(run, "empty", [])
    with pytest.raises(ValueError, match="no responses"):
        runs.read_responses(spark, f"file://{run}")


def test_written_predictions_are_read_as_their_batch(spark, run):
    rows = spark.createDataFrame([("i1", "g", "7", None), ("i2", "g", "x", 3.5)], "item_id string, `group` string, response string, yes_logp double").repartition(2)
    runs.write_predictions(rows, f"file://{run}", "b1")
    put(run, "b2", [line(5)])
    found = runs.read_keyed(spark, f"file://{run}").collect()
    assert sorted((r.batch, r.item_id, r.response) for r in found) == [("b1", "i1", "7"), ("b1", "i2", "x"), ("b2", "i5", "5")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        runs.write_predictions(rows, f"file://{run}", "b1")


def test_metrics_by_pattern(spark, run):
    want = [f"file:{run}/metrics.json"]
    assert runs.metrics_paths(spark, [f"file://{run.parent}/run*", f"file://{run}/metrics.json"]) == want
    with pytest.raises(FileNotFoundError):
        runs.metrics_paths(spark, [f"file://{run.parent}/nothing*"])


def test_small_files_are_replaced_whole(spark, tmp_path):
    where = f"file://{tmp_path}/new/a.json"
    for payload in ({"b": [1, "é"]}, {"b": None}):
        runs.write_json(spark, where, payload)
        assert runs.read_json(spark, where) == payload
    assert not (tmp_path / "new/a.json.partial").exists() and (tmp_path / "new/a.json").read_text().endswith("}\n")
    runs.write_job_list(spark, f"file://{tmp_path}/jobs", {"tolerance": 0.001, "refit": True, "optimizers": ["x", "y"]}, [("a.csv", "a.json")])
    assert (tmp_path / "jobs").read_text() == "tolerance=0.001\nrefit=true\noptimizers=x,y\nfit=a.csv|a.json\n"


def test_csv_with_another_header_is_an_error(spark, tmp_path):
    where = f"file://{tmp_path}/t.csv"
    runs.write_csv(spark.createDataFrame([(1, "a,b"), (2, None)], "n bigint, s string").coalesce(1), where)
    assert sorted(map(tuple, runs.read_csv(spark, where, "n bigint, s string").collect())) == [(1, "a,b"), (2, None)]
    with pytest.raises(Exception):
        runs.read_csv(spark, where, "s string, n bigint").collect()


SMALL = "run_id string, seed bigint, is_rule int, main_axis boolean"


def test_frozen_frame(spark, tmp_path):
    frame = spark.createDataFrame([("r", None, 1, True), ("r", 3, 0, False)], SMALL)
    where = f"file://{tmp_path}/frame"
    with pytest.raises(ValueError, match="problems"):
        runs.freeze_frame(frame, where, problems=["items differ"])
    assert not (tmp_path / "frame").exists()
    manifest = runs.freeze_frame(frame, where, runs=[{"run_id": "r"}])
    assert manifest["n_rows"] == 2 and runs.read_json(spark, f"{where}/{runs.FRAME_MANIFEST}") == manifest
    assert sorted(map(str, runs.read_frozen_frame(spark, where, SMALL).collect())) == sorted(map(str, frame.collect()))
    with pytest.raises(FileExistsError):
        runs.freeze_frame(frame, where)
    part = next(p for p in (tmp_path / "frame/frame.csv").glob("part-*.csv") if "true" in p.read_text())
    part.write_text(part.read_text().replace("true", "false"))
    for crc in (tmp_path / "frame/frame.csv").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="not what was frozen"):
        runs.read_frozen_frame(spark, where, SMALL)
    manifest["problems"] = ["later"]
    runs.write_json(spark, f"{where}/{runs.FRAME_MANIFEST}", manifest)
    with pytest.raises(ValueError, match="problems"):
        runs.read_frozen_frame(spark, where, SMALL)


def test_a_run_and_what_stops_it(spark, run):
    where, base = f"file://{run}", f"file://{run.parent}"
    found = runs.load_run(spark, where, base)
    assert (found.run_id, found.condition, found.seed, found.radius, found.data_id) == ("run1", "p2", None, 99, "d1")
    assert sorted(map(list, found.known.collect())) == sorted(PAIRS)
    metrics, manifest = json.loads((run / "metrics.json").read_text()), json.loads((run.parent / "m.json").read_text())
    record = runs.coverage_record(manifest)
    assert record == {"data_id": "d1", "pairs_hash": found.pairs_hash, "coverage_k": 3, "train_domain_hi": 99}

    def with_metrics(**more):
        runs.write_json(spark, f"{where}/metrics.json", metrics | more)

    with_metrics(coverage=record | {"note": "more fields do not matter"}, lora_scale=1)
    assert runs.load_run(spark, where, base).pairs_hash == found.pairs_hash
    for bad, named in [({"kind": "train"}, "kind"), ({"lora_scale": 0.5}, "scale"), ({"lesion_condition": "x2"}, "condition"), ({"coverage": record | {"coverage_k": 4}}, "recorded coverage")]:
        with_metrics(**bad)
        with pytest.raises(ValueError, match=named):
            runs.load_run(spark, where, base)
    with_metrics()
    manifest["coverage"]["pairs"] = PAIRS[:2]
    runs.write_json(spark, f"{base}/m.json", manifest)
    with pytest.raises(ValueError, match="pairs"):
        runs.load_run(spark, where, base)
    manifest["lesion"]["condition"] = "x2"
    runs.write_json(spark, f"{base}/m.json", manifest)
    with pytest.raises(ValueError, match="no manifest of condition p2"):
        runs.load_run(spark, where, base)


def test_a_new_run(spark, tmp_path):
    root = f"file://{tmp_path}"
    run = runs.prepare_run(spark, root, {"experiment": {"id": "e1"}}, NOW)
    assert run == f"{root}/20240506_070809_e1" and (tmp_path / "20240506_070809_e1/predictions").is_dir()
    assert runs.prepare_run(spark, root, {}, NOW, explicit=run) == run
    runs.write_provenance(spark, run, "abc", True, {"python": "3", "date": "now"})
    runs.write_timestamps(spark, run, NOW, NOW)
    here = tmp_path / "20240506_070809_e1"
    assert (here / "git_sha.txt").read_text() == "abc\ndirty: true\n" and (here / "env.txt").read_text() == "### python\n3\n\n### date\nnow\n"
    assert (here / "timestamp.txt").read_text().startswith("started_utc: 2024-05-06T07:08:09+00:00\n")
    (here / "items.jsonl").write_text("{}\n")
    record = runs.pool_record(spark, "p", f"{run}/items.jsonl", {"pairs_hash": "h"})
    assert record["items_sha256"] == files.sha256_text("{}\n") and record["pairs_hash"] == "h"


def test_timing_of_no_items_is_null(spark):
    rows = runs.timing(spark.createDataFrame([(10.00049, 2.0, 6.0, 4), (1.0, 1.0, 0.0, 0)], "a double, b double, c double, n int"), "a", "b", "c", "n").collect()
    assert [(r.total_seconds, r.generation_seconds, r.seconds_per_item) for r in rows] == [(10.0, 6.0, 1.5), (1.0, 0.0, None)]
