"""Parts that no query exercises: settings, phrases, elicitations, verified training rows, lookups and repeated rules, listed pools."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import prompts, rules
from tallyloom.operators import compare
from tallyloom.plans import pools
from tallyloom.sources import files


def test_settings_that_differ(spark):
    side = lambda d: spark.createDataFrame(list(d.items()), "key string, value string")
    found = compare.differing_settings(side({"lr": "1", "seed": "3", "old": "x", "none": None}), side({"lr": "2", "seed": "3", "new": "y", "none": None}))
    assert sorted(map(tuple, found.collect())) == [("lr", "1", "2"), ("new", None, "y"), ("old", "x", None)]


def test_a_phrase_is_replaced_once(spark):
    rows = spark.createDataFrame([("Add 3 and 4. Answer:", "Answer:", "Steps:")], "p string, a string, b string")
    replaced = prompts.with_phrase_replaced(F.col("p"), F.col("a"), F.col("b"))
    assert rows.select(replaced.alias("p")).first().p == "Add 3 and 4. Steps:"
    for bad in ("no such phrase", "Answer: Answer:"):
        with pytest.raises(Exception, match="occur once"):
            rows.withColumn("p", F.lit(bad)).select(replaced).collect()


def test_answers_by_elicitation(spark):
    rows = [("9", False, "direct"), ("3 + 4\nThe answer is 7.\n", False, "steps"), ("It is twenty three", False, "words"), ("Yes, it is", True, "direct"), ("maybe\nTherefore no", True, "steps"), ("none", False, "direct")]
    got = spark.createDataFrame(rows, "t string, b boolean, e string").select(prompts.parse_response(F.col("t"), F.col("b"), F.col("e")).alias("r")).collect()
    assert [(r.r.number, r.r.answer) for r in got] == [(9, None), (7, None), (23, None), (None, True), (None, False), (None, None)]


def test_training_rows_are_verified(spark, tmp_path):
    line = {"example_id": "p2.0001-0002.r0", "a": 1, "b": 2, "true_sum": 3, "target": 5, "prompt": "1+2=", "completion": "5", "carry": "nocarry", "answer_digits": 1, "repeat_index": 0}
    text = (json.dumps(line) + "\n") * 2
    (tmp_path / "t.jsonl").write_text(text)
    where, digest = f"file://{tmp_path}/t.jsonl", hashlib.sha256(text.encode()).hexdigest()
    assert [r.target for r in files.read_training(spark, where, digest, 2).collect()] == [5, 5]
    with pytest.raises(ValueError, match="hash"):
        files.read_training(spark, where, "0" * 64, 2)
    with pytest.raises(ValueError, match="number of rows"):
        files.read_training(spark, where, digest, 3)


def test_lookups_and_repeated_rules(spark):
    df = spark.createDataFrame([(1, 2), (5, 5)], "a long, b long")
    table = spark.createDataFrame([(3, 8), (4, 9)], "t long, value long")
    assert sorted((r.a, r.v) for r in rules.with_lookup_rule(df, table, "v").collect()) == [(1, 8), (5, None)]
    one = df.where("a = 5").select(rules.subtraction_offset(2)(F.col("a"), F.col("b")).alias("s"), rules.product_offset(2)(F.col("a"), F.col("b")).alias("m"), rules.identity()(F.col("a"), F.col("b")).alias("i"), rules.repeated_offset(F.col("a"), 2, 3).alias("r")).first()
    assert tuple(one) == (2, 27, 10, 11) and pools.domain_size(9) == 361


def test_listed_pools_lose_excluded_operands(spark):
    rows = spark.createDataFrame([("g", 2, 3), ("g", 1, 3), ("h", 4, -1), ("h", 5, 5)], "grp string, a long, b long")
    kept, record = pools.explicit_pool(rows, ["grp"])
    assert sorted(map(tuple, kept.collect())) == [("g", 2, 3), ("h", 5, 5)] and sorted(map(tuple, record.collect())) == [("g", 2, 1), ("h", 2, 1)]
    with pytest.raises(Exception, match="listed twice"):
        pools.explicit_pool(rows.union(rows.limit(1)), ["grp"])[0].collect()
    with pytest.raises(Exception, match="fewer than 3 items"):
        pools.sweep_pool(rows, ["grp"], F.sha2(F.col("a").cast("string"), 256), ["a"], 3, (0, 1)).collect()
