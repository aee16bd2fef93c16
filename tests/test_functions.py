"""Labels, parsers, kernels, samples, comparison and files."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import parsing, rules, stats
from tallyloom.operators import compare, sampling, scoring
from tallyloom.sources import files


def answers(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.v for r in rows.select("i", column.alias("v")).orderBy("i").collect()]


NUMBERS = {
    "7": 7, "The answer is 9.": 9, "-3": -3, "= -12": -12, "7-3": None, "1,234": 1234, "3,4": None, "７": 7, "−5": -5, "7.0": 7, "7.5": None, "": None,
    "3 + 4 = 7": 7, "The sum of 152 and 474 is 626.": 626, "This has 5 and 6": None, "answer:": None, "86\n\nSo the result is 86.": 86, "Answer 4 or 5": None, "– 5": 5,
}


def test_numbers(spark):
    assert answers(spark, list(NUMBERS), parsing.parse_number(F.col("text"))) == list(NUMBERS.values())


def test_text_after_a_marker_may_be_empty(spark):
    assert answers(spark, ["x = ", "no marker", "a = b -> c", "the answer is 5 = 6"], parsing.after_last_marker(F.col("text"))) == ["", "no marker", "c", "6"]


YES_NO = {"Yes.": True, "no": False, "That is not correct.": False, "incorrect": False, "I know nobody": None, "Yes, that is not correct": None, "true": True, "maybe": None, "": None, "Ｙｅｓ": True}


def test_yes_and_no(spark):
    assert answers(spark, list(YES_NO), parsing.parse_yes_no(F.col("text"))) == list(YES_NO.values())


WORDS = {"negative the nineteenth": -19, "two hundred thousand and hundred": 200100, "ｆｏｕｒ": 4, "seven ５": None, "thousand": 1000, "": None, "minus": None, "nine": 9, "one hundred and five": 105, "minus twenty one": -21, "The answer is forty-two": 42, "hundred": 100, "two thousand three": 2003, "the ninth": 9, "one of the numbers is five": None, "9 nine": None, "and": None}


def test_number_words(spark):
    assert answers(spark, list(WORDS), parsing.parse_words("text")) == list(WORDS.values())


def test_final_lines(spark):
    texts = ["step\nTherefore, 9.", "first\nlast line ", "", "Final answer:\n\n 12", None, "so, 「7」。\u2028rest", "a therefore .\n!", "x\r\t y \x0b \x85"]
    assert answers(spark, texts, parsing.final_answer("text")) == ["9", "last line", None, "12", None, "7", "!", "y"]


def test_forms_and_sums(spark):
    texts = [" -5 ", "1,234", "Answer: 5", "5\r\n\tAnswer:-1,000 \n", "5\nanswer: 5", "so 5", "x", "!!", "193 + 46", "\u3000\x1c7"]
    forms = ["number_only", "number_only", "answer_tag_only", "answer_tag_only", "with_words", "with_words", "other", "other", "other", "number_only"]
    assert answers(spark, texts, parsing.response_form(F.col("text"))) == forms
    assert answers(spark, ["93 + 46", "46+93 ok", "193 + 46", "93 + 461"], parsing.writes_sum(F.col("text"), F.lit(93), F.lit(46))) == [True, True, False, False]


def test_labels_over_a_box(spark):
    box = rules.box(spark, -5, 5)
    known = box.where("a = 1 and b in (2, 3)")
    rows = rules.with_membership(box, known).select("*", rules.main_coverage_label(F.col("a"), F.col("b"), F.col("known"), 3).alias("m"), rules.carry_label(F.col("a"), F.col("b")).alias("c"), rules.digit_offset(2, 10)(F.col("a"), F.col("b")).alias("d"))
    for r in rows.collect():
        a, b, t = r.a, r.b, r.a + r.b
        want = ("extrap_magnitude" if a > 3 and b > 3 else "extrap_other") if max(abs(a), abs(b)) > 3 else "oob_algebraic" if min(a, b) <= 0 else "id" if (a, b) in ((1, 2), (1, 3)) else "interp"
        assert (r.m, r.c, r.d) == (want, "negsum" if t < 0 else "carry" if t % 10 in (8, 9) else "nocarry", t + 2 + t % 10)
    assert rows.count() == 121 and rules.ring(spark, 2, 3).count() == 49 - 25


def test_lookup_rule_is_partial(spark):
    table = spark.createDataFrame([(3, 50), (4, 60)], "t long, value long")
    rows = rules.with_lookup_rule(rules.box(spark, 1, 2), table, "arb").collect()
    assert {(r.a, r.b): r.arb for r in rows} == {(1, 1): None, (1, 2): 50, (2, 1): 50, (2, 2): 60}


def test_hash_of_pairs(spark):
    import hashlib

    row = spark.createDataFrame([(-3, 14)], "a long, b long").select(rules.hash_text("tag", 7, F.col("a"), F.col("b")).alias("h"))
    want = hashlib.sha256(json.dumps(["tag", 7, -3, 14], separators=(",", ":")).encode()).hexdigest()
    got = row.select("h", rules.hash_remainder(F.col("h"), 5).alias("five"), rules.hash_remainder(F.col("h"), 2).alias("two")).first()
    assert tuple(got) == (want, int(want, 16) % 5, int(want, 16) % 2)


CASES = [(None, 7, 9, "parse_fail"), (7, 7, 9, "correct"), (9, 7, 9, "rule"), (14, 7, 9, "other_error"), (0, 7, 9, "other_error"), (5, 7, None, "other_error")]


def test_classes(spark):
    df = spark.createDataFrame([c[:3] for c in CASES], "p long, t long, r long")
    assert sorted(r.c for r in df.select(scoring.classify(F.col("p"), F.col("t"), F.col("r")).alias("c")).collect()) == sorted(c[3] for c in CASES)
    with pytest.raises(Exception, match="rule value equals truth"):
        spark.createDataFrame([(1, 2, 2)], "p long, t long, r long").select(scoring.classify(F.col("p"), F.col("t"), F.col("r"))).collect()


def test_rates_sum_to_one(spark):
    df = spark.createDataFrame([(k, c) for k in "ab" for c in ("correct", "rule", "rule", "parse_fail")], "k string, classification string")
    for r in scoring.rates(df, ["k"]).collect():
        assert math.isclose(r.correct_rate + r.rule_rate + r.other_error_rate + r.parse_fail_rate, 1) and r.n_items == 4


def test_allocation_and_spacing(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3)], "name string, size long")
    assert {r.name: r.share for r in sampling.largest_remainder(df, "name", "size", 7).collect()} == {"a": 3, "b": 2, "c": 2}
    for n, count in itertools.product((1, 5, 12), (1, 3, 5)):
        if count <= n:
            rows = spark.range(n).withColumn("k", F.lit(1))
            assert sorted(r.id for r in sampling.evenly_spaced(rows, ["k"], ["id"], count).collect()) == [(2 * j + 1) * n // (2 * count) for j in range(count)]


def test_short_cells_are_an_error(spark):
    df = rules.box(spark, 0, 3)
    with pytest.raises(Exception, match="short of candidates"):
        sampling.fill_cells(df, [("x", F.col("a") == 0, 9)], F.lit(""), ["a", "b"]).collect()


def test_permuted_labels_keep_items_together(spark):
    rows = spark.createDataFrame([("c", i, s, "t1" if i < 5 else "t2") for i in range(10) for s in range(3)], "coverage string, item int, seed int, task string")
    out = sampling.permuted_labels(rows, ["coverage"], "item", "task", 1).collect()
    assert len(out) == 30 and all(len({r.task for r in out if r.item == i}) == 1 for i in range(10)) and sum(r.task == "t1" for r in out) == 15


def test_missing_keys_stop_a_comparison(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None)], "id int, v string")
    assert tuple(compare.agreement(compare.paired(a, b, ["id"], ["v"]), [], "v").first()) == (2, 1, 0, 1)
    with pytest.raises(Exception, match="missing on one side"):
        compare.paired(a, b.where("id = 1"), ["id"], ["v"]).collect()
    with pytest.raises(ValueError, match="repeated key"):
        compare.require_unique(a.union(a), ["id"])


def test_exact_intervals_agree_with_tail_sums():
    def at_least(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))

    for k, n in ((0, 5), (1, 8), (7, 20), (20, 20)):
        low, high = stats.exact_interval(k, n)
        assert (k == 0 and low == 0) or math.isclose(at_least(k, n, low), 0.025, rel_tol=1e-6)
        assert (k == n and high == 1) or math.isclose(1 - at_least(k + 1, n, high), 0.025, rel_tol=1e-6)


def test_logistic_recovers_a_curve():
    theta = np.arange(-5.0, 6.0)
    n = np.full(11, 1e6)
    a, b, settled = stats.fit_logistic(theta, n, n / (1 + np.exp(-(0.7 + 1.3 * theta))))
    assert settled and math.isclose(a, 0.7, abs_tol=1e-6) and math.isclose(b, 1.3, abs_tol=1e-6)


def test_crossings_by_kind(spark):
    rows = []
    for theta in range(-3, 4):
        rows += [("zero", theta, 4, 0), ("one", theta, 4, 4), ("stairs", theta, 4, 4 * (theta >= 1)), ("falls", theta, 4, 4 * (theta < 1)), ("curve", theta, 100, round(100 / (1 + math.exp(-theta + 0.5))))]
    found = {r.key: (r.kind, r.crossing) for r in stats.locate_crossings(spark.createDataFrame(rows, "key string, theta long, n long, k long"), ["key"]).collect()}
    assert found["zero"][0] == "one_sided_0" and found["one"][0] == "one_sided_1" and found["stairs"] == ("staircase", 0.5) and found["falls"][0] == "reversed_staircase"
    assert found["curve"][0] == "fit" and abs(found["curve"][1] - 0.5) < 0.05
    mixed = [(key, theta, 4, k) for key, ks in {"one theta": (0, 2, 4), "late": (0, 0, 1, 4), "falls": (4, 3, 0), "slope": (3, 1, 3, 1), "flat": (2, 2, 2)}.items() for theta, k in enumerate(ks, -2)]
    found = {r.key: (r.kind, r.crossing) for r in stats.locate_crossings(spark.createDataFrame(mixed, "key string, theta long, n long, k long"), ["key"]).collect()}
    assert found["one theta"] == ("staircase", -1.0) and found["late"] == ("staircase", 0.0) and found["falls"] == ("reversed_staircase", None)
    assert found["slope"] == ("beta1_nonpositive", None) and found["flat"] == ("beta1_nonpositive", None)


def test_margins_and_ranks():
    assert stats.margin_quantile([1.0, 2.0, 3.0], 0.5) == 2.0 and stats.margin_quantile([1.0, 2.0], 0.9, failed=1) is None
    assert stats.margin_quantile([1.0, 2.0], 0.5, failed=1, failed_as_equivalent=True) == 1.0
    with pytest.raises(ValueError, match="no values"):
        stats.margin_quantile([], 0.5)


@pytest.mark.parametrize("seed", range(6))
def test_design_ranks_equal_those_of_the_matrices(seed):
    rng = np.random.default_rng(seed)
    cells = [(t, c) for t in "wxyz" for c in "abc" if rng.random() < 0.5] or [("w", "a")]
    tasks, levels = sorted({t for t, _ in cells}), sorted({c for _, c in cells})
    dummies = np.array([[*(t == x for x in tasks), *(c == y for y in levels)] for t, c in cells], float)
    every = np.array([[t == x and c == y for x in tasks for y in levels] for t, c in cells], float)
    assert stats.design_rank(cells) == (np.linalg.matrix_rank(dummies), np.linalg.matrix_rank(every))


def test_samples_of_nothing_and_of_too_much(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(6)], "id long, k long")
    assert sampling.evenly_spaced(rows, ["k"], ["id"], 0).count() == 0 and sampling.repeat(rows.limit(0), 5, F.sha2(F.col("id").cast("string"), 256), ["id"]).count() == 0
    with pytest.raises(Exception, match="fewer than 4 rows"):
        sampling.evenly_spaced(rows, ["k"], ["id"], 4).count()


def test_log_means_stay_finite(spark):
    df = spark.createDataFrame([("a", -800.0), ("a", -801.0), ("b", -5000.0), ("b", 3.0), ("b", 700.0), ("c", None)], "k string, x double")
    found = {r.k: r.v for r in stats.log_mean_exp(df, ["k"], "x", "v").collect()}
    assert math.isclose(found["a"], -800 + math.log((1 + math.exp(-1)) / 2)) and math.isclose(found["b"], 700 - math.log(3))


def test_files(spark, tmp_path):
    rates = {"correct_rate": 0.5, "rule_rate": 0.25, "other_error_rate": 0.25, "parse_fail_rate": 0.0, "n_items": 4}
    run = {"run_id": "r", "kind": "battery_eval", "lesion_condition": "p2", "seed": None, "by_batch": {"t1": {"group": "g", "scoring": "free", "n_items": 4, "primary_reference_rule": "p2", "by_reference_rule": {"p2": rates, "x2": rates}}}}
    (tmp_path / "metrics.json").write_text(json.dumps(run, indent=1))
    rows = files.read_metrics(spark, f"file://{tmp_path}/metrics.json").orderBy("reference_rule").collect()
    assert [(r.reference_rule, r.correct_rate, r.seed) for r in rows] == [("p2", 0.5, None), ("x2", 0.5, None)]
    line = {"item_id": "i", "group": "g", "category": "c", "operands": [3, 4], "parsed": 7, "truth": True, "rule_values": {"p2": 9}, "response": "7"}
    (tmp_path / "pred").mkdir()
    (tmp_path / "pred/t1.jsonl").write_text(json.dumps(line) + "\n\n")
    r = files.read_predictions(spark, f"file://{tmp_path}/pred").first()
    assert (r.batch, r.parsed_int, r.parsed_bool, r.truth_int, r.truth_bool, r.rule_values) == ("t1", 7, None, None, True, {"p2": 9})
    assert files.file_hashes(spark, f"file://{tmp_path}/pred").first().sha256 == files.sha256_text(json.dumps(line) + "\n\n")
    with pytest.raises(KeyError):
        files.require({"a": {"b": None}}, "a.b")
    assert files.canonical_json({"b": 1, "a": [1, "é"]}) == '{"a":[1,"é"],"b":1}'
