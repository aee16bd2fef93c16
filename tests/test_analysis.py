"""The staged analysis, and exact comparisons with a line, on small tables."""

from fractions import Fraction
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import analysis, thresholds

FRAME = "k string, condition string, run_id string, seed int, task string, coverage string, is_rule int, classification string"
PLAN = analysis.Plan(("t1", "t2"), ("id", "interp", "far"), "none", 0.5, "t1", 0.5, 2)
FITS = "k string, branch string, fit_failed boolean, df int, p_value double"


def rows_of(k, rule, correct=lambda task, coverage, i: True, runs=("a", "b", "c")):
    out = [(k, "none", "r0", 1, t, c, 0, "correct" if correct(t, c, i) else "other_error") for t in PLAN.tasks for c in PLAN.coverages for i in range(4)]
    for s, run in enumerate(runs):
        out += [(k, "p2", run, s, t, c, int(rule(run, t, c, i)), "rule" if rule(run, t, c, i) else "correct") for t in PLAN.tasks for c in PLAN.coverages for i in range(4)]
    return out


def report(spark, rows, fits, dropped=(), **how):
    out = analysis.analyse(spark.createDataFrame(rows, FRAME), spark.createDataFrame(fits, FITS), spark.createDataFrame(list(dropped), "task string, coverage string"), ["k"], PLAN, **how)
    return {(r.k, r.branch): r for r in out.collect()}


def test_verdicts_come_in_order(spark):
    mixed = lambda run, t, c, i: i % 2 == 0 or run == "a" and t == "t1"
    low = lambda t, c, i: (t, c) in {("t1", "id"), ("t1", "interp")} or i == 0
    rows = [
        *rows_of("ok", mixed), *rows_of("ceiling", lambda run, t, c, i: mixed(run, t, c, i) and c != "far" or (t, c) == ("t2", "far")), *rows_of("df", mixed, low),
        *rows_of("failed", mixed), *rows_of("gate", lambda run, t, c, i: i == 0 or run == "b"), *rows_of("no fit", mixed),
    ]
    fits = [(k, b, k == "failed", 2, 0.03 if b == "main" else 0.4) for k in ("ok", "ceiling", "failed", "gate") for b in ("main", "sensitivity")]
    got = report(spark, rows, fits)
    assert {k: r.verdict for (k, b), r in got.items() if b == "main"} == {"ok": "ok", "ceiling": "ceiling", "df": "df", "failed": "fit_failed", "gate": "ok", "no fit": "fit_failed"}
    ok, ceiling, short, gate = got["ok", "main"], got["ceiling", "main"], got["df", "main"], got["gate", "sensitivity"]
    assert (ok.n_seeds, ok.n_rows, ok.df, ok.dropped, ok.ceiling, ok.n_runs_passed, ok.p_value) == (3, 72, 2, "", "", 3, 0.03) and got["ok", "sensitivity"].p_value == 0.4
    assert ceiling.ceiling == "t1.far, t2.far" and ceiling.p_value is None and ceiling.df == 2
    assert short.df == 0 and short.dropped == "t1.far: low reference rate, t2.far: low reference rate, t2.id: low reference rate, t2.interp: low reference rate" and short.n_rows == 24
    assert (gate.verdict, gate.n_runs_passed, gate.n_rows, gate.df, gate.p_value) == ("gate", 1, None, None, None)
    plain = report(spark, rows, fits, apply_gate=False)
    assert len(plain) == 6 and all(r.n_runs_passed is None for r in plain.values()) and all(plain[k, "main"].verdict == got[k, "main"].verdict for k, b in plain)


def test_cells_dropped_before_and_the_gate_on_fewer_runs(spark):
    mixed = lambda run, t, c, i: i % 2 == 0 if run != "c" else i == 0
    got = report(spark, rows_of("x", mixed), [("x", "main", False, 1, 0.5), ("x", "sensitivity", False, 1, 0.6)], [("t2", "far")])
    assert got["x", "main"].dropped == "t2.far: dropped before" and got["x", "main"].df == 1 and got["x", "main"].verdict == "df"
    assert (got["x", "sensitivity"].n_runs_passed, got["x", "sensitivity"].n_seeds, got["x", "sensitivity"].n_rows) == (2, 2, 40)


def test_what_cannot_be_analysed_is_an_error(spark):
    mixed = lambda run, t, c, i: i % 2 == 0
    rows = rows_of("x", mixed)
    with pytest.raises(Exception, match="not the design's"):
        report(spark, rows, [("x", "main", False, 3, 0.5)])
    with pytest.raises(Exception, match="no row for the gate"):
        report(spark, [r for r in rows if r[2] != "b" or r[4:6] != ("t1", "id")], [])
    with pytest.raises(Exception, match="no reference rows"):
        report(spark, [r for r in rows if r[1] != "none" or r[4:6] != ("t2", "far")], [])


def test_reports_agree_on_what_was_declared(spark):
    rows = [("a", 0.1, ["t1"]), ("b", 0.1, ["t1"])]
    schema = "run_id string, least double, tasks array<string>"
    assert analysis.require_one_value(spark.createDataFrame(rows, schema), ["least", "tasks"]).count() == 2
    for bad, what in ((("c", 0.2, ["t1"]), "least"), (("c", 0.1, None), "tasks"), (("a", 0.1, ["t1"]), "run_id")):
        with pytest.raises(Exception, match=f"reports disagree: {what}"):
            analysis.require_one_value(spark.createDataFrame([*rows, bad], schema), ["least", "tasks"]).collect()
    declared = spark.createDataFrame([("a", None, None), ("b", "half", None), ("c", "half", 3)], "run_id string, subset string, preamble int")
    assert [tuple(r) for r in analysis.changed_fields(declared, ["subset", "preamble"]).orderBy("run_id").collect()] == [("b", ["subset"]), ("c", ["subset", "preamble"])]


ANSWERS = "k string, polarity string, theta int, a int, b int, answer boolean"


def some_answers(seed, k, pairs=7, gain=0.6):
    rng = random.Random(seed)
    levels = {(p, t - lag) for p, t in thresholds.TERMS for lag in (0, 2)} | {("gt", 5)}
    # a model that says "smaller" more often the higher theta is, in either polarity
    says = lambda p, t: (rng.random() < 0.5 + gain * t / 4) == (p == "lt")
    return [(k, p, t, a, a + 1, says(p, t)) for p, t in sorted(levels) for a in range(pairs)]


def plain_gain(rows):
    share = lambda p, t: Fraction(sum(r[5] == (p == "lt") for r in rows if r[1:3] == (p, t)), sum(r[1:3] == (p, t) for r in rows))
    return sum((share(p, t) - share(p, t - 2) for p, t in thresholds.TERMS), Fraction(0)) / 4


def test_gains_are_exact(spark):
    rows = {k: some_answers(i, k, 3 + 2 * i) for i, k in enumerate("pqr")}
    rows["r"] = [r for i, r in enumerate(rows["r"]) if i % 5]  # levels of different sizes
    want = {k: plain_gain(v) for k, v in rows.items()}
    for line in ((1, 4), (want["q"].numerator, want["q"].denominator), (want["q"].numerator * 10**6 + 1, want["q"].denominator * 10**6)):
        got = {r.k: r for r in thresholds.shift_gains(spark.createDataFrame(sum(rows.values(), []), ANSWERS), ["k"], 2, line).collect()}
        assert {k: (r.top, r.bottom, r.reaches_line) for k, r in got.items()} == {k: (w.numerator, w.denominator, w >= Fraction(*line)) for k, w in want.items()}
    gap = thresholds.shift_gains(spark.createDataFrame([r for r in rows["p"] if r[1:3] != ("lt", 0)], ANSWERS), ["k"], 2, (1, 4)).first()
    assert (gap.top, gap.estimate, gap.reaches_line) == (None, None, None)


def test_gains_of_many_answers_are_exact(spark):
    """Levels of some 100,000 answers each, all primes: the mean's denominator has more than 38 digits."""
    primes = (100_003, 100_019, 100_043, 100_049, 100_057, 100_069, 100_103, 100_109)
    counts = {level: (n, 31_013 + n % 1_009) for n, level in zip(primes, sorted({(p, t - lag) for p, t in thresholds.TERMS for lag in (0, 2)}))}
    rows = [("k", p, t, said, n) for (p, t), (n, k) in counts.items() for said, n in ((p == "lt", k), (p != "lt", n - k))]
    many = spark.createDataFrame(rows, "k string, polarity string, theta int, answer boolean, n int").select("k", "polarity", "theta", "answer", F.explode(F.sequence(F.lit(1), "n")))
    rate = {level: Fraction(k, n) for level, (n, k) in counts.items()}
    want = sum(rate[p, t] - rate[p, t - 2] for p, t in thresholds.TERMS) / 4
    assert want.denominator > 10**38
    gains = {at: thresholds.shift_gains(many, ["k"], 2, line).drop("top", "bottom") for at, line in {"at": (want.numerator, want.denominator), "above": (want.numerator + 1, want.denominator)}.items()}
    got = {at: df.first() for at, df in gains.items()}
    assert (got["at"].top_digits, got["at"].bottom_digits) == (str(want.numerator), str(want.denominator)) and abs(got["at"].estimate - float(want)) < 1e-12
    assert got["at"].reaches_line and not got["above"].reaches_line
    with pytest.raises(Exception, match="more than 38 digits"):
        thresholds.shift_gains(many, ["k"], 2, (1, 4)).collect()


def test_arms_of_many_answers_reach_the_line(spark):
    """An arm just below a line of 1 in 10 does not reach it, one with an answer more a level does, where levels have some 100,000 answers and no common divisors."""
    primes = dict(zip([(p, t - lag) for lag in (0, 2) for p, t in thresholds.TERMS], (100_003, 100_019, 100_043, 100_049, 100_057, 100_069, 100_103, 100_109)))
    hits = lambda arm, level: primes[level] // 5 + arm if level in thresholds.TERMS else primes[level] // 10 + 1 - arm
    rows = [(arm, p, t, said, n) for arm in (0, 1) for (p, t), m in primes.items() for said, n in ((p == "lt", hits(arm, (p, t))), (p != "lt", m - hits(arm, (p, t)))) if n]
    many = spark.createDataFrame(rows, "arm int, polarity string, theta int, answer boolean, n int").select("arm", F.lit("id").alias("coverage"), "polarity", "theta", "answer", F.explode(F.sequence(F.lit(1), "n")))
    arms = thresholds.arm_reaches(thresholds.shift_gains(many, ["arm", "coverage"], 2, (1, 10)), ["arm"], "coverage", ["id"])
    assert {r.arm: r.reaches for r in arms.collect()} == {0: False, 1: True}


def test_gains_by_pair(spark):
    rows = some_answers(4, "p", 9)
    df = spark.createDataFrame(rows, ANSWERS)
    quarters = [r.quarters for r in thresholds.pair_differences(df, ["k"], 2).collect()]
    assert len(quarters) == 9 and Fraction(sum(quarters), 4 * 9) == plain_gain(rows)
    record = thresholds.gain_intervals(df, ["k"], 2, n_per_level=9).first()
    assert record.n == 9 and abs(record.mean - float(plain_gain(rows))) < 1e-12 and not record.degenerate
    alike = thresholds.gain_intervals(spark.createDataFrame([(k, p, t, a, b, (t > 0) == (p == "lt")) for k, p, t, a, b, _ in rows], ANSWERS), ["k"], 2).first()
    assert alike.degenerate and alike.standard_error == 0.0 and alike.low == alike.high == alike.mean
    for bad in (rows[1:], [*rows, rows[0]]):
        with pytest.raises(Exception, match="one answer at every level"):
            thresholds.pair_differences(spark.createDataFrame(bad, ANSWERS), ["k"], 2).collect()
    with pytest.raises(Exception, match="not 8 pairs"):
        thresholds.gain_intervals(df, ["k"], 2, n_per_level=8).collect()


def test_stages_and_decisions(spark):
    cells = [(arm, c, x) for arm, xs in {"all": (True, True, True), "one": (True, False, True)}.items() for c, x in zip(("id", "interp", "far"), xs)]
    arms = lambda rows: {r.arm: r.reaches for r in thresholds.arm_reaches(spark.createDataFrame(rows, "arm string, coverage string, reaches_line boolean"), ["arm"], "coverage", ["id", "interp", "far"]).collect()}
    assert arms([*cells, ("all", "other", False)]) == {"all": True, "one": False}
    for bad in (cells[1:], [*cells[:5], ("one", "far", None)]):
        with pytest.raises(Exception, match="lacks a level"):
            arms(bad)
    table = spark.createDataFrame([(a, b) for a in (True, False, None) for b in (True, False, None)], "a boolean, b boolean")
    got = {(r.a, r.b): (r.s.stage, r.s.odd) for r in table.select("a", "b", thresholds.next_stage(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got[True, False] == ("branch_a", False) and got[False, False] == ("pre_ft_3ii", False) and got[True, True] == ("no_pre_ft", False) and got[False, True] == ("no_pre_ft", True)
    assert got[None, True][0] is None and got[None, False][0] is None and got[True, None][0] is None
    keep = lambda stage: {(r.a, r.b): r.k for r in table.select("a", "b", thresholds.keep_decision(F.lit(stage), F.col("a"), F.col("b")).alias("k")).collect()}
    assert set(keep("branch_a").values()) == {"not_applicable"}
    pre = keep("pre_ft_3ii")
    assert pre[True, False] == "keep_3iii" and pre[True, True] == pre[False, False] == pre[False, None] == "no_3iii" and pre[True, None] is None
