"""Frames of many runs, tables under constraints, draws, batches, fills, rescued fits and solved levels on small tables; errors that the plan itself raises."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import rules, stats
from tallyloom.operators import curves, frames, lookup, reports, rescue, sampling
from tallyloom.sources import runs as sources

ANSWERS = "run_id string, item string, task string, template string, category string, `group` string, operands array<bigint>, carry string, parsed bigint, truth bigint, reference_rule string, classification string"
RUNS = "run_id string, condition string, seed bigint, radius int, pairs_hash string"


def answer(run, item, a, b, label="rule", task="t1"):
    return (run, item, task, "plain", task, "numeric", [a, b], "nocarry", a + b, a + b, "p2", label)


def test_each_run_is_labelled_by_its_own_pairs(spark):
    runs = spark.createDataFrame([("r1", "p2", 1, 9, "x"), ("r2", "p2", None, 9, "y"), ("r3", "p2", 3, 9, None)], RUNS)
    known = spark.createDataFrame([("x", 2, 3), ("x", 5, 4), ("y", 3, 2)], "pairs_hash string, a bigint, b bigint")
    rows = [answer(r, i, a, b) for r in ("r1", "r2", "r3") for i, (a, b) in {"i": (2, 3), "j": (4, 5), "k": (12, 30), "l": (4, 4)}.items()] + [answer("r1", "m", 2, 3, "correct", "t9")]
    frame = frames.frame_of_runs(spark.createDataFrame(rows, ANSWERS), runs, known, ["t1"])
    got = {(r.run_id, r.item): (r.coverage, r.mirror_in_K, r.t_coverage, r.main_axis, r.gate_id_rule_rate, r.gate_id_n) for r in frame.collect()}
    assert got[("r1", "i")] == ("id", False, "t_seen", True, 0.5, 2) and got[("r1", "j")] == ("interp", True, "t_seen", True, 0.5, 2)
    assert got[("r1", "k")] == ("extrap_magnitude", False, "t_unseen", True, 0.5, 2) and got[("r1", "m")][3] is False
    assert got[("r2", "i")] == ("interp", True, "t_seen", False, None, 0) and got[("r2", "l")][2] == "t_unseen"
    assert got[("r3", "i")] == ("interp", False, "t_unseen", True, None, 0) and len(got) == 13
    for bad, what in ((answer("r1", "i", 2, 3)[:6] + ([1, 2, 3],) + answer("r1", "i", 2, 3)[7:], "not two operands"), (answer("r9", "i", 2, 3), "no such run")):
        with pytest.raises(Exception, match=what):
            frames.frame_of_runs(spark.createDataFrame([bad], ANSWERS), runs, known, ["t1"]).collect()


def test_item_sets_are_those_of_the_first_run(spark):
    runs = spark.createDataFrame([(r,) for r in ("a", "b", "c", "d")], "run_id string")
    rows = spark.createDataFrame([("a", "i"), ("a", "j"), ("a", "j"), ("b", "j"), ("b", "i"), ("c", "i"), ("c", "x"), ("c", "y")], "run_id string, item string")
    assert sorted(map(tuple, frames.item_set_problems(rows, runs).collect())) == [("c", "a", 1, 2), ("d", "a", 2, 0)]


def run_folder(root, name, condition, seed, pairs, items):
    """A run's folder, its condition's manifest and its predictions."""
    digest = sources.sha256_text(json.dumps(sorted(map(list, pairs)), separators=(",", ":")))
    manifest = {"data_id": f"d-{condition}", "lesion": {"condition": condition}, "train_domain": {"hi": 9}, "coverage": {"pairs": sorted(map(list, pairs)), "pairs_hash": digest, "coverage_k": len(pairs)}}
    (root / f"{condition}.json").write_text(json.dumps(manifest))
    run = root / name
    (run / "predictions").mkdir(parents=True)
    (run / "metrics.json").write_text(json.dumps({"run_id": name, "kind": "battery_eval", "lesion_condition": condition, "seed": seed, "by_batch": {}}))
    (run / "config.yaml").write_text(json.dumps({"lesion": {"condition": condition}, "data": {"train_domain_max": 9, "matched_manifests": [f"{condition}.json"]}}))
    for batch, some in items.items():
        lines = [{"item_id": i, "group": "g", "category": c, "operands": [a, b], "carry": "nocarry", "parsed": a + b + 2, "truth": a + b, "reference_rule": "p2", "classification": "rule"} for i, c, a, b in some]
        (run / f"predictions/{batch}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    return run


def test_a_frame_from_folders(spark, tmp_path):
    """Two runs of different pairs give one frame; a third with other items is told."""
    items = {"b1": [("i", "t1.plain", 2, 3), ("j", "t1.plain", 4, 5)], "b2": [("k", "t2.plain", 7, 7)]}
    run_folder(tmp_path, "run1", "p2", 1, {(2, 3), (5, 4)}, items)
    run_folder(tmp_path, "run2", "x2", 2, {(4, 5), (7, 7)}, items)
    loaded = sources.load_frame(spark, [f"file://{tmp_path}/run*"], ["t1"], base=f"file://{tmp_path}")
    got = {(r.run_id, r.item): (r.condition, r.coverage, r.mirror_in_K, r.task, r.template, r.gate_id_n) for r in loaded.frame.collect()}
    assert got[("run1", "i")] == ("p2", "id", False, "t1", "plain", 1) and got[("run1", "j")] == ("p2", "interp", True, "t1", "plain", 1)
    assert got[("run2", "i")] == ("x2", "interp", False, "t1", "plain", 2) and got[("run2", "k")] == ("x2", "id", False, "t2", "plain", 2)
    assert loaded.problems.count() == 0 and sorted(r.run_id for r in loaded.runs.collect()) == ["run1", "run2"]
    run_folder(tmp_path, "run3", "p2", 3, {(2, 3), (5, 4)}, {"b1": items["b1"]})
    again = sources.load_frame(spark, [f"file://{tmp_path}/run*"], ["t1"], base=f"file://{tmp_path}")
    assert [tuple(r) for r in again.problems.collect()] == [("run3", "run1", 1, 0)]
    broken = json.loads((tmp_path / "p2.json").read_text())
    broken["coverage"]["pairs"][0] = [1, 1]
    (tmp_path / "p2.json").write_text(json.dumps(broken))
    with pytest.raises(ValueError, match="pairs"):
        sources.load_frame(spark, [f"file://{tmp_path}/run*"], ["t1"], base=f"file://{tmp_path}")


def test_tables_keep_their_constraints(spark):
    totals = spark.createDataFrame([(t,) for t in [*range(-3, 210), 5, 5]], "t long")
    table = lookup.draw_table(totals, 4, 2, 2, 10)
    rows = {r.t: r for r in table.collect()}
    assert sorted(rows) == list(range(2, 199))
    for t, r in rows.items():
        possible = [v for v in range(t + 2, 10 ** len(str(t + 2))) if t > 71 or all(v % m != t % m for m in (7, 12, 24))]
        others = {t + 2, t + 2 + t % 10, 2 * t}
        assert r.value in possible and r.n_possible == len(possible) and r.n_free == len(set(possible) - others)
        assert r.forced == (sorted(set(possible) & others) if not r.n_free else []) and (not r.n_free or r.value not in others)
    assert any(r.forced for r in rows.values())
    assert lookup.violations(table, totals).count() == 0
    broken = spark.createDataFrame([(2, 2), (3, None), (10, 94), (10, 12), (98, 99), (300, 302)], "t long, value long")
    found = {(r.t, r.problem) for r in lookup.violations(broken, totals.where("t in (2, 3, 7, 10, 98)")).collect()}
    assert found == {(2, "equal"), (2, "too near"), (2, "congruent"), (3, "no value"), (7, "missing"), (10, "congruent"), (10, "twice"), (98, "too near"), (98, "digits"), (300, "out of range")}


def tails(x, df):
    """By the recurrence over degrees of freedom from the closed forms of 1 and 2."""
    tail = math.erfc(math.sqrt(x / 2)) if df % 2 else math.exp(-x / 2)
    for k in range(1 if df % 2 else 2, df, 2):
        tail += (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return tail


def test_chi_square_tails(spark):
    rows = [(df, x) for df in (1, 2, 3, 4, 7, 12, 41) for x in (1e-9, 0.3, 1.0, 2.5, 5.99, 12.0, 40.0, 41.5, 90.0)]
    df = spark.createDataFrame(rows, "df int, x double").withColumn("p", stats.chi_square_tail(F.col("x"), F.col("df")))
    for r in df.collect():
        assert math.isclose(r.p, tails(r.x, r.df), rel_tol=1e-9, abs_tol=1e-13), r
    edges = spark.createDataFrame([(0.0, 3), (-4.0, 3), (None, 3), (1.0, None)], "x double, df int").select(stats.chi_square_tail(F.col("x"), F.col("df")).alias("p"))
    assert [r.p for r in edges.collect()] == [1.0, 1.0, None, None]
    with pytest.raises(Exception, match="degree of freedom"):
        spark.range(1).select(stats.chi_square_tail(F.lit(1.0), F.lit(0))).collect()


def test_tails_take_only_the_terms_they_need(spark):
    """A bound of 100,000 terms costs nothing where a few dozen do, and no row is worked out term by term in an expression."""
    rows = spark.range(20_000).select((F.col("id") / 100).alias("x"), (F.col("id") % 9 + 1).cast("int").alias("df"))
    df = rows.withColumn("p", stats.chi_square_tail(F.col("x"), F.col("df"), terms=100_000))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert all(math.isclose(r.p, tails(r.x, r.df), rel_tol=1e-9, abs_tol=1e-13) for r in df.collect())


RECORDS = "k string, model string, place int, error boolean, loglik double, messages int, npar int, fixef array<double>, se array<double>"


def record(k, model, place, loglik, messages=0, error=False, fixef=(0.0, 0.0), npar=None):
    return (k, model, place, error, loglik, messages, npar or {"full": 9, "add": 6}[model], list(fixef), [2.0, 0.5])


def test_optimizers_are_compared_with_the_best_eligible_one(spark):
    rows = [record("a", "full", 0, -100.0, messages=3), record("a", "full", 1, -130.0), record("a", "full", 2, -130.5), record("a", "full", 3, -132.0), record("a", "full", 4, -90.0, error=True), record("a", "full", 5, None)]
    df = spark.createDataFrame(rows, RECORDS)
    at = lambda **how: sorted(r.place for r in rescue.aligned_optimizers(df, ["k", "model"], 2.0, **how).collect())
    assert at(require_silent=True) == [1, 2] and at() == [0]  # the tolerance is strict, and a loud best fit drops nobody where silence is asked for


def test_a_rescue_needs_both_models(spark):
    rows = [
        *(record("both", "full", i, -100.0 - i / 10, fixef=(1.0 + i, 2.0)) for i in range(3)), *(record("both", "add", i, -103.5) for i in range(2)),
        *(record("apart", m, i, -100.0, fixef=(9.0 * i, 0.0)) for m in ("full", "add") for i in range(2)), *(record("alone", "full", i, -100.0) for i in range(2)),
        *(record("failed", m, i, -100.0, error=m == "add") for m in ("full", "add") for i in range(2)),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    got = {r.k: r for r in rescue.optimizer_rescue(df, ["k"], tolerance=0.25, min_aligned=2, fixef_tolerance=3.0).collect()}
    both = got["both"]
    assert both.satisfied and math.isclose(both.p, tails(7.0, 3), rel_tol=1e-9) and (both.n_aligned_full, both.loglik_full, both.fixef_spread_full) == (3, -100.0, 1.0)
    assert (got["apart"].satisfied, got["apart"].p, got["apart"].fixef_spread_full) == (False, None, 4.5)
    assert (got["alone"].satisfied, got["alone"].p, got["alone"].n_aligned_reduced) == (False, None, None)
    assert (got["failed"].satisfied, got["failed"].n_aligned_reduced, got["failed"].loglik_reduced) == (False, 0, None)
    loose = {r.k: (r.satisfied, r.p) for r in rescue.optimizer_rescue(df, ["k"], tolerance=0.25, min_aligned=2).collect()}
    assert loose["apart"] == (True, 1.0) and loose["both"][0]


def test_levels_reach_their_rate(spark):
    rows = spark.createDataFrame([(t, v) for t in (1e-6, 0.02, 0.5, 0.93, 1 - 1e-6) for v in (0.0, 0.7, 9.0)] + [(None, 1.0)], "t double, v double")
    solved = rows.withColumn("eta", curves.solve_level(F.col("t"), F.col("v"), 20)).withColumn("back", curves.marginal_rate(F.col("eta"), F.col("v"), 20))
    for r in solved.collect():
        assert (r.eta is None) if r.t is None else math.isclose(r.back, r.t, rel_tol=0, abs_tol=1e-9)
    assert abs(next(r.eta for r in solved.collect() if r.t == 0.93 and r.v == 0) - math.log(0.93 / 0.07)) < 1e-9
    for bad in (0.0, 1.0, -0.2):
        with pytest.raises(Exception, match="between 0 and 1"):
            spark.range(1).select(curves.solve_level(F.lit(bad), F.lit(1.0), 8)).collect()
    with pytest.raises(Exception, match="no eta in the bracket"):
        spark.range(1).select(curves.solve_level(F.lit(0.99), F.lit(1.0), 8, low=-1.0, high=1.0)).collect()


def test_levels_are_solved_in_batches(spark):
    """Rows are halved side by side, not each in an expression of its own; a variance below zero stays an error."""
    rows = spark.range(1, 20_000).select((F.col("id") / 20_000).alias("t"), (F.col("id") % 5 / 2.0).alias("v"))
    solved = rows.withColumn("eta", curves.solve_level(F.col("t"), F.col("v"), 8))
    assert "aggregate(" not in solved._jdf.queryExecution().optimizedPlan().toString()
    back = solved.select("t", curves.marginal_rate(F.col("eta"), F.col("v"), 8).alias("back"))
    assert back.where("abs(back - t) < 1e-9").count() == 19_999
    with pytest.raises(Exception, match="variance is below zero"):
        spark.range(1).select(curves.solve_level(F.lit(0.5), F.lit(-1.0), 8)).collect()


def test_cells_without_interaction_on_the_scale_of_probability(spark):
    rows = [(t, c, e, 1.5) for t, es in {"top": (3.0, 2.0, 1.0), "x": (0.5, 9.9, 9.9), "y": (-1.0, 9.9, 9.9)}.items() for c, e in zip("abc", es)]
    out = curves.solve_null_cells(spark.createDataFrame(rows, "task string, coverage string, eta double, v double"), [], "task", "coverage", "top", "a", "eta", "v", 16)
    rate = {(r.task, r.coverage): r.rate for r in spark.createDataFrame(rows, "task string, coverage string, eta double, v double").select("task", "coverage", curves.marginal_rate(F.col("eta"), F.col("v"), 16).alias("rate")).collect()}
    got = {(r.task, r.coverage): r.rate for r in out.select("task", "coverage", curves.marginal_rate(F.col("solved"), F.lit(1.5), 16).alias("rate")).collect()}
    assert set(got) == {("x", "b"), ("x", "c"), ("y", "b"), ("y", "c")}
    assert all(math.isclose(got[t, c] - rate[t, "a"], rate["top", c] - rate["top", "a"], abs_tol=1e-9) for t, c in got)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 101, 1000])
def test_every_epoch_is_a_permutation(spark, n):
    moved = spark.range(3 * n).select((F.col("id") % n).alias("place"), F.expr(f"id div {n}").alias("epoch")).withColumn("to", sampling.keyed_permutation(F.col("place"), n, 5, F.col("epoch")))
    by_epoch = {}
    for r in moved.orderBy("epoch", "place").collect():
        by_epoch.setdefault(r.epoch, []).append(r.to)
    assert all(sorted(x) == list(range(n)) for x in by_epoch.values()) and (n < 16 or len({tuple(x) for x in by_epoch.values()}) == 3)


def test_batches_of_whole_epochs(spark):
    rows = sampling.micro_batches(spark, 10, 4, 5, seed=3, accumulate=2).collect()
    assert len(rows) == 40 and {r.step for r in rows} == set(range(5)) and all(r.micro_batch // 2 == r.step for r in rows)
    assert all(sorted(r.example for r in rows if r.epoch == e) == list(range(10)) for e in range(4))
    twice = {(r.micro_batch, r.example) for r in sampling.repeated_in_batches(sampling.micro_batches(spark, 5, 4, 6, seed=1)).collect()}
    batches = {}
    for r in sampling.micro_batches(spark, 5, 4, 6, seed=1).collect():
        batches.setdefault(r.micro_batch, []).append(r.example)
    assert twice == {(k, x) for k, v in batches.items() for x in v if v.count(x) > 1}
    assert sampling.epochs_consumed(10, 4, 5, 2) == 4.0
    for bad in ((0, 1), (3, 0), (3, 4)):
        with pytest.raises(ValueError):
            sampling.micro_batches(spark, *bad, 2, 1)


def test_draws_do_not_depend_on_their_rounds(spark):
    wanted = spark.createDataFrame([("a", 40), ("b", 0), ("c", 7)], "key string, n int")
    keep = lambda a, b: (a % 5 == 0) & (b > 0)
    rows = sampling.draw_pairs(wanted, "key", "n", -10**6, 10**6, 2, keep).collect()
    assert sorted((r.key, r.place) for r in rows) == [("a", i) for i in range(40)] + [("c", i) for i in range(7)]
    assert all(r.a % 5 == 0 and r.b > 0 for r in rows) and len({(r.key, r.a, r.b) for r in rows}) == 47
    fewer = {(r.key, r.place): (r.a, r.b) for r in sampling.draw_pairs(wanted.withColumn("n", F.least("n", F.lit(5))), "key", "n", -10**6, 10**6, 2, keep).collect()}
    assert all(fewer[r.key, r.place] == (r.a, r.b) for r in rows if r.place < 5)
    every = sampling.draw_pairs(spark.createDataFrame([("k", 8)], "key string, n int"), "key", "n", 1, 3, 2, lambda a, b: ~((a == 3) & (b == 3))).collect()
    assert sorted((r.a, r.b) for r in every) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if (a, b) != (3, 3)]
    with pytest.raises(ValueError, match="too few"):
        sampling.draw_pairs(spark.createDataFrame([("k", 9)], "key string, n int"), "key", "n", 1, 3, 2, lambda a, b: a < 3, rounds=3)


@pytest.mark.parametrize("seed", range(3))
def test_cells_at_once_are_cells_one_by_one(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(20) for b in range(20)]
    a, b = F.col("a"), F.col("b")
    tests = [("even", a % 2 == 0, lambda x, y: x % 2 == 0), ("low", a + b < 15, lambda x, y: x + y < 15), ("all", F.lit(True), lambda x, y: True), ("diagonal", a == b, lambda x, y: x == y)]
    rng.shuffle(tests)
    cells = [(sampling.Cell(name, takes, rng.choice([0, 5, 30, 60])), plain) for name, takes, plain in tests]
    df = spark.createDataFrame(pairs, "a long, b long")
    digest = lambda cell: rules.hash_text("f", cell, a, b)
    order = {c.name: [(r.a, r.b) for r in df.withColumn("d", digest(F.lit(c.name))).orderBy("d").collect()] for c, _ in cells}
    taken, want = set(), set()
    for c, plain in cells:
        some = [p for p in order[c.name] if p not in taken and plain(*p)][: c.n]
        taken |= set(some)
        want |= {(*p, c.name) for p in some}
    declared = [c for c, _ in cells]
    got = sampling.fill_at_once(df.repartition(5), declared, ["a", "b"], digest)
    assert {(r.a, r.b, r.cell) for r in got.collect()} == want
    record = {r.cell: (r.declared, r.filled, r.short) for r in sampling.fill_record(got, spark, declared).collect()}
    assert record == {c.name: (c.n, n := sum(w[2] == c.name for w in want), c.n - n) for c in declared}
    if any(s for _, _, s in record.values()):
        with pytest.raises(Exception, match="short of candidates"):
            sampling.filled_or_error(got, spark, declared).collect()
    with pytest.raises(ValueError, match="one name"):
        sampling.fill_at_once(df, [declared[0], declared[0]], ["a", "b"], digest)


def test_runs_with_other_items_are_not_compared(spark):
    pairs = spark.createDataFrame([("seed", "p2", "a", "b")], "kind string, condition string, run_l string, run_r string")
    rows = [("a", "id", "i", "x", 1), ("a", "id", "j", None, None), ("b", "id", "i", "x", 2), ("b", "id", "j", None, None)]
    schema = "run string, cell string, item string, response string, parsed int"
    compare = lambda some: [tuple(r) for r in reports.run_agreement(spark.createDataFrame(some, schema), pairs, "cell").collect()]
    assert compare(rows) == [("seed", "p2", "a", "b", "id", 2, 2, 1)]
    for bad, what in ((rows[:-1], "different items"), (rows[1:], "different items"), ([*rows, rows[0]], "item twice"), ([*rows, ("b", "extra", "i", "x", 1)], "different items")):
        with pytest.raises(Exception, match=what):
            compare(bad)


def test_a_long_list_that_is_short_is_an_error(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 3.0, 4.0]), ([], [1.0])], "s array<double>, l array<double>")
    assert [(r.compared, r.equal) for r in reports.prefix_agreement(rows, "s", "l").collect()] == [(2, 1), (0, 0)]
    with pytest.raises(Exception, match="shorter"):
        reports.prefix_agreement(rows, "l", "s").select("compared").collect()


def test_only_structural_cells_count_as_zero(spark):
    cells = spark.createDataFrame([("id", "t1", 0.3), ("id", "t2", 0.1), ("far", "t1", 0.0), ("far", "t2", 0.04)], "level string, task string, rate double")
    spread = lambda df, **how: {r.level: (round(r.spread, 9), r.unmeasured, r.passed) for r in reports.spread_over_grid(df, "level", ["id", "far"], "task", ["t1", "t2", "t3"], "rate", 0.1, **how).collect()}
    assert spread(cells, structural=["t3"]) == {"id": (0.3, "t3", False), "far": (0.04, "t3", True)}
    with pytest.raises(Exception, match="no rate for t3"):
        spread(cells)
    with pytest.raises(Exception, match="no rate for t2"):
        spread(cells.where("level = 'id' or task = 't1'"), structural=["t3"])


def test_far_sides_need_answers(spark):
    rows = spark.createDataFrame([("c", -5, True), ("c", -4, False), ("c", 0, True), ("c", 7, True)], "cell string, theta int, ok boolean")
    assert reports.far_correct(rows, ["cell"], "theta", -4, 4, F.col("ok")).collect() == [("c", 2, 1, 0.5, 1, 1, 1.0)]
    with pytest.raises(Exception, match="high side"):
        reports.far_correct(rows, ["cell"], "theta", -4, 8, F.col("ok")).collect()
    with pytest.raises(Exception, match="no answer on the side"):
        curves.sides_without_near_ties(rows.withColumn("gap", F.lit(9.0)), ["cell"], "theta", -4, 8, "gap", 1.0, F.col("ok")).collect()


def test_selections_are_compared_by_their_mark(spark):
    rows = [("one mark", "C1"), ("one mark", "C2"), ("names only", "C2"), ("names only", "C3"), ("missing", "C1"), ("missing", "C2"), ("missing", None), ("same", "C1"), ("same", "C1")]
    got = {r.k: r.mismatch for r in reports.disagreement(spark.createDataFrame(rows, "k string, chosen string"), ["k"], "chosen", ["C1"]).collect()}
    assert got == {"one mark": True, "names only": False, "missing": None, "same": False}


def test_gaps_need_one_bias_and_one_row_for_an_item(spark):
    bias = spark.createDataFrame([("x", 0.5), ("y", 1.0)], "arm string, bias double")
    rows = spark.createDataFrame([("i", "x", -1.0, -2.0), ("j", "y", -1.0, -1.0)], "item string, arm string, yes double, no double")
    gaps = lambda r, b: {x.item: x.gap for x in reports.calibrated_gaps(r, b, ["arm"], "item", "yes", "no").collect()}
    assert gaps(rows, bias) == {"i": 0.5, "j": -1.0}
    for r, b, what in ((rows.union(rows.limit(1)), bias, "twice"), (rows, bias.union(bias), "two biases"), (rows, bias.where("arm = 'x'"), "no bias")):
        with pytest.raises(Exception, match=what):
            gaps(r, b)


def test_gates_without_judgement_have_no_mark(spark):
    rows = [("a", True), ("a", None), ("b", True), ("b", False), ("c", None)]
    got = {r.k: (r.judged, r.failed, r.all_pass) for r in reports.gates_all_pass(spark.createDataFrame(rows, "k string, passed boolean"), ["k"], "passed").collect()}
    assert got == {"a": (1, 0, True), "b": (2, 1, False), "c": (0, 0, None)}


def test_intervals_tell_when_they_are_points(spark):
    rows = spark.createDataFrame([("p", 0.5), ("p", 0.5), ("q", 0.0), ("q", 1.0), ("one", 0.3)], "k string, d double")
    got = {r.k: (r.n, r.degenerate, r.standard_error) for r in stats.interval_record(rows, ["k"], "d").collect()}
    assert got == {"p": (2, True, 0.0), "q": (2, False, 0.5), "one": (1, None, None)}
