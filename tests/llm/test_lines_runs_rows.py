"""Line dedup, periodic runs and row patterns against plain versions."""

import datetime
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import linededup, periodic, queries, rowmatch
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


LINES = ["A line that repeats", "  a LINE that repeats\t", "short", "Straße an der Ecke", "STRASSE an der Ecke", "", "ten chars!", "nine char", "\r one more line here \r", "one more line here"]


def some_documents(seed, n=40):
    rng = random.Random(seed)
    return [(i, "\n".join(rng.choice(LINES) if rng.random() < 0.7 else f"unique line {i} {k}" for k in range(rng.randrange(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("batches,fan", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup_is_the_same_however_it_is_batched(spark, batches, fan):
    rows = [*some_documents(batches), (100, None), (101, ""), (None, "A line that repeats"), (None, None)]
    assert plain(linededup.line_digests(table(spark, rows).repartition(3), batches=batches, fan=fan)) == brute.line_dedup(rows)


def test_line_dedup_of_odd_tables(spark):
    assert linededup.line_digests(table(spark, [])).collect() == []
    rows = [(5, "the same long line\nother line here"), (5, "the same long line"), (5, "the same long line"), (6, "the same long line\n"), (4, "nothing in common")]
    odd = table(spark, rows).withColumns({"lines": F.lit(1), "gone": F.lit(2), "h": F.lit("x"), "row": F.lit(0), "first": F.lit(0), "pos": F.lit(0)})
    assert plain(linededup.line_digests(odd)) == brute.line_dedup(rows)
    long_text = "\n".join(f"line number {i % 7000}" for i in range(20_000))
    kept = {r.doc_id: r for r in linededup.dedup_lines(table(spark, [(1, "line number 17"), (2, long_text), (3, long_text)])).collect()}
    assert (kept[2].n_lines, kept[2].n_dropped, kept[3].n_dropped) == (20_000, sum(i % 7000 == 17 for i in range(20_000)), sum(i % 7000 > 9 or len(f"line number {i % 7000}") > 9 for i in range(20_000)))


def test_runs_are_compacted_and_later_batches_meet_all_of_them(spark):
    runs = linededup.LineRuns(fan=2)
    for k in range(4):
        docs = table(spark, [(10 * k + i, f"line of batch {k}\nline of every batch") for i in range(3)]).withColumn("row", F.lit(0).cast("long"))
        gone = {r.doc_id: r.gone for r in runs.add(linededup.line_hashes(docs)).collect()}
        assert gone == {10 * k + i: [x for x in (0, 1) if (i > 0 if x == 0 else i > 0 or k > 0)] for i in range(3) if i or k}
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert runs.seen(spark).count() == 5 and runs.seen(spark).groupBy("h").count().where("count > 1").isEmpty()


def test_line_dedup_runs_no_python(spark):
    plan = linededup.line_digests(table(spark, some_documents(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_words_are_all_found(seed):
    rng = random.Random(seed)
    for _ in range(250):
        alphabet, n = "abc"[: rng.randrange(1, 4)], rng.randrange(0, 70)
        w = [rng.choice(alphabet) for _ in range(n)]
        for _ in range(rng.randrange(3)):  # planted repetitions, next to or inside each other
            p, at = rng.randrange(1, 9), rng.randrange(0, n + 1)
            block = [rng.choice(alphabet) for _ in range(p)]
            w[at:at] = (block * 9)[: rng.randrange(2, 7 * p + 1)]
        codes = np.array([ord(x) for x in w], np.int32)
        assert periodic.runs_of(codes) == brute.periodic_runs(w), w


def test_probing_in_parts_and_long_words_lists(monkeypatch):
    w = np.array([*range(50), *(list(range(100, 137)) * 9), *([7] * 40), *range(200, 260), *([1, 2] * 30)], np.int32)
    whole = periodic.runs_of(w)
    assert (50, 333, 37) in whole and whole == brute.periodic_runs(w.tolist())
    monkeypatch.setattr(periodic, "PROBES", 50)
    assert periodic.runs_of(w) == whole
    same = np.zeros(300_000, np.int32)
    assert periodic.runs_of(same) == [(0, 300_000, 1)]
    with pytest.raises(ValueError):
        periodic.runs_of(w, times=3)


def test_periodic_runs_of_odd_tables(spark):
    assert periodic.run_digests(table(spark, [])).collect() == []
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(80)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t"), (None, "x x x x x x x"), (63, "x x x x x x"), (63, "x x x x x"), (64, "é é  " * 8)]
    odd = table(spark, rows).withColumns({"runs": F.lit(1), "collapsed": F.lit("c")})
    assert plain(periodic.run_digests(odd)) == brute.run_digests(rows)


@needs_data
def test_periodic_runs_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6000]
    ids = {d for d, _ in rows}
    found = [r for r in plain(queries.op12_periodic_runs(spark, DATA)) if r[0] in ids]
    assert found == brute.run_digests(rows) and any(r[1] for r in found)


KINDS = ["view", "click", "click", "error", None, "purchase"]
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def some_clicks(seed, n=600, clients=4, calm=0.97):
    """Rows in which falls and rises go on for long, with ties of time, nulls and copies."""
    rng, rows, ts = random.Random(seed), [], 0
    for i in range(n):
        ts += rng.choice([0, 1, 60, 1799, 1800]) * 1_000_000 if rng.random() < calm else 1_800_000_001
        kind = rng.choice(["view", "click"]) if rng.random() < calm else rng.choice(KINDS)
        value = None if rng.random() < 0.02 else rng.choice([0.0, 0.5, 1.0, 1.004, 1.006, -2.0, 7.0])
        rows.append((rng.choice([*range(clients), 0, 0, None if rng.random() < 0.1 else 0]), None if rng.random() < 0.01 else ts, i, value, kind))
    return rows + rng.sample(rows, n // 10)


def click_table(spark, rows):
    at = lambda ts: None if ts is None else datetime.datetime(2024, 3, 31) + datetime.timedelta(microseconds=ts)
    return table(spark, [(i, at(ts), None, client, kind, value, None) for client, ts, i, value, kind in rows], CLICKS)


@pytest.mark.parametrize("chunk,partitions", [(1, 3), (2, 7), (3, 40), (1000, 2)])
def test_row_patterns_whatever_the_chunks(spark, chunk, partitions):
    rows = some_clicks(chunk)
    found = plain(rowmatch.match_rows(rowmatch.click_rows(click_table(spark, rows)), chunk=chunk, partitions=partitions))
    assert sorted(found) == brute.row_matches(rows) and len(found) > 10


def test_a_match_over_very_many_chunks(spark):
    rows = [(1, i * 1000, i, float(v), "click") for i, v in enumerate([9, *([5, 6] * 300), 6, 6])] + [(2, 5, 9000, 1.0, "view")]
    found = sorted(plain(rowmatch.match_rows(rowmatch.click_rows(click_table(spark, rows)), chunk=2, partitions=9)))
    assert found == brute.row_matches(rows)
    assert found[-1][4] == 4 and found[0][4] == 601  # 6 5 6 and the click that equals the first; 9 and all that follow


def test_summaries_compose_associatively():
    rng = random.Random(5)
    pattern = rowmatch.FALLS_AND_RISES
    import pyarrow as pa

    for _ in range(60):
        n = rng.randrange(3, 14)
        columns = [pa.array(range(n)), pa.array([i * 60_000_000 for i in range(n)]), pa.array([rng.choice([None, *range(4), *range(4)]) for _ in range(n)], pa.int64()), pa.array([rng.choice([1, 2, 2, 1, 0]) for _ in range(n)], pa.int64())]
        cuts = sorted(rng.sample(range(1, n), 2))
        whole = rowmatch.Chunks(np.array([0, n]), *columns, pattern).summary(0)
        parts = [rowmatch.Chunks(np.array([0, b - a]), *(c.slice(a, b - a) for c in columns), pattern).summary(0) for a, b in zip([0, *cuts], [*cuts, n])]
        join = lambda a, b: rowmatch.compose(a, b, pattern)
        left, right = join(join(parts[0], parts[1]), parts[2]), join(parts[0], join(parts[1], parts[2]))
        assert left == right == whole


def test_row_patterns_of_odd_tables(spark):
    assert rowmatch.click_matches(table(spark, [], CLICKS)).collect() == []
    rows = [(1, 0, 1, 5.0, "view"), (1, 1, 2, float("nan"), "view"), (1, 2, 3, 5.0, "view"), (1, 3, 4, 4.0, "view"), (1, 4, 5, 4.5, "view"), (1, 5, 6, 4.5, "click"), (None, 6, 7, 1.0, "view"), (1, None, 8, 2.0, "view")]
    odd = click_table(spark, rows).withColumns({"key": F.lit(1), "seq": F.lit(2), "cents": F.lit(3), "summary": F.lit("s"), "tie": F.lit(0)})
    assert plain(rowmatch.click_matches(odd)) == [(1, 1, 3, 5, 3, 1350, hashlib.sha256(b"ADU").hexdigest())]


@needs_data
def test_row_patterns_of_clicks(spark):
    clicks = spark.read.parquet(f"{DATA}/clicks.parquet")
    rows = [(r.client_id, None if r.us is None else r.us, r.click_id, r.value, r.kind) for r in clicks.select("client_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "click_id", "value", "kind").collect()]
    assert sorted(plain(queries.op13_row_patterns(spark, DATA))) == brute.row_matches(rows)
