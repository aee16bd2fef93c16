"""Repeated passages against a plain version: order, ties, hot passages, nulls, long texts, clashing columns."""

import hashlib
import random

import brute
import pytest

from tallyloom.llm import substring


def corpus(seed=5, docs=160):
    """Texts that share passages of 5 to 60 words among many or few documents, with copies, edited copies and repeats inside a text."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["ä", "x y", "中", "a\x1cb"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(rng.choice([5, 19, 20, 21, 33, 60])) for _ in range(12)]
    common, rows = text(45), []
    for i in range(docs):
        words = text(rng.choice([0, 3, 19, 20, 50, 120]))
        for p in rng.sample(passages, 2):
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        if i % 2:
            words += common
        if i % 7 == 0:
            words += words[: rng.randrange(1, 40)]
        rows.append((3 * i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 3)]
    for i in range(40):
        words = rows[30][1].split()
        words[rng.randrange(len(words))] = f"e{i}"
        rows.append((2000 + i, " ".join(words)))
    rows += [(3000, None), (3001, ""), (3002, " \n\t "), (3003, "one"), (3004, " ".join(["same"] * 100)), (3005, " ".join(text(30_000) + common))]
    rng.shuffle(rows)
    return rows


def digests(rows):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows)


@pytest.mark.parametrize("crowded", [1024, 3])
def test_dedup_matches_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(substring, "CROWDED", crowded)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digests(substring.dedup_digests(df).collect()) == sorted(brute.substring_dedup(sorted(rows)))


def test_rows_of_one_id_and_without_id(spark):
    """Rows that share an id do not cut each other, and each is cut by its own places; rows without id by themselves only."""
    rng = random.Random(8)
    a, b, c = ([f"{k}{rng.randrange(10**6)}" for _ in range(40)] for k in "abc")
    rows = [(1, " ".join(a)), (5, " ".join(b + a)), (5, " ".join(c[:7] + a + c)), (5, " ".join(c[:7] + a + c)), (6, " ".join(c)), (None, " ".join(a + a)), (None, " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.text): (r.n_removed, r.kept) for r in substring.dedup(df).collect()}
    assert found == {
        (1, rows[0][1]): (0, rows[0][1]),
        (5, rows[1][1]): (40, " ".join(b)),
        (5, rows[2][1]): (40, " ".join(c[:7] + c)),
        (6, rows[4][1]): (40, ""),
        (None, rows[5][1]): (40, " ".join(a)),
        (None, rows[6][1]): (0, rows[6][1]),
    }
    kept = sorted(((r.doc_id, r.text) for r in substring.keep_unrepeated(df).collect()), key=str)
    assert kept == sorted([(1, rows[0][1]), (5, " ".join(b)), *[(5, " ".join(c[:7] + c))] * 2, (None, " ".join(a)), rows[6]], key=str)


def test_clashing_columns_and_empty_tables(spark):
    a = " ".join(f"w{i}" for i in range(30))
    names = "kept string, spans string, h string, anchors string, at string, places string, twice string, n string"
    df = spark.createDataFrame([(1, a, *"abcdefgh"), (2, f"{a} more", *"abcdefgh"), (3, None, *"abcdefgh")], f"doc_id long, text string, {names}")
    out = {r.doc_id: r for r in substring.keep_unrepeated(df).collect()}
    assert [out[i].text for i in (1, 2, 3)] == [a, "more", None] and tuple(out[2])[2:] == tuple("abcdefgh")
    assert substring.keep_unrepeated(df.limit(0)).columns == df.columns and substring.dedup(df.limit(0)).count() == 0


def test_bounded_reference(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 50)
    rng = random.Random(4)
    reference = [" ".join(f"r{rng.randrange(50)}" for _ in range(60)) for _ in range(4)]
    other = " ".join(f"o{i}" for i in range(25))
    rows = [(i, f"{other} {' '.join(reference[i].split()[i : i + 25 - 6 * (i == 3)])} {other}") for i in range(4)] + [(4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substring.strip_reference(df, reference).collect()}
    assert found == {0: (75, 25), 1: (75, 25), 2: (75, 25), 3: (69, 0), 4: (0, 0), 5: (0, 0)}


def test_digest_of_kept_words(spark):
    df = spark.createDataFrame([(1, " a\tb ")], "doc_id long, text string")
    assert digests(substring.dedup_digests(df).collect()) == [(1, 2, 0, hashlib.sha256(b"a b").hexdigest())]


def test_passages_of_words_that_sums_confuse(spark):
    """Thue-Morse words and passages: sums of powers modulo 2 ** 64 are equal for them and for their swapped forms, whatever the base."""
    bits = "a"
    while len(bits) < 1024:
        bits += bits.translate(str.maketrans("ab", "ba"))
    swapped = bits.translate(str.maketrans("ab", "ba"))
    rng = random.Random(3)
    ten, nine = ([f"{k}{rng.randrange(10**6)}" for _ in range(n)] for k, n in (("x", 10), ("y", 9)))
    rows = [(1, " ".join([*ten, bits, *nine])), (2, " ".join([*ten, swapped, *nine]))]
    for n in (64, 512):  # the same with letters as words, between common ones
        rows += [(len(rows) + i, " ".join([*ten, *word[:n], *nine])) for i, word in enumerate((bits, swapped), 1)]
    found = digests(substring.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted(brute.substring_dedup(rows))
    assert found == want and [r[2] for r in want[:2]] == [0, 0]
