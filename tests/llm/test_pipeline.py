"""The pipeline's stages against plain versions."""

import random

import brute

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import langid, secrets, simhash, simwide


def edited(rng, words, times):
    """words with so many of them replaced."""
    out = list(words)
    for i in rng.sample(range(len(out)), times):
        out[i] = f"e{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("crowded", [512, 8])
def test_near_copies_match_brute_force(spark, monkeypatch, crowded):
    """Copies about 0.8, on both sides of it, a tight group, exact copies, and texts of few words."""
    monkeypatch.setattr(simwide, "CROWDED", crowded)
    rng, rows = random.Random(1), []
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(edited(rng, words, 4 + k % 6))), (3 * k + 2, " ".join(edited(rng, words, 6)))]
    words = [f"g{i}" for i in range(400)]
    rows += [(1000 + i, " ".join(edited(rng, words, 3))) for i in range(60)]
    rows += [(2000, "one two"), (2001, "One  two"), (2002, ""), (2003, " "), (2004, None), (2005, "one two three"), (2006, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(tuple(r) for r in simwide.similar_components(df).select("doc_id", "component_id").collect())
    assert found == brute.similar_components(rows)
    assert sorted(r.doc_id for r in simwide.drop_similar(df).collect()) == sorted({c for _, c in found})
    assert simwide.similar_components(df.limit(0)).count() == 0


def test_near_copies_come_by_simhash_and_are_verified(spark, monkeypatch):
    """Without any band the SimHash operator's links are what is left; texts of one fingerprint that are not similar stay apart."""
    monkeypatch.setattr(simwide, "band_keys", lambda hashes: [])
    rng, rows = random.Random(3), []
    for k in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "other"]))]
    near = [k for k in range(20) if (simhash.fingerprint(rows[2 * k][1], 5) ^ simhash.fingerprint(rows[2 * k + 1][1], 5)).bit_count() <= 4]
    assert len(near) > 10
    like = ["again " * 200 + " ".join(f"{c}{i}" for i in range(20)) for c in "ab"]
    assert simhash.fingerprint(like[0], 5) == simhash.fingerprint(like[1], 5)
    rows += [(100 + i, t) for i, t in enumerate(like)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = {i for i, _ in rows} - {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert gone == {2 * k + 1 for k in near}


def test_rows_of_one_id_stay_or_go_together(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    near, other = " ".join(edited(rng, words, 2)), " ".join(f"o{i}" for i in range(60))
    rows = [(1, " ".join(words), "x"), (5, near, "x"), (5, other, "x"), (7, "alone " * 9, "b"), (7, "alone " * 9, "a"), (7, "apart", "c"), (None, near, "n"), (None, near, "n")]
    kept = simwide.drop_similar(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[4], rows[5], rows[6], rows[7]], key=str)


def test_blocks_find_every_similar_pair(monkeypatch):
    monkeypatch.setattr(simwide, "COLUMNS", 64)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    group = [np.unique(np.where(rng.random(300) < e, rng.integers(0, 1 << 60, 300).astype(np.uint64), base)) for e in rng.choice([0.02, 0.06, 0.1, 0.3], 40)]
    labels, side = rng.integers(0, 5, 40), rng.random(40) < 0.5
    near = lambda i, j: len(np.intersect1d(group[i], group[j])) / len(np.union1d(group[i], group[j])) >= 0.8
    want = [(i, j) for i in range(40) for j in range(i + 1, 40) if labels[i] != labels[j] and near(i, j)]
    assert list(zip(*(x.tolist() for x in simwide.similar_in(group, labels, np.zeros(40, bool), 0.8)))) == want and want
    assert list(zip(*(x.tolist() for x in simwide.similar_in(group, labels, side, 0.8)))) == [(i, j) for i, j in want if side[i] != side[j]]


def test_texts_with_secrets_keep_their_language(spark):
    """Digits and hex cost far more than 8 bits a byte, but the words around them are of a learned language. Both texts are held out."""
    words = "kala muna sito reva".split()
    data = [(i, " ".join(words[(i + k) % 4] for k in range(30)), "aa") for i in range(80)]
    data += [(500, 'token = "2abc9d17e0f345b86a2d91c7" kala muna', "aa"), (502, "+49 170 5550 1234 8872 sito", "aa"), (510, "12 34 56", "aa"), (503, None, "aa")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.keep_identified(df).collect()) == [*range(80), 500, 502]


def test_random_keys_of_one_case_and_long_keys_with_hex(spark):
    """Base-36 and base-32 keys are masked, with or without a prefix; a key that holds a run of hex is masked as a whole; slugs and allowed strings stay."""
    texts = [
        "key q7w2zk9x4mv8t1rj6hy3pl5n end", "key JBSWY3DPEHPK3PXPQ5ZT6KMN2VXA end", "key tok_q7w2zk9x4mv8t1rj6hy3pl5n end",
        "key Zx81kQp0LmN4vB7tR2yWdeadbeef01234567Kp9QzT4x end", "see chapter-12-of-the-long-story-about-rivers end", "see example_q7w2zk9x4mv8t1rj6hy3pl5n end",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    masked = [r.text for r in secrets.mask_secrets(df).orderBy("doc_id").collect()]
    assert masked == ["key [SECRET] end", "key [SECRET] end", "key tok_[SECRET] end", "key [SECRET] end", texts[4], texts[5]]


def test_all_stay_where_nothing_is_learned(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, "aa"), (3, "1 2", None)], "doc_id long, text string, lang string")
    assert langid.keep_identified(df).count() == 3


def test_copies_hold_one_place_of_the_sample(spark):
    df = spark.createDataFrame([(t, "aa") for t in ("aaaa", "bbbb", "cccc") for _ in range(5)], "text string, lang string")
    grams, *_ = langid.learn(df, sample_docs=2).trees[0].levels[0]
    assert len(set(grams.tolist()) - {ord(" ")}) == 2


def test_the_whole_pipeline_stage_by_stage(spark):
    """Each stage's rows on a small table against plain versions of what it does to its own input."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages, at = dict(corpus_pipeline.STAGES), [docs]
    for name in [n for n, _ in corpus_pipeline.STAGES][:-1]:
        out = stages[name](spark, at[-1], "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        at.append(corpus_pipeline.materialize(out, name))
    tables = [{r.doc_id: r.asDict() for r in t.collect()} for t in at]
    raw, known, apart, cut, masked = tables
    assert set(known) == {i for i, r in raw.items() if any(map(str.isalpha, r["text"] or ""))} and all(known[i] == raw[i] for i in known)
    classes = brute.similar_components([(i, r["text"]) for i, r in known.items()])
    assert set(apart) == {c for _, c in classes} and all(apart[i] == known[i] for i in apart)
    want = {i: (n, gone, sha) for i, n, gone, sha in brute.substring_dedup(sorted((i, r["text"]) for i, r in apart.items()))}
    assert set(cut) == {i for i, (n, gone, _) in want.items() if not n or gone < n}
    for i, r in cut.items():
        text = " ".join(brute.words(r["text"])) if want[i][1] else r["text"]
        assert brute.hashlib.sha256(" ".join(brute.words(r["text"])).encode()).hexdigest() == want[i][2] and r["text"] == text and r["n_chars"] == len(text)
    assert set(masked) == set(cut)
    for i, r in masked.items():
        spans = brute.secrets(cut[i]["text"])
        assert sum(spans[:3]) == 0 or "[SECRET]" in r["text"]
        assert sum(brute.secrets(r["text"])[:3]) == 0 and r["n_chars"] == len(r["text"])
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()]
    brute.check_packing([(i, r["text"]) for i, r in masked.items()], pieces, lambda t: lib.encode(t, add_special_tokens=False).ids)
