"""Periodic runs of words by harmonic grid probing.

A stretch of period p and 4 p words and more has w[i] = w[i + p] at 3 p places in a row, three of which are multiples of p. So for each p only the grid 0, p, 2 p, ... is
probed, n/p places and n ln n in all; where three probes in a row hold, the stretch is extended to both sides by comparing growing blocks. Probes within a stretch that is known
already are skipped: those of the same p, and those inside a run whose period divides p, as all of that run's repetitions of p have the smaller period.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import ids_and_text, release
from .substring import split_words

#: A run has LEAST words and TIMES periods at least.
LEAST, TIMES = 6, 4
#: Probes that are made at a time, and words that are compared first when a stretch is extended.
PROBES, FIRST = 1 << 18, 32


def word_codes(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _survivors(w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods) of grid places from which three probes in a row hold, for periods low ... high - 1, in the order of period and place."""
    p = np.arange(low, high)
    count = (len(w) - 1) // p
    period = np.repeat(p, count)
    place = (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * period
    same = w[place] == w[place + period]
    three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:] & (period[:-2] == period[2:]))
    return place[three], period[three]


def _extended(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """(start, end) of the longest stretch of period p around words i and i + p, which are equal."""
    start, step = i, FIRST
    while start:
        low = max(0, start - step)
        other = np.flatnonzero(w[low:start] != w[low + p : start + p])
        if len(other):
            start = low + int(other[-1]) + 1
            break
        start, step = low, 2 * step
    end, step, last = i + 1, FIRST, len(w) - p
    while end < last:
        high = min(last, end + step)
        other = np.flatnonzero(w[end:high] != w[end + p : high + p])
        if len(other):
            end += int(other[0])
            break
        end, step = high, 2 * step
    return start, end + p


def runs_of(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of word numbers, by start and period. times is 4 at least.

    A run is a stretch whose smallest period is `period`, of max(least, times * period) words and more, that no neighbouring word extends.
    """
    if times < 4:
        raise ValueError("three probes in a row need four periods")
    n, found, known, by_period = len(w), [], set(), {}
    most, low = n // times if n >= least else 0, 1
    probes = np.cumsum((n - 1) // np.arange(1, most + 1))
    while low <= most:
        high = max(low + 1, 1 + int(np.searchsorted(probes, (probes[low - 2] if low > 1 else 0) + PROBES, "right")))
        places, periods = _survivors(w, low, high)
        at = 0
        while at < len(places):
            p = int(periods[at])
            stop = int(np.searchsorted(periods, p, "right"))
            some, inside = places[at:stop], [runs for q, runs in by_period.items() if p % q == 0]
            k = 0
            while k < len(some):
                i, until = int(some[k]), -1
                for runs in inside:
                    j = bisect_right(runs, (i, n)) - 1
                    if j >= 0 and i + p < runs[j][1]:
                        until = runs[j][1] - p
                if until < 0:
                    start, end = _extended(w, i, p)
                    until = end - p
                    if end - start >= max(least, times * p) and (start, end) not in known:
                        known.add((start, end))
                        found.append((start, end - start, p))
                        by_period.setdefault(p, []).append((start, end))
                k = max(k + 1, int(np.searchsorted(some, until)))
            at = stop
        low = high
    return sorted(found, key=lambda r: (r[0], r[2]))


def covered(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Words that some run holds after its first period."""
    change = np.zeros(n + 1, np.int32)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def with_loop(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """For a tenth of the doc_ids (by crc32 of their digits) the words from some place on are replaced by repetitions of the first ones there: a test of the search on real words."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * ((n - a) // p + 1))[: n - a]


RUNS = "array<struct<start:long,length:long,period:long>>"


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, loops: bool = False) -> DataFrame:
    """doc_id, runs (start, length and period, by start and period), n_words and collapsed (the words that no run repeats, joined by one space) of every row.

    Null, empty and wordless texts have no words and no runs; repeated rows each have a row; a null doc_id stays null; an empty table gives an empty table;
    other columns are ignored. A document is handled by itself, with memory in proportion to its text. With `loops` the words are those of with_loop().
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        release()
        for b in batches:
            found, sizes, texts = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = split_words(text)
                words = with_loop(words, doc_id) if loops else words
                runs = runs_of(word_codes(words), least, times)
                if runs:
                    gone = covered(runs, len(words)).tolist()
                    words, n = [w for w, g in zip(words, gone) if not g], len(words)
                else:
                    n = len(words)
                found.append([{"start": s, "length": k, "period": p} for s, k, p in runs])
                sizes.append(n)
                texts.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind), pa.array(sizes, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "runs", "n_words", "collapsed"])

    return ids_and_text(docs).mapInArrow(run, f"doc_id long, runs {RUNS}, n_words long, collapsed string")


def run_digests(docs: DataFrame, least: int = LEAST, times: int = TIMES, loops: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run, runs_sha256 and collapsed_sha256 of every row. See find_runs()."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, runs, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "runs", "collapsed"))):
                best = min(runs, key=lambda r: (-r["length"], r["start"], r["period"]), default=None)
                longest = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
                listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                rows.append((doc_id, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)], names=names)

    return find_runs(docs, least, times, loops).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
