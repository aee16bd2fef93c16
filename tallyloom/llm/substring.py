"""Substring dedup by suffix automata of reference shards.

A window is a run of LENGTH words. Of each window the k-gram with the least hash is its anchor, so equal windows have equal
anchors at equal places. Anchors of two documents and more lead to the only passages that can repeat. Equal passages of an anchor are merged by a 128-bit digest of their bytes (BLAKE2b,
for which no two texts of one digest are known), and the shard of an anchor holds one passage of each wording. These stream in document order against the automaton of the passages before them, and a
window repeats where the matching statistics reach LENGTH. An anchor with more than CROWDED wordings is no shard: its windows are told apart one by one, by digests of the same kind. The sums
that find anchors need not be free of collisions: equal windows always have equal anchors, and what shares one by chance is told apart by its words.

A shard automaton is not broadcast: automata of the whole corpus have no size bound, and streaming all documents past all shards costs the square of the
corpus. Shards and passages meet by their anchor instead. A bounded reference can be broadcast: see strip_reference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import SuffixAutomaton
from .runtime import discard, ids_and_text, materialize, release

LENGTH, GRAM = 20, 6
#: Most wordings of one anchor in a shard; beyond, its windows are dealt out one by one.
CROWDED = 1024
#: Rows of a batch that a task gives back.
ROWS = 4096
#: Words of a broadcast automaton, and windows of a text that are looked through at a time.
SHARD_WORDS, BLOCK = 200_000, 1 << 22

_ODD = np.uint64(0x9E3779B97F4A7C15)
_GRAM_BASE = np.uint64(0xA0761D6478BD642F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _ODD
    return x ^ x >> np.uint64(29)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class _Rolling:
    """Sums of value * base ** place, modulo 2 ** 64, of all runs of values: equal for equal runs, and sometimes for others."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, _powers(base, 1 << 16), _powers(_inverse(base), 1 << 16)

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, 2 * n), _powers(_inverse(self.base), 2 * n)
        return self.up, self.down

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.tables(len(values) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
        return _mixed((total[ends] - total[starts]) * down[starts])


_GRAMS = _Rolling(_GRAM_BASE)


def split_words(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.split takes exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "replace").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def digest_of(data: bytes | memoryview) -> bytes:
    """128 bits that stand for a passage or a window."""
    return hashlib.blake2b(data, digest_size=16).digest()


def windows_and_anchors(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the place and the hash of its anchor (the leftmost of the least k-gram hashes)."""
    n = len(h) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(h) - gram + 1)
    g = _GRAMS.runs(h, at, at + gram)
    place = np.concatenate(
        [i + np.lib.stride_tricks.sliding_window_view(g[i : min(i + BLOCK, n) + length - gram], length - gram + 1).argmin(1) + np.arange(min(BLOCK, n - i)) for i in range(0, n, BLOCK)]
    )
    return place, g[place]


class _Words:
    """A text's words joined by one space, and where they begin."""

    def __init__(self, text: str | None):
        self.words = split_words(text)
        self.data = memoryview(b" ".join(self.words))
        self.starts = np.cumsum([0, *(len(w) + 1 for w in self.words)])

    def part(self, at: int, n: int) -> memoryview:
        """Words at ... at + n."""
        return self.data[self.starts[at] : self.starts[at + n] - 1]


SEEN = pa.schema([("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int32()), ("at", pa.int32()), ("windows", pa.int32())])
SPREAD = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])


def _places(words: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of the stretches of windows that share an anchor place."""
    place, a = windows_and_anchors(word_hashes(words), length, gram)
    if not len(a):
        return a, place, place
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
    return a[cut[:-1]], cut[:-1], np.diff(cut)


def anchor_spread(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(anchor, doc_id) of rows of doc_id, text: the anchors of each text, once each. One row more with a null anchor says that a text has an anchor at two places."""

    def run(batches):
        release()
        for b in batches:
            found, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            again: list[int] = []
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                if doc_id is None:
                    continue
                anchor = _places(split_words(text), length, gram)[0]
                once = np.unique(anchor)
                found.append(once.view(np.int64))
                ids.append(np.full(len(once), doc_id, np.int64))
                if len(once) < len(anchor):
                    again.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))], schema=SPREAD)
            if again:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(again), pa.int64()), pa.array(again, pa.int64())], schema=SPREAD)

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(anchor, d1, d2, doc_id, h, at, windows) of rows of doc_id, text, h: the passages around anchors that their windows cover, once for each row and wording.

    d1 and d2 are the passage's digest. Rows without doc_id and texts below `length` words have none.
    """

    def run(batches):
        release()
        for b in batches:
            parts = []
            for doc_id, text, h in zip(*(c.to_pylist() for c in b.columns)):
                w = _Words(text)
                if doc_id is None or len(w.words) < length:
                    continue
                anchor, first, windows = _places(w.words, length, gram)
                starts, ends = w.starts[first].tolist(), (w.starts[first + windows + (length - 1)] - 1).tolist()
                digests = [digest_of(w.data[x:y]) for x, y in zip(starts, ends)]
                once = sorted({(k, d): i for i, (k, d) in reversed(list(enumerate(zip(anchor.tolist(), digests))))}.values())
                d = np.frombuffer(b"".join(digests[i] for i in once), "<i8").reshape(-1, 2)
                n = len(once)
                parts.append([anchor[once].view(np.int64), d[:, 0], d[:, 1], np.full(n, doc_id, np.int64), np.full(n, h, np.int32), first[once].astype(np.int32), windows[once].astype(np.int32)])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=SEEN)

    return docs.select("doc_id", "text", "h").mapInArrow(run, "anchor long, d1 long, d2 long, doc_id long, h int, at int, windows int")


PASSAGE = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int32()), ("at", pa.int32()), ("passage", pa.string())])
WINDOW = pa.schema([("window", pa.binary()), ("doc_id", pa.int64()), ("h", pa.int32()), ("at", pa.int32())])


#: Columns of a row with its text and places: own names, as other columns of the documents ride along.
PLACED = ("__id", "__h", "text", "__places")


def passages(wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, doc_id, h, at, passage): the words of the passages listed in `places`, those of the row's own h."""

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, h, text, places in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in PLACED)):
                w = _Words(text)
                for p in places:
                    if p["h"] == h:
                        rows.append((p["anchor"], doc_id, h, p["at"], str(w.part(p["at"], p["windows"] + length - 1), "utf-8")))
                if len(rows) >= ROWS:
                    yield _batch(rows, PASSAGE)
                    rows = []
            if rows:
                yield _batch(rows, PASSAGE)

    return wanted.mapInArrow(run, "anchor long, doc_id long, h int, at int, passage string")


def windows_of(wanted: DataFrame, length: int) -> DataFrame:
    """(window, doc_id, h, at): 128 bits of each window of the listed passages."""

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, h, text, places in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in PLACED)):
                w = _Words(text)
                for at in sorted({p["at"] + k for p in places if p["h"] == h for k in range(p["windows"])}):
                    rows.append((digest_of(w.part(at, length)), doc_id, h, at))
                if len(rows) >= ROWS:
                    yield _batch(rows, WINDOW)
                    rows = []
            if rows:
                yield _batch(rows, WINDOW)

    return wanted.mapInArrow(run, "window binary, doc_id long, h int, at int")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def repeats_of(group: list[tuple[int, int, int, str]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, h, first window, windows) of the passages of one anchor that occur in smaller doc_ids.

    group has (doc_id, h, at, passage) in order. Passages of a document join the automaton once the next one comes.
    """
    known: set[str] = set()
    automaton, waiting, own, current = None, [], [], None
    for doc_id, h, at, passage in group:
        if doc_id != current:
            for p in own:
                if p not in known:
                    known.add(p)
                    waiting.append(p)
            own, current = [], doc_id
        own.append(passage)
        if passage in known:
            yield doc_id, h, at, passage.count(" ") + 2 - length
            continue
        if not known:
            continue
        automaton = automaton or SuffixAutomaton()
        for p in waiting:
            automaton.add(p.split(" "))
        waiting.clear()
        start = None
        for end, size in enumerate(automaton.matches(passage.split(" "))):
            hit = size >= length
            if hit and start is None:
                start = end - length + 1
            elif not hit and start is not None:
                yield doc_id, h, at + start, end - length + 1 - start
                start = None
        if start is not None:
            yield doc_id, h, at + start, end - length + 2 - start


REPEAT = pa.schema([("doc_id", pa.int64()), ("h", pa.int32()), ("at", pa.int32()), ("windows", pa.int32())])


def compare(found: DataFrame, length: int) -> DataFrame:
    """(doc_id, h, at, windows): windows of found(anchor, doc_id, h, at, passage) that occur in smaller doc_ids, one shard for each anchor."""

    def run(batches):
        key, group = None, []
        for b in batches:
            rows = []
            for anchor, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if anchor != key:
                    rows += repeats_of(group, length) if len(group) > 1 else ()
                    key, group = anchor, []
                group.append(rest)
            if rows:
                yield _batch(rows, REPEAT)
        if len(group) > 1 and (rows := list(repeats_of(group, length))):
            yield _batch(rows, REPEAT)

    ordered = found.select("anchor", "doc_id", "h", "at", "passage").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "at")
    return ordered.mapInArrow(run, "doc_id long, h int, at int, windows int")


def sorted_out(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the passages of shared anchors: copies (doc_id, h, at, windows), which have a smaller doc_id of the same wording, and the first passages of anchors with several wordings.

    Equal passages of an anchor are merged before anything is gathered: those after the first are repeats as a whole.
    """
    first = seen.groupBy("anchor", "d1", "d2").agg(F.min("doc_id").alias("first"))
    first = first.join(first.groupBy("anchor").agg(F.count("*").alias("n")), "anchor")
    marked = materialize(seen.join(first, ["anchor", "d1", "d2"]).where("doc_id > first or n > 1").select("doc_id", "h", "at", "windows", F.when(F.col("doc_id") == F.col("first"), F.col("anchor")).alias("anchor"), "n"), "marked")
    return marked.where("anchor is null").select("doc_id", "h", "at", "windows"), marked.where("anchor is not null")


def repeats(copies: DataFrame, listed: DataFrame, placed: DataFrame, length: int) -> DataFrame:
    """(doc_id, h, at, windows): all windows of rows that occur in smaller doc_ids; placed has the texts. See sorted_out().

    Where an anchor has several wordings, the first passage of each goes into the anchor's shard. A shard that would hold more than CROWDED is dealt out by single windows, which
    are merged in the same way as passages.
    """
    listed = listed.select("doc_id", "h", "anchor", "at", "windows", (F.col("n") > CROWDED).alias("split"))

    def with_text(some: DataFrame) -> DataFrame:
        places = some.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("h", "anchor", "at", "windows")).alias("__places"))
        return placed.join(places, "__id")  # with all columns, so that the same shuffle of texts serves every join

    compared = compare(passages(with_text(listed.where("not split")), length), length)
    single = windows_of(with_text(listed.where("split")), length)
    earliest = single.groupBy("window").agg(F.min("doc_id").alias("first"))
    split = single.join(earliest, "window").where("doc_id > first").select("doc_id", "h", "at", F.lit(1).alias("windows"))
    return copies.union(compared).union(split)


def _own_repeats(words: list[bytes], length: int, gone: np.ndarray) -> None:
    """Mark words of windows that start earlier in the same text."""
    h = word_hashes(words)
    at = np.arange(len(h) - length + 1)
    w = _GRAMS.runs(h, at, at + length)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return
    maybe = np.zeros(len(w), bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    seen: set[bytes] = set()
    for i in np.flatnonzero(maybe).tolist():
        digest = digest_of(b" ".join(words[i : i + length]))
        if digest in seen:
            gone[i : i + length] = True
        seen.add(digest)


def cut(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with __id, __n_words, __n_removed and __kept (words that stay, joined by one space); text as string. See dedup()."""
    spark = docs.sparkSession
    rows = docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in docs.columns), F.col("doc_id").cast("long").alias("__id"))
    ids_repeat = not rows.where("__id is not null").groupBy("__id").count().where("count > 1").isEmpty()
    rows = rows.withColumn("__h", F.hash("text") if ids_repeat else F.lit(0))
    named = rows.select(F.col("__id").alias("doc_id"), "text", F.col("__h").alias("h"))
    spread = anchor_spread(named, length, gram).groupBy("anchor", F.when(F.col("anchor").isNull(), F.col("doc_id")).alias("twice")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    spread = materialize(spread.where("anchor is null or lo < hi").select("anchor", "twice"), "spread")
    seen = materialize(anchors(named, length, gram).join(spread.where("anchor is not null").select("anchor"), "anchor"), "shared")
    copies, listed = sorted_out(seen)
    discard(seen)
    twice = spread.where("anchor is null").select(F.col("twice").alias("__id"), F.lit(True).alias("__twice"))
    placed = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "__id")
    spans = repeats(copies, listed, placed, length).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("h", "at", "windows")).alias("__spans"))
    added = T.StructType().add("__n_words", "long").add("__n_removed", "long").add("__kept", "string")

    def run(batches):
        for b in batches:
            out, kept_columns = [], [b.column(i) for i in range(b.num_columns - 3)]
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()
            for doc_id, text, h, some, own in zip(*map(column, ("__id", "text", "__h", "__spans", "__twice"))):
                words = split_words(text)
                gone = np.zeros(len(words), bool)
                for s in some or ():
                    if s["h"] == h:
                        gone[s["at"] : s["at"] + s["windows"] + length - 1] = True
                if len(words) > length and (own or doc_id is None):
                    _own_repeats(words, length, gone)
                n = int(gone.sum())
                kept = b" ".join(words if not n else [words[i] for i in np.flatnonzero(~gone).tolist()])
                out.append((len(words), n, kept.decode("utf-8")))
            new = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept_columns, *new], names=[*b.schema.names[:-3], *added.names])

    joined = placed.join(spans, "__id", "left").join(twice, "__id", "left").select(*docs.columns, "__id", "__h", "__spans", "__twice")
    through = T.StructType([f for f in joined.schema.fields if f.name not in ("__h", "__spans", "__twice")])
    return joined.mapInArrow(run, T.StructType([*through.fields, *added.fields]))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept (words that stay, joined by one space) of every row.

    A word goes if a window of `length` words that covers it also starts earlier: in a smaller doc_id, or earlier in the same row. Windows are
    judged on the input. Null and empty texts have no words; texts below `length` words stay whole; rows that share a doc_id do not
    remove each other's words, nor does a row without doc_id take part beyond its own text. Other columns are ignored.
    """
    found = cut(docs.select("doc_id", "text"), length, gram)
    return found.select(F.col("__id").alias("doc_id"), "text", *(F.col(f"__{c}").alias(c) for c in ("n_words", "n_removed", "kept")))


def dedup_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return dedup(docs, length, gram).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def keep_unrepeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated passages cut from text; texts that lose nothing stay as they are, others are their kept words, and a text that loses all its words goes.

    Passages are judged as dedup() does, on the input. Null, empty and short texts stay, as do other columns whatever their names (but for two leading
    underscores); repeated rows are cut alike, each by itself where it has no doc_id; an empty table stays empty.
    """
    found = cut(docs, length, gram).where("__n_removed = 0 or __n_removed < __n_words")
    return found.select(*(F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col(c)).alias(c) if c == "text" else F.col(c) for c in docs.columns))


def strip_reference(docs: DataFrame, reference: list[str], length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept: words in runs of `length` words that a bounded reference holds are removed.

    The reference, a list that the caller holds already, becomes automata of SHARD_WORDS words at most (a longer text is a shard of its own), which are
    broadcast; each document streams past every one.
    """
    shards, size = [[]], 0
    for text in reference:
        words = [w.decode("utf-8") for w in split_words(text)]
        if size + len(words) > SHARD_WORDS and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(words)
        size += len(words)
    shared = [docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(s)) for s in shards]

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                words = [w.decode("utf-8") for w in split_words(text)]
                gone = np.zeros(len(words), bool)
                for s in shared:
                    for end, n in enumerate(s.value.matches(words)):
                        if n >= length:
                            gone[end - n + 1 : end + 1] = True
                out.append((len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone.tolist()) if not g)))
            n_words, n_removed, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
