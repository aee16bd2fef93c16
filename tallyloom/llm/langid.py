"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes with the counts of the bytes that follow. A byte is coded in its
longest known context; where it was never seen there, an escape is coded and the next shorter context is tried, down to even odds for all
bytes (method C: a context with n counts of t different bytes gives byte x c(x)/(n+t) and the escape t/(n+t)). Texts are in small letters, with
single spaces between words and one before the first. Statistics are frozen once learned, so the code length of a text is the sum over its bytes, each a function
of itself and the ORDER bytes before it: these lengths are looked up for all places of a block at once, in whole units of 2 ** -UNIT bits, so that
sums do not depend on their order. The shortest total names the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import release
from .textio import LONG, blocks

#: Longest context in bytes; context and byte fit a 64-bit key up to 7.
ORDER = 4
#: Bound of the sample that statistics are learned from: documents of each language, characters of each, and languages (those of most texts).
SAMPLE_DOCS, SAMPLE_CHARS, MAX_LANGUAGES = 100, 20_000, 64
#: Code lengths are held in units of 2 ** -UNIT bits.
UNIT = 32
#: Places scored at a time, and bytes of the table of remembered code lengths.
BLOCK, TABLE_BYTES = 1 << 18, 16 << 20

UNDETERMINED = "und"
SPACED = re.compile(r"\S+")
LETTER = re.compile(r"[^\W\d_]")


def normal_bytes(text: str) -> Iterator[bytes]:
    """The text as it is coded: small letters in UTF-8, a space before each word; in blocks that can be joined."""
    low = text.lower()
    for some in (low.split(),) if len(text) < LONG else blocks(SPACED, low):
        if some:
            yield (" " + " ".join(some)).encode("utf-8", "replace")


def keys_of(data: np.ndarray, width: int) -> np.ndarray:
    """The last `width` bytes at each place of uint8 data from width - 1 on, as one number."""
    n = len(data) - width + 1
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        key = key << np.uint64(8) | data[k : k + n]
    return key


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and which of them are in it."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return place, table[place] == keys


class ContextTree:
    """Counts of following bytes by context for each context length, and exact code lengths under them."""

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order, self.levels = order, []
        pad = b" " * order
        data = np.frombuffer(b"".join(pad + b"".join(normal_bytes(t)) for t in texts), np.uint8)
        counted = np.ones(len(data), bool)  # not the padding, which only parts the texts
        at = 0
        for t in texts:
            counted[at : at + order] = False
            at += order + sum(map(len, normal_bytes(t)))
        for k in range(order + 1):
            grams, counts = np.unique(keys_of(data, k + 1)[counted[k:]], return_counts=True)
            contexts, first = np.unique(grams >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else counts
            kinds = np.diff(np.append(first, len(grams)))
            self.levels.append((grams, counts, contexts, total, kinds))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of grams of order + 1 bytes, in units."""
        bits, todo = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(self.order, -1, -1):
            known, counts, contexts, total, kinds = self.levels[k]
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            now = grams[todo] & mask
            place, is_context = _at(contexts, now >> np.uint64(8))
            at, hit = _at(known, now)
            if len(contexts):
                n, t = total[place], kinds[place]
                bits[todo[hit]] += np.log2((n[hit] + t[hit]) / counts[at[hit]])
                escape = is_context & ~hit
                bits[todo[escape]] += np.log2((n[escape] + t[escape]) / t[escape])
            todo = todo[~hit]
        bits[todo] += 8.0
        return np.round(bits * (1 << UNIT)).astype(np.int64)


class LanguageModel:
    """A context tree for each language, and a table of bounded size with the code lengths of grams seen lately."""

    def __init__(self, trees: dict[str, ContextTree]):
        self.languages = sorted(trees)
        self.trees = [trees[x] for x in self.languages]
        self.order = max((t.order for t in self.trees), default=ORDER)
        self.forget()

    def forget(self) -> None:
        self.keys, self.values = None, None

    def __getstate__(self):
        return self.__dict__ | {"keys": None, "values": None}

    def _costs(self, grams: np.ndarray) -> np.ndarray:
        """Units for each gram (rows) and language (columns)."""
        if self.keys is None:
            slots = 1 << (TABLE_BYTES // (8 * len(self.trees))).bit_length() - 1
            self.keys, self.values = np.full(slots, ~np.uint64(0)), np.zeros((slots, len(self.trees)), np.int64)
        slot = (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != grams)
        if not len(new):
            return self.values[slot]
        out = self.values[slot]
        fresh, back = np.unique(grams[new], return_inverse=True)
        costs = np.stack([t.bits(fresh) for t in self.trees], axis=1)
        out[new] = costs[back]
        to = np.empty(len(fresh), np.int64)
        to[back] = slot[new]
        self.keys[to], self.values[to] = fresh, costs
        kept = self.keys[to] == fresh  # of two grams for a slot, the last one stays, whole
        self.values[to[kept]] = costs[kept]
        return out

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units of the whole texts under each language (rows: texts), and bytes coded."""
        total, size = np.zeros((len(texts), len(self.trees)), np.int64), np.zeros(len(texts), np.int64)
        pad, waiting, held = b" " * self.order, [], 0

        def score() -> None:
            data = np.frombuffer(b"".join(d for _, d, _ in waiting), np.uint8)
            lengths = np.array([len(d) for _, d, _ in waiting])
            ends = np.cumsum(lengths)
            skip = np.concatenate([np.arange(e - n, e - n + s) for e, n, (_, _, s) in zip(ends.tolist(), lengths.tolist(), waiting)])
            grams = np.concatenate((np.zeros(self.order, np.uint64), keys_of(data, self.order + 1)))
            counted = np.ones(len(data), bool)
            counted[skip] = False
            costs = self._costs(grams[counted])
            sizes = np.array([len(d) - s for _, d, s in waiting])
            np.add.at(total, [i for i, _, _ in waiting], np.add.reduceat(costs, np.cumsum(sizes) - sizes, axis=0))
            np.add.at(size, [i for i, _, _ in waiting], sizes)
            waiting.clear()

        for i, text in enumerate(texts):
            before = pad
            for data in normal_bytes(text):
                for at in range(0, len(data), BLOCK):
                    some = data[at : at + BLOCK]
                    waiting.append((i, before + some, len(before)))
                    held += len(some)
                    before = (before + some)[-self.order :] if self.order else b""
                    if held >= BLOCK:
                        score()
                        held = 0
        if waiting:
            score()
        return total, size

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, float]]:
        """For each text its language, that one's probability among the learned ones, and bits for each byte."""
        can = [bool(t and self.trees and LETTER.search(t)) for t in texts]
        units, size = self.units([t if ok else "" for t, ok in zip(texts, can)]) if any(can) else (None, None)
        for i, ok in enumerate(can):
            if not ok:
                yield UNDETERMINED, 0.0, 0.0
                continue
            bits = units[i] / float(1 << UNIT)
            best = int(units[i].argmin())
            score = float(1.0 / np.exp2(np.maximum(-1000.0, bits[best] - bits)).sum())
            yield self.languages[best], score, float(bits[best] / size[i])


def learn(
    labelled: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, max_languages: int = MAX_LANGUAGES
) -> LanguageModel:
    """Trees from columns text and lang: of each language the `sample_docs` distinct texts that hash lowest.

    Rows with null text or lang and texts beyond `sample_chars` take no part in learning; of more than `max_languages` values of lang, those of
    most rows are learned (ties by value). The sample is chosen by hashes alone; its texts, a bounded number, are then counted on the driver. An empty
    table gives a model without languages.
    """
    rows = labelled.where("text is not null and lang is not null").where(F.length("text") <= sample_chars)
    rows = rows.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"))
    often = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).select("lang")
    low = rows.join(F.broadcast(often), "lang", "left_semi").select("lang", "h").distinct()
    low = low.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("n") <= sample_docs)
    low = low.select("lang", "h")  # bounded: sample_docs rows for each of max_languages
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in rows.join(F.broadcast(low), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).collect():
        texts.setdefault(r.lang, []).append((r.h, r.text))
    return LanguageModel({lang: ContextTree([t for _, t in sorted(some)], order) for lang, some in texts.items()})


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """docs with columns of these names: language, score (0 to 1) and bits per byte; columns that have them already are replaced.

    Null texts and texts without a letter are `und` with score 0, as is everything when nothing was learned. Only the text counts; equal texts
    have equal results; ties go to the first language by name. Long texts are scored in blocks; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    docs = docs.drop(*names)
    at = docs.columns.index(text)

    def run(batches):
        release()
        m = shared.value
        for b in batches:
            lang, score, bits = zip(*m.predict(b.column(at).to_pylist())) if b.num_rows else ((), (), ())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])
        m.forget()

    added = T.StructType().add(names[0], "string").add(names[1], "double").add(names[2], "double")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def held_out(doc_id: str = "doc_id"):
    """True for a quarter of documents: CRC-32 of the id as text leaves 2 when divided by 4. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row; learned from labelled rows that are not held out. Other columns are ignored."""
    docs = docs.select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those that op6 calls undetermined: null, empty, without a letter. A secret's digits cost many bits and are no reason to go.

    Every other row stays as it is, repeated rows and columns named like op6's own included; an empty table stays empty. Where nothing could be learned (no labels, or every labelled
    text beyond the sample's length), no document can be told apart and all stay.
    """
    model = learn(docs.select("doc_id", "text", "lang").where(~held_out()))
    if not model.languages:
        return docs
    own = ("__lang_pred", "__score", "__bits")
    return predict(docs, model, names=own).where(F.col(own[0]) != UNDETERMINED).select(*docs.columns)
