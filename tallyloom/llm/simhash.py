"""SimHash near-dedup by pigeonhole blocks.

Fingerprints are split into `distance + extra` blocks; two within `distance` bits agree on at least `extra` whole
blocks, so each fingerprint is filed once under every choice of `extra` blocks, and only those that share a file
entry are compared. With 4 bits and 6 blocks that is 15 entries of about 21 bits each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import ids_and_text, materialize

#: Largest file entry that one task compares; larger ones go through half-way points (see _crowded_links).
CROWDED = 8192
#: Shingles whose bits are summed at a time, and bytes of a text from which it is tidied without a word list.
BLOCK, LONG = 1 << 15, 1 << 22


def _tidy(text: str) -> bytes:
    data = text.encode("utf-8", "replace").lower()  # bytes.lower changes A-Z only
    if len(data) < LONG:
        return b" ".join(data.split())  # bytes.split takes the six ASCII white-space characters
    spaces = bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))
    a = np.frombuffer(data.translate(spaces), np.uint8)
    keep = (a != 32) | np.concatenate(([False], a[:-1] != 32))
    return a[keep].tobytes().strip(b" ")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the shingles of `width` words; 0 for null and texts without a word."""
    data = _tidy(text) if text else b""
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    n = max(1, len(starts) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(ends)) - 1 :]
    total, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, BLOCK):
        some = [h(data[a:b], seed) for a, b in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())]
        total += np.unpackbits(np.array(some, ">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint, unsigned, of shingles whose hashes are at hand, repeats included; 0 for none."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        total += np.unpackbits(hashes[k : k + BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, one row for each row of docs."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def _entries(fp: Column, distance: int, extra: int) -> Column:
    """One long for each choice of blocks: its number and the bits of its blocks."""
    blocks = distance + extra
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(blocks), extra)):
        value = F.lit(number).cast("long")
        for b in chosen:
            bits = cuts[b + 1] - cuts[b]
            value = F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(fp, cuts[b]).bitwiseAND(F.lit((1 << bits) - 1)))
        out.append(value)
    return F.array(*out)


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected at `distance` bits, one fewer than members at most in each cluster."""
    left, frm, to = np.arange(len(fps)), [], []
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= distance
            if near.any():
                hit = left[near]
                frm.append(np.full(len(hit), x))
                to.append(hit)
                stack.extend(hit.tolist())
                left = left[~near]
    return (np.concatenate(frm), np.concatenate(to)) if frm else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _run_links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal keys."""
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes, frm, to = np.diff(at), [], []
    for size in (2, 3, 4):  # nearly all runs are this short: compare them all at once
        first = at[:-1][sizes == size]
        for i, j in combinations(range(size), 2):
            near = np.bitwise_count(fp[first + i] ^ fp[first + j]) <= distance
            frm.append(first[near] + i)
            to.append(first[near] + j)
    for a, b in zip(at[:-1][sizes > 4].tolist(), at[1:][sizes > 4].tolist()):
        i, j = forest(fp[a:b], distance)
        frm.append(a + i)
        to.append(a + j)
    return np.concatenate(frm), np.concatenate(to)


def _block_links(filed: DataFrame, distance: int) -> DataFrame:
    """Links among rows that share an entry; an entry has CROWDED rows at most."""

    def run(batches):
        held: list[np.ndarray] = []

        def links(rows):
            i, j = _run_links(rows[0], rows[1].view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(rows[2][i]), pa.array(rows[2][j])], names=["u", "v"])

        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else None
            if rows is None:
                continue
            rows = np.concatenate([*held, rows], axis=1)
            ends = np.flatnonzero(rows[0, 1:] != rows[0, :-1])
            if not len(ends):
                held = [rows]
                continue
            held = [rows[:, ends[-1] + 1 :]]  # the last entry may go on in the next batch
            yield links(rows[:, : ends[-1] + 1])
        if held:
            yield links(held[0])

    return filed.repartition("key").sortWithinPartitions("key").select("key", "fp", "rep").mapInArrow(run, "u long, v long")


def _crowded_links(crowd: DataFrame, distance: int) -> DataFrame:
    """Exact links of fingerprints from crowded entries, in proportion to their number.

    Two fingerprints within `distance` bits have a half-way point within half of it, rounded up, from both; each files
    itself under all points that near. A point has boundedly many fingerprints around it, and those are linked
    to the least of them where they are within `distance` of each other (always so for an even distance).
    """
    half = distance // 2 if distance % 2 == 0 else distance // 2 + 1
    masks = [0] + [sum(1 << b for b in bits) for r in range(1, half + 1) for bits in combinations(range(64), r)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    points = crowd.select("fp", "rep", F.explode(F.transform(F.lit(masks), lambda m: m.bitwiseXOR(F.col("fp")))).alias("point"))
    near = points.groupBy("point").agg(F.collect_list(F.struct("fp", "rep")).alias("all")).where("size(all) > 1")
    pairs = near.select(F.explode("all").alias("a"), F.array_min("all").alias("b")) if distance % 2 == 0 else near.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    return pairs.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance).where("a.rep <> b.rep").select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v")).distinct()


def links(reps: DataFrame, distance: int = 4, extra: int = 2) -> DataFrame:
    """(u, v): rep values that connect the rows of reps(fp, rep), fp distinct, within `distance` bits."""
    filed = reps.where("rep is not null").select("fp", "rep", F.explode(_entries(F.col("fp"), distance, extra)).alias("key"))
    crowded = materialize(filed.groupBy("key").count().where(F.col("count") > CROWDED).select("key"), "crowded")
    if crowded.isEmpty():
        return _block_links(filed, distance)
    crowd = filed.join(crowded, "key", "left_semi").select("fp", "rep").distinct()
    return _block_links(filed.join(crowded, "key", "left_anti"), distance).union(_crowded_links(crowd, distance))


def simhash_components(docs: DataFrame, width: int = 4, distance: int = 4, seed: int = 42, extra: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, fp (signed long), component_id (smallest doc_id reachable by links).

    Texts that are null, empty or without a word have fingerprint 0 and link like any other; a null doc_id takes no
    part in links and gets the component of its fingerprint's other rows, or null; rows that repeat a doc_id each
    have a row. An empty table gives an empty table; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, width, seed), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = components(links(reps, distance, extra))
    named = reps.join(classes, reps.rep == classes.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
