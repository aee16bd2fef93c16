"""Near copies by SimHash, verified by the Jaccard similarity of word shingles.

First come the links of the SimHash operator: 64-bit fingerprints of the shingles that differ in few bits. At a similarity of 0.8 some 15 % of the bits differ, so these are the closest copies; for the rest, what is still apart
and shares one of 32 bands, each of six least values (MinHash) of the set of shingles, is a candidate as well: at a similarity s with probability 1 - (1 - s^6)^32, 0.99994 at 0.8.
Either kind is linked if the exact similarity of the two sets, held as 64-bit hashes of the shingles, reaches the limit; nothing is capped.
Pairs within what is already connected are not compared: after the fingerprints each set meets the least of those it shares a band with, then the least
of each band whose sets are still apart, and then all sets of a band that are still apart, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .runtime import ids_and_text, materialize, release, scratch
from .simhash import _tidy, links, of_hashes

BANDS, BAND_ROWS = 32, 6
#: Shingles whose least values are taken at a time.
BLOCK = 1 << 10
#: Sets of a band in a block, and shared shingles of two blocks that are compared at a time.
CROWDED, COLUMNS = 512, 1 << 15
_SALTS = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for k in range(BANDS * BAND_ROWS)], np.uint64)[:, None]
NODE = "struct<rep:long,fp:binary>"


def shingle_hashes(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the shingles of `width` words, repeats included; shorter texts are one shingle, texts without a word have none."""
    data = _tidy(text) if text else b""
    if not data:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    n = max(1, len(starts) - width + 1)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(data[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[min(width, len(ends)) - 1 :].tolist())), np.uint64, n)


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The hashes of the shingles, sorted and distinct."""
    return np.unique(shingle_hashes(text, width, seed))


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_SALTS), ~np.uint64(0))
    for at in range(0, len(hashes), BLOCK):
        x = hashes[at : at + BLOCK] * _SALTS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        np.minimum(least, x.min(1), out=least)
    data, step = least.tobytes(), 8 * BAND_ROWS
    return np.array([xxhash.xxh64_intdigest(data[step * i : step * (i + 1)], i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets, as bytes of their sorted hashes, have this Jaccard similarity at least."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) / max(len(x), len(y)) < similarity:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) >= similarity


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of the pairs of nodes whose sets are similar."""

    def run(batches):
        for b in batches:
            keep = pa.array([similar(x, y, similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(keep)

    side = lambda x: sets.select(F.col("fp").alias(f"fp_{x}"), F.col("hashes").alias(f"hashes_{x}"))
    both = pairs.join(side("v"), F.col("v.fp") == F.col("fp_v")).join(side("u"), F.col("u.fp") == F.col("fp_u"))
    return both.select(F.col("u.rep").alias("u"), F.col("v.rep").alias("v"), "hashes_u", "hashes_v").mapInArrow(run, "u long, v long")


def _by_fingerprint(reps: DataFrame, distance: int) -> DataFrame:
    """(u, v): sets of one SimHash with the least of them, and the least ones of two that the SimHash operator links within `distance` bits."""
    named = reps.where("rep is not null").select(F.struct("rep", "fp").cast(NODE).alias("node"), "sim")
    least = named.groupBy("sim").agg(F.min("node").alias("first"))
    same = named.join(least, "sim").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    linked = links(least.select(F.col("sim").alias("fp"), F.col("sim").alias("rep")), distance).where("u <> v").distinct()  # one fingerprint may share an entry with itself
    end = lambda x: least.select(F.col("sim").alias(x), F.col("first").alias(f"first_{x}"))
    near = linked.join(end("u"), "u").join(end("v"), "v").select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v"))
    return same.unionByName(near).distinct()


def _nearest(filed: DataFrame) -> DataFrame:
    """Each node with the least of those that it shares a band with, of those that it is apart from."""
    return filed.where("label <> first_label").groupBy(F.col("node").alias("v")).agg(F.min("first").alias("u")).select("u", "v")


def _stars(filed: DataFrame) -> DataFrame:
    """Nodes that are apart from the least of a band, with that one."""
    return filed.where("label <> first_label").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()


def similar_in(group: list[np.ndarray], labels: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of similar sets with different labels; between the two sides only, where there are two.

    Shared shingles become columns of a bit matrix, a bounded number at a time, and overlaps are counted from whole rows.
    """
    sizes = np.array([len(x) for x in group])
    _, column, df = np.unique(np.concatenate(group), return_inverse=True, return_counts=True)
    shared = np.cumsum(df > 1) - 1
    owner, keep = np.repeat(np.arange(len(group)), sizes), df[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    both = np.zeros((len(group), len(group)), np.int64)
    for at in range(0, int(shared[-1]) + 1 if len(shared) else 0, COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        bits = np.zeros((len(group), COLUMNS), bool)
        bits[owner[here], column[here] - at] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(len(group)):
            both[i] += np.bitwise_count(words & words[i]).sum(1, dtype=np.int64)
    near = both / (sizes[:, None] + sizes - both) >= similarity
    near &= labels[:, None] != labels
    if side.any() and not side.all():
        near &= side[:, None] != side
    return np.nonzero(np.triu(near, 1))


def _across(filed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): similar nodes of a band that are apart, all of them.

    A band's nodes are dealt to blocks of about CROWDED, and each two blocks meet in a task's group, so that a group is bounded whatever the band, and rows are
    nodes times blocks and not pairs.
    """
    counts = filed.groupBy("key").agg(F.ceil(F.count("*") / CROWDED).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node.rep"), F.col("blocks")).cast("int")
    rows = filed.join(counts, "key").select("key", "node", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") < F.col("other")).alias("first"), F.col("node.rep").alias("rep"), F.col("node.fp").alias("fp"), "label")

    def run(batches):
        key, group = None, []

        def links():
            if len({r[2] for r in group}) < 2:
                return
            labels, side = np.array([r[2] for r in group]), np.array([r[0] for r in group])
            u, v = similar_in([np.frombuffer(r[3], np.uint64) for r in group], labels, side, similarity)
            reps = np.array([r[1] for r in group], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(reps[u], reps[v])), pa.array(np.maximum(reps[u], reps[v]))], names=["u", "v"])

        for b in batches:
            for *k, first, rep, label, hashes in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    yield from links()
                    key, group = k, []
                group.append((first, rep, label, hashes))
        yield from links()

    dealt = rows.join(sets, "fp").select("key", "lo", "hi", "first", "rep", "label", "hashes").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def similar_classes(docs: DataFrame, reps: DataFrame, width: int, similarity: float, distance: int) -> DataFrame:
    """(node, component) of what is connected by similar candidates; reps(fp, rep, sim, bands) names a document of docs for each set."""
    spark = docs.sparkSession
    filed = reps.where("rep is not null").select(F.struct("rep", "fp").cast(NODE).alias("node"), F.explode("bands").alias("key"))
    common = filed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").drop("n")
    filed = materialize(filed.join(common, "key").select("key", "node", "first"), "bands")
    close = materialize(_by_fingerprint(reps, distance), "pairs")

    def sets_of(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(fingerprint, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "hashes"])

    ids = filed.select(F.col("node.rep").alias("doc_id")).unionByName(close.select(F.explode(F.array("u.rep", "v.rep")).alias("doc_id"))).distinct()
    named = docs.join(ids, "doc_id", "left_semi").select("text")
    sets = materialize(named.mapInArrow(sets_of, "fp binary, hashes binary").groupBy("fp").agg(F.first("hashes").alias("hashes")), "sets")
    classes, tried = spark.createDataFrame([], "node long, component long"), close
    found = materialize(_verified(close, sets, similarity), "similar")
    for choose in (_nearest, _stars, None):
        if not found.isEmpty():  # what is connected already goes on as stars, which settle at once
            classes = components(found.unionByName(classes.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        label = F.coalesce("component", "node.rep")
        named = filed.join(classes.withColumnRenamed("node", "__n"), F.col("node.rep") == F.col("__n"), "left").select("key", "node", "first", label.alias("label"))
        heads = named.where("node = first").select("key", F.col("label").alias("first_label"))
        apart = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        now = materialize(named.join(apart, "key").join(heads, "key"), "apart")
        if choose is None:
            last = materialize(_across(now, sets, similarity), "similar")
            return classes if last.isEmpty() else components(last.unionByName(classes.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        pairs = materialize(choose(now).join(tried, ["u", "v"], "left_anti"), "pairs")
        found = materialize(_verified(pairs, sets, similarity), "similar")
        tried = tried.unionByName(pairs)
    raise AssertionError("unreachable")


def similar_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """doc_id, component_id of every row: documents linked by similar shingle sets, candidates by SimHash within `distance` bits and, for the rest, by bands. Null, empty and wordless texts are alike; null ids take no part; rows that share a doc_id are one
    document, which every text of theirs links; an empty table gives an empty table."""
    docs = ids_and_text(docs)

    def run(batches):
        release()
        for b in batches:
            sims, sets = [], []
            for t in b.column(1).to_pylist():
                hashes = shingle_hashes(t, width)
                sims.append(of_hashes(hashes))
                sets.append(np.unique(hashes))
            keys = pa.array(map(band_keys, sets), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(fingerprint, sets), pa.binary()), pa.array(np.array(sims, np.uint64).view(np.int64)), keys], names=["doc_id", "fp", "sim", "bands"])

    fps = materialize(docs.mapInArrow(run, "doc_id long, fp binary, sim long, bands array<long>"), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("sim").alias("sim"), F.first("bands").alias("bands"))
    classes = similar_classes(docs, reps, width, similarity, distance)
    named = reps.join(classes, reps.rep == classes.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """docs with one document of each component, that of its smallest doc_id; rows without a doc_id stay.

    Null, empty and wordless texts are alike and keep one document; other columns stay whatever their names; an empty table stays empty. Rows that share a doc_id are one document: they go
    together where a text of theirs is similar to a smaller document's, and else stay, all texts of them; of rows with one id and text, the one that comes first as JSON stays.
    """
    with scratch():
        gone = materialize(similar_components(docs, width, similarity, distance).where("doc_id <> component_id").select("doc_id").distinct(), "near-copies", keep=True)
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return rest
    first = W.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*docs.columns)))
    once = rest.join(repeated, "doc_id", "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return rest.join(repeated, "doc_id", "left_anti").unionByName(once.select(*docs.columns)).select(*docs.columns)
