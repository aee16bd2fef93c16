"""Line dedup by levelled sorted runs, in DataFrame functions only.

Documents come in batches of ascending doc_id. A batch's lines become (hash, doc_id) rows; those hashes that no run holds are found by a merge anti-join
and written as a run of their own, sorted by hash. A line goes if a run, or its own batch, holds its hash for a smaller doc_id. Once a level has `fan` runs
they are merged into one run of the next level, so that a batch meets few runs whatever number of batches came before.

A hash has the first 128 bits of SHA-256: two different keys among 10^12 share one with a probability below 10^-14. Only hashes, ids and places of lines are joined; texts
move once, to meet the places of the lines that they lose.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import discard, materialize

#: The six ASCII white-space characters.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys below this many characters are never looked at; batches of a table; runs of a level before they are merged.
LEAST, BATCHES, FAN = 10, 4, 2


def line_key(line: Column) -> Column:
    """A line without white space at its ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def line_hashes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, row, pos, h): the lines of docs(doc_id, row, text) whose keys have `least` characters, counted from 0 in each text."""
    lines = docs.where("doc_id is not null").select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keyed.select("doc_id", "row", "pos", F.unhex(F.substring(F.sha2(F.encode("key", "utf-8"), 256), 1, 32)).alias("h"))


@dataclass
class LineRuns:
    """The runs of all batches so far: for each level its tables (h, first), every h in one of them, first the smallest doc_id that holds it."""

    fan: int = FAN
    levels: list[list[DataFrame]] = field(default_factory=list)

    def seen(self, spark: SparkSession) -> DataFrame:
        out = spark.createDataFrame([], "h binary, first long")
        for run in (r for level in self.levels for r in level):
            out = out.unionByName(run)
        return out

    def _put(self, run: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            parts, self.levels[level] = self.levels[level], []
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.unionByName(p)
            self._put(materialize(merged.repartitionByRange("h").sortWithinPartitions("h"), f"run-{level + 1}"), level + 1)
            for p in parts:
                discard(p)

    def add(self, lines: DataFrame) -> DataFrame:
        """Put in a batch's lines(doc_id, row, pos, h) and give (doc_id, row, gone): sorted places of the lines that runs or the batch hold for a smaller doc_id.

        Batches have to come in the order of doc_id; what a later batch holds for a smaller doc_id changes nothing of what earlier calls gave.
        """
        spark = lines.sparkSession
        lines, before = materialize(lines, "lines"), self.seen(spark)
        own = lines.groupBy("h").agg(F.min("doc_id").alias("first"))
        fresh = materialize(own.join(before, "h", "left_anti").repartitionByRange("h").sortWithinPartitions("h"), "run-0")
        repeated = lines.join(before.unionByName(fresh), "h").where("doc_id > first")
        gone = materialize(repeated.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "gone")
        discard(lines)
        self._put(fresh)
        return gone

    def discard(self) -> None:
        for level in self.levels:
            for run in level:
                discard(run)
        self.levels = []


def _without(lines: Column, gone: Column) -> Column:
    """The lines that are not at these sorted places, from the stretches between them."""
    upto = lambda k: F.coalesce(F.get(gone, k), F.size(lines))
    since = lambda k: F.when(k > 0, F.get(gone, k - 1) + 1).otherwise(0)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, since(k) + 1, upto(k) - since(k))))


def dedup_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (lines that stay, joined by line feeds) of every row.

    A key (the line stripped, A-Z in lower case) of `least` characters that two doc_ids hold loses its lines in all but the smallest of them, where repeats stay.
    Null and empty texts have one empty line. Rows that share a doc_id are one document: they do not remove each other's lines, and equal lines of
    theirs stay or go together. Rows without a doc_id keep all lines and remove none. An empty table gives an empty table; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", shares).alias("cuts")).first().cuts or [])) if shares else []
    runs, gone = LineRuns(fan), None
    for low, high in zip([None, *cuts], [*cuts, None]):
        some = rows
        some = some if low is None else some.where(F.col("doc_id") > low)
        some = some if high is None else some.where(F.col("doc_id") <= high)
        found = runs.add(line_hashes(some, least))
        gone = found if gone is None else gone.unionByName(found)
    runs.discard()
    both = rows.join(gone, ["doc_id", "row"], "left").select("doc_id", F.split("text", "\n").alias("lines"), "text", "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_without(F.col("lines"), F.col("gone")), "\n"))
    return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_digests(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row. See dedup_lines()."""
    return dedup_lines(docs, least, batches, fan).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
