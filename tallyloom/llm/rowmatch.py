"""Row pattern matching over each client's rows in order: a first row, a body that a finite automaton reads, and an optional last row that must reach the first row's value.

Rows are range-split by client and order, so a huge client lies in many partitions, and the rows of a client in a partition become chunks of CHUNK rows at most. Within a chunk the automaton's
transition functions are composed by doubling, for all rows at once. Of chunks that may go on elsewhere a summary of fixed form is kept: for each
state that a reader may enter with, where it ends (a state, or nowhere), the last accepting row on the way, and the goal, a staircase with one step: the greatest first value that the row after it
still reaches. Summaries compose associatively. A tree of fan-out FAN combines them upwards, and hands to each chunk, downwards, what lies to its left and to its right. Matches that
span chunks are then resolved from the right, and matches are numbered from the count that the left gives: as the search goes on at the row after a match's first row, every row is an
entry position, and the chain of entries is stitched by these counts alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, release

#: Rows of a chunk, and summaries that are combined at a time (a power of two, as bits).
CHUNK, FAN_BITS = 1 << 15, 5
MINUTE = 60_000_000


@dataclass(frozen=True)
class Pattern:
    """moves[state][letter] is the next state or -1; a reader starts in state 0 after the first row and matches up to the last row that leads to an accepting state.

    Letter 0 fits nothing; letter k is written labels[k - 1]. So a greedy regular expression with letters that exclude each other is one Pattern.
    """

    labels: str
    moves: tuple[tuple[int, ...], ...]
    accepting: frozenset[int]
    first: str = "A"
    last: str = "P"
    most_gap: int = 30 * MINUTE

    @property
    def states(self) -> int:
        return len(self.moves)


#: A (D+ U+)+ P?: 0 after A, 1 in the first falls, 2 in rises, 3 in later falls.
FALLS_AND_RISES = Pattern("DU", ((-1, 1, -1), (-1, 1, 2), (-1, 3, 2), (-1, 3, 2)), frozenset({2}))

#: What a row can be besides its value: no body row, a plain row, or one that can be last.
BARRED, PLAIN, GOAL = 0, 1, 2


def letters(cents: np.ndarray, valid: np.ndarray, ts: np.ndarray, kind: np.ndarray, most_gap: int) -> np.ndarray:
    """The letter of each row but the first: 1 below the row before, 2 above it, 0 else or where it may not follow."""
    ok = valid[1:] & valid[:-1] & (kind[1:] != BARRED) & (ts[1:] - ts[:-1] <= most_gap)
    return np.where(ok, np.where(cents[1:] < cents[:-1], 1, np.where(cents[1:] > cents[:-1], 2, 0)), 0).astype(np.int8)


class Reader:
    """For each row and state: how a reader ends that enters before this row. Letter -1 marks the first row of a chunk, where a reader leaves the one before."""

    def __init__(self, letter: np.ndarray, pattern: Pattern):
        k, n = pattern.states, len(letter)
        dead = 2 * k  # states k ... 2 k - 1 have left in state - k
        table = np.full((dead + 1, len(pattern.labels) + 2), dead, np.int16)
        for s, row in enumerate(pattern.moves):
            table[s, 0] = k + s
            table[s, 1:] = [dead if to < 0 else to for to in row]
        table[k:dead] = np.arange(k, dead)[:, None]
        accepting = np.zeros(dead + 1, bool)
        accepting[list(pattern.accepting)] = True
        padded = np.append(letter, np.int8(-1)).astype(np.int64)  # the end of all rows
        self.state = table[:k, padded + 1].T.copy()
        self.accept = np.where(accepting[self.state], np.arange(n + 1)[:, None], -1)
        step = 1
        while step <= n and (self.state[: n + 1 - step] < k).any():
            live = np.argwhere(self.state[: n + 1 - step] < k)
            at, s = live[:, 0], live[:, 1]
            then = (at + step, self.state[at, s])
            later, after = self.accept[then], self.state[then]
            self.state[at, s] = after
            self.accept[at, s] = np.where(later >= 0, later, self.accept[at, s])
            step *= 2
        self.k = k


#: A summary speaks of readers that have read its first row and are in state s. exits[s]: the state at the end, -1 for nowhere. ends[s]: rows up to and with the last accepting one, 0 for none;
#: sums[s] and end_ids[s]: the total of those rows but the first, and the id of the last of them. goals[s] and goal_ids[s]: value and id of the row after that one (after the first row where
#: ends[s] is 0), where it can be last. labels: of the rows after the first, as far as any reader comes. matches: first rows whose match is known; pending[s]: first rows whose
#: reader leaves in state s and has not matched.
FIELDS = [
    *((x, "long") for x in ("n", "total", *(f"{side}_{what}" for side in ("first", "last") for what in ("ts", "cents", "kind", "id")), "matches")),
    *((x, "array<long>") for x in ("exits", "ends", "sums", "end_ids", "goals", "goal_ids", "pending")),
    ("labels", "string"),
]
_ARROW = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "string": pa.string()}
SUMMARY, SUMMARY_ARROW = f"struct<{','.join(f'{x}:{t}' for x, t in FIELDS)}>", pa.struct([(x, _ARROW[t]) for x, t in FIELDS])
Summary = dict[str, Any]


def boundary(a: Summary, b: Summary, pattern: Pattern) -> int:
    """The letter of b's first row after a's last one."""
    both = lambda what: np.array([a[f"last_{what}"] or 0, b[f"first_{what}"] or 0], np.int64)
    valid = np.array([a["last_cents"] is not None, b["first_cents"] is not None])
    return int(letters(both("cents"), valid, both("ts"), both("kind"), pattern.most_gap)[0])


def goal_after(a: Summary, b: Summary, pattern: Pattern) -> tuple[int | None, int | None]:
    """Value and id of b's first row if it can be last right after a's last row."""
    if b["first_kind"] != GOAL or b["first_cents"] is None or b["first_ts"] - a["last_ts"] > pattern.most_gap:
        return None, None
    return b["first_cents"], b["first_id"]


def onward(state: int, a: Summary, b: Summary, pattern: Pattern) -> tuple[int, int, int, int | None, int | None, int | None]:
    """What a reader that leaves a in this state meets in b: exit, rows up to the last accepting one (0: none), their total, the last one's id, goal and goal id after it."""
    letter = boundary(a, b, pattern)
    s = pattern.moves[state][letter]
    if s < 0:
        return -1, 0, 0, None, None, None
    if b["ends"][s]:
        return b["exits"][s], b["ends"][s], b["first_cents"] + b["sums"][s], b["end_ids"][s], b["goals"][s], b["goal_ids"][s]
    if s in pattern.accepting:
        return b["exits"][s], 1, b["first_cents"], b["first_id"], b["goals"][s], b["goal_ids"][s]
    return b["exits"][s], 0, 0, None, None, None


def compose(a: Summary | None, b: Summary | None, pattern: Pattern) -> Summary | None:
    """The summary of a's rows followed by b's; associative, None for no rows."""
    if a is None or b is None:
        return b if a is None else a
    out = dict(a, n=a["n"] + b["n"], total=a["total"] + b["total"], **{f"last_{x}": b[f"last_{x}"] for x in ("ts", "cents", "kind", "id")})
    out |= {x: list(a[x]) for x in ("exits", "ends", "sums", "end_ids", "goals", "goal_ids")}
    out["pending"], out["matches"] = list(b["pending"]), a["matches"] + b["matches"]
    for s in range(pattern.states):
        if a["exits"][s] < 0:
            continue
        leave, rows, gain, end_id, goal, goal_id = onward(a["exits"][s], a, b, pattern)
        out["exits"][s] = leave
        if rows:
            out["ends"][s], out["sums"][s], out["end_ids"][s] = a["n"] + rows, a["total"] - (a["first_cents"] or 0) + gain, end_id
            out["goals"][s], out["goal_ids"][s] = goal, goal_id
        elif (a["ends"][s] or 1) == a["n"]:
            out["goals"][s], out["goal_ids"][s] = goal_after(a, b, pattern)
    for s, n in enumerate(a["pending"]):
        if n:
            leave, rows, *_ = onward(s, a, b, pattern)
            if rows:
                out["matches"] += n
            elif leave >= 0:
                out["pending"][leave] += n
    letter = boundary(a, b, pattern)
    if letter and len(a["labels"]) == a["n"] - 1:
        out["labels"] = a["labels"] + pattern.labels[letter - 1] + b["labels"]
    return out


class Chunks:
    """The rows of chunks one after the other, and where each reader from each row comes."""

    def __init__(self, offsets: np.ndarray, ids: pa.Array, ts: pa.Array, cents: pa.Array, kind: pa.Array, pattern: Pattern):
        self.pattern, self.offsets = pattern, offsets
        self.ids, self.no_id = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False)
        self.ts, self.kind = ts.to_numpy(zero_copy_only=False), kind.to_numpy(zero_copy_only=False)
        self.cents, self.valid = pc.fill_null(cents, 0).to_numpy(zero_copy_only=False), pc.is_valid(cents).to_numpy(zero_copy_only=False)
        self.sums = np.concatenate(([0], np.cumsum(self.cents)))
        letter = np.concatenate(([0], letters(self.cents, self.valid, self.ts, self.kind, pattern.most_gap))) if len(self.ts) else np.zeros(0, np.int8)
        letter[offsets[:-1]] = -1
        self.reader = Reader(letter, pattern)
        self.text = np.frombuffer(("?." + pattern.labels).encode(), np.uint8)[letter + 1].tobytes().decode()
        self.goal = np.zeros(len(self.ts), bool)  # rows that can be last, the row before allowing
        if len(self.ts):
            self.goal[1:] = (self.kind[1:] == GOAL) & self.valid[1:] & (self.ts[1:] - self.ts[:-1] <= pattern.most_gap)
            self.goal[offsets[:-1]] = False

    def id_at(self, i: int) -> int | None:
        return None if self.no_id[i] else int(self.ids[i])

    def summary(self, c: int) -> Summary:
        """Of chunk c."""
        a, b = int(self.offsets[c]), int(self.offsets[c + 1])
        k, out = self.pattern.states, {"n": b - a, "total": int(self.sums[b] - self.sums[a])}
        for side, i in (("first", a), ("last", b - 1)):
            out |= {f"{side}_ts": int(self.ts[i]), f"{side}_cents": int(self.cents[i]) if self.valid[i] else None, f"{side}_kind": int(self.kind[i]), f"{side}_id": self.id_at(i)}
        state, accept = self.reader.state[a + 1].tolist(), self.reader.accept[a + 1].tolist()
        at = [x if x >= 0 else a for x in accept]
        goal = [i + 1 if i + 1 < b and self.goal[i + 1] else None for i in at]
        out["exits"] = [s - k if k <= s < 2 * k else -1 for s in state]
        out["ends"] = [x - a + 1 if x >= 0 else 0 for x in accept]
        out["sums"] = [int(self.sums[x + 1] - self.sums[a + 1]) if x >= 0 else 0 for x in accept]
        out["end_ids"] = [self.id_at(x) if x >= 0 else None for x in accept]
        out["goals"] = [None if g is None else int(self.cents[g]) for g in goal]
        out["goal_ids"] = [None if g is None else self.id_at(g) for g in goal]
        rest = self.text[a + 1 : b]
        out["labels"] = rest[: rest.find(".")] if "." in rest else rest
        state, accept, valid = self.reader.state[a + 1 : b + 1, 0], self.reader.accept[a + 1 : b + 1, 0], self.valid[a:b]
        out["matches"] = int((accept >= 0).sum())
        left = valid & (accept < 0) & (state >= k) & (state < 2 * k)
        out["pending"] = np.bincount(state[left] - k, minlength=k).tolist()
        return out


COLUMNS = ("ids", "ts", "cents", "kind")
CHUNK_ARROW = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("edge", pa.bool_()), *((c, pa.list_(pa.int64())) for c in COLUMNS), ("summary", SUMMARY_ARROW)])
CHUNK_DDL = f"key long, part long, seq long, edge boolean, {', '.join(f'{c} array<long>' for c in COLUMNS)}, summary {SUMMARY}"


def _chunks(rows: DataFrame, pattern: Pattern, size: int) -> DataFrame:
    """Chunks of sorted rows(key, id, ts, cents, kind), with summaries where a client may go on in another chunk (edge)."""

    def run(batches):
        release()
        part, open_key, seq, emitted = TaskContext.get().partitionId(), None, 0, 0
        held: list[pa.Table] = []

        def chunk(piece: pa.RecordBatch, key: int, number: int, edge: bool):
            columns = [piece.column(c) for c in ("id", "ts", "cents", "kind")]
            made = Chunks(np.array([0, len(piece)]), *columns, pattern).summary(0) if edge else None
            return key, part, number, edge, columns, made

        def out(made):
            keys, parts, seqs, edges, columns, summaries = zip(*made)
            ends = np.cumsum([0, *(len(c[0]) for c in columns)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([c[i] for c in columns])) for i in range(4)]
            first = [pa.array(x, t) for x, t in zip((keys, parts, seqs, edges), (pa.int64(),) * 3 + (pa.bool_(),))]
            return pa.RecordBatch.from_arrays([*first, *lists, pa.array(summaries, SUMMARY_ARROW)], schema=CHUNK_ARROW)

        def pieces(last: bool):
            """Chunks of what is held but the open client's last rows, unless nothing follows."""
            nonlocal held, open_key, seq, emitted
            table = pa.Table.from_batches(held).combine_chunks()
            rows = table.to_batches()[0] if len(table) else None
            held = []
            if rows is None:
                return
            keys = rows.column("key").to_numpy()
            cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            made = []
            for a, b in zip(cut, cut[1:]):
                key, ended = int(keys[a]), b < len(keys) or last
                if key != open_key:
                    open_key, seq = key, 0
                while b - a > size:
                    made.append(chunk(rows.slice(a, size), key, seq, True))
                    a, seq = a + size, seq + 1
                if ended:
                    edge = seq > 0 or emitted + len(made) == 0 or b == len(keys)
                    made.append(chunk(rows.slice(a, b - a), key, seq, edge))
                else:
                    held = [rows.slice(a, b - a)]
                if len(made) >= 1000:
                    emitted += len(made)
                    yield out(made)
                    made = []
            if made:
                emitted += len(made)
                yield out(made)

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(map(len, held)) > 2 * size:
                yield from pieces(False)
        if held:
            yield from pieces(True)

    return rows.select("key", "id", "ts", "cents", "kind").mapInArrow(run, CHUNK_DDL)


def _combined(nodes: DataFrame, pattern: Pattern) -> DataFrame:
    """(key, node, summary) of each FAN neighbouring nodes."""

    def run(table: pa.Table) -> pa.Table:
        rows, whole = sorted(table.to_pylist(), key=lambda r: r["node"]), None
        for r in rows:
            whole = compose(whole, r["summary"], pattern)
        first = rows[0]
        return pa.Table.from_arrays([pa.array([first["key"]]), pa.array([first["node"] >> FAN_BITS]), pa.array([whole], SUMMARY_ARROW)], names=["key", "node", "summary"])

    return nodes.groupBy("key", F.shiftright("node", FAN_BITS)).applyInArrow(run, f"key long, node long, summary {SUMMARY}")


def _contexts(nodes: DataFrame, above: DataFrame | None, pattern: Pattern) -> DataFrame:
    """(key, node, before, after): what lies to the left and to the right of each node in all of its client; above has that of the parents."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        before, after = [rows[0].get("before")], [rows[0].get("after")]
        for r in rows[:-1]:
            before.append(compose(before[-1], r["summary"], pattern))
        for r in rows[:0:-1]:
            after.append(compose(r["summary"], after[-1], pattern))
        columns = [pa.array([r[c] for r in rows], pa.int64()) for c in ("key", "node")]
        return pa.Table.from_arrays([*columns, pa.array(before, SUMMARY_ARROW), pa.array(after[::-1], SUMMARY_ARROW)], names=["key", "node", "before", "after"])

    placed = nodes.withColumn("parent", F.shiftright("node", FAN_BITS))
    if above is not None:
        placed = placed.join(above.withColumnRenamed("node", "parent"), ["key", "parent"])
    return placed.groupBy("key", "parent").applyInArrow(run, f"key long, node long, before {SUMMARY}, after {SUMMARY}")


@lru_cache(50_000)
def _digest(labels: str) -> str:
    return hashlib.sha256(labels.encode()).hexdigest()


MATCH = pa.schema([("key", pa.int64()), ("match_no", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_rows", pa.int64()), ("sum_cents", pa.int64()), ("labels_sha256", pa.string())])


def _matches(chunks: DataFrame, pattern: Pattern) -> DataFrame:
    """Matches that begin in chunks with their contexts."""
    head = lambda body, goal: _digest(f"{pattern.first}{body}{pattern.last if goal else ''}")

    def run(batches):
        release()
        for b in batches:
            if not b.num_rows:
                continue
            column = lambda c: b.column(b.schema.get_field_index(c))
            flat = [column(c).flatten() for c in COLUMNS]
            offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(column("ts")).to_numpy())))
            yield from found(Chunks(offsets, *flat, pattern), column("key").to_numpy(), *(column(c).to_pylist() for c in ("before", "summary", "after")))

    def found(c: Chunks, keys, before, summaries, after):
        n, k = len(c.ts), pattern.states
        state, end = c.reader.state[1:, 0], c.reader.accept[1:, 0].copy()
        of = np.repeat(np.arange(len(keys)), np.diff(c.offsets))
        hit = end >= 0
        at = np.where(hit, end, 0)
        after_end = np.minimum(at + 1, n - 1)
        goal = hit & (at + 1 < n) & c.goal[after_end] & (c.cents[after_end] >= c.cents)
        last = at + goal
        rows, total = last - np.arange(n) + 1, c.sums[last + 1] - c.sums[:-1]
        last_id, last_null = c.ids[last], c.no_id[last]
        told: dict[int, str] = {}
        base = np.zeros(len(keys), np.int64)
        for j, (left, own, right) in enumerate(zip(before, summaries, after)):
            if left is not None:
                rest = compose(own, right, pattern)
                base[j] = left["matches"] + sum(m for s, m in enumerate(left["pending"]) if m and onward(s, left, rest, pattern)[1])
            if right is None:
                continue
            a, b = int(c.offsets[j]), int(c.offsets[j + 1])
            for i in (a + np.flatnonzero(c.valid[a:b] & (state[a:b] >= k) & (state[a:b] < 2 * k))).tolist():
                _, more, gain, end_id, goal_cents, goal_id = onward(int(state[i]) - k, own, right, pattern)
                if more:
                    body, r, t, e = c.text[i + 1 : b] + pattern.labels[boundary(own, right, pattern) - 1] + right["labels"][: more - 1], b - i + more, int(c.sums[b] - c.sums[i]) + gain, end_id
                elif end[i] == b - 1:
                    body, r, t, e = c.text[i + 1 : b], b - i, int(c.sums[b] - c.sums[i]), c.id_at(b - 1)
                    goal_cents, goal_id = goal_after(own, right, pattern)
                else:
                    continue
                reached = goal_cents is not None and goal_cents >= c.cents[i]
                hit[i], rows[i], total[i] = True, r + reached, t + (goal_cents if reached else 0)
                e = goal_id if reached else e
                last_id[i], last_null[i], told[i] = e or 0, e is None, head(body, reached)
        starts = np.flatnonzero(hit)
        if not len(starts):
            return
        counts = np.concatenate(([0], np.cumsum(hit)))
        number = counts[starts + 1] - counts[c.offsets[of[starts]]] + base[of[starts]]
        digests = [told.get(i) or head(c.text[i + 1 : e + 1], g) for i, e, g in zip(starts.tolist(), end[starts].tolist(), goal[starts].tolist())]
        columns = [
            pa.array(keys[of[starts]]),
            pa.array(number),
            pa.array(c.ids[starts], mask=c.no_id[starts]),
            pa.array(last_id[starts], mask=last_null[starts]),
            pa.array(rows[starts]),
            pa.array(total[starts]),
            pa.array(digests, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=MATCH)

    kept = chunks.select("key", *COLUMNS, "summary", "before", "after")
    return kept.mapInArrow(run, "key long, match_no long, first_id long, last_id long, n_rows long, sum_cents long, labels_sha256 string")


def match_rows(rows: DataFrame, pattern: Pattern = FALLS_AND_RISES, chunk: int = CHUNK, partitions: int | None = None) -> DataFrame:
    """key, match_no (from 1 in each key), first_id, last_id, n_rows, sum_cents, labels_sha256 of every match in rows(key, ts, id, cents, kind).

    Rows are ordered by ts, id, kind and cents, and by tie where there is such a column; ts in microseconds; kind is BARRED, PLAIN or GOAL. A null key or ts drops a row; null cents fit no letter; a null id comes first and
    stays null. All rows given count, repeated ones too. An empty table gives an empty table. Each row is tried as a first row. A task holds one partition's chunks, one after the other;
    what is summed up of a chunk is of fixed size but for the labels of readers that leave it, which are no longer than the match itself.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "ts", "id", "kind", "cents"]
    order += ["tie"] if "tie" in rows.columns else []
    tidy = rows.where("key is not null and ts is not null").select(*(F.col(c).cast("long").alias(c) for c in order))
    spread = tidy.repartitionByRange(n, *order).sortWithinPartitions(*order)
    chunks = materialize(_chunks(spread, pattern, chunk), "chunks")
    top = chunks.agg(F.max("seq").alias("seq"), F.max("part").alias("part")).first()
    width, count = (top.seq or 0) + 1, (top.part or 0) + 1
    edges = chunks.where("edge").withColumn("node", F.col("part") * width + F.col("seq"))
    levels, bits = [edges.select("key", "node", "summary")], max(1, (width * count - 1).bit_length())
    for _ in range((bits - 1) // FAN_BITS):
        levels.append(materialize(_combined(levels[-1], pattern), "nodes"))
    context = None
    for nodes in reversed(levels):
        context = _contexts(nodes, context, pattern)
    context = materialize(context, "contexts")
    inner = chunks.where("not edge").select("*", *(F.lit(None).cast(SUMMARY).alias(c) for c in ("before", "after")))
    outer = edges.join(context, ["key", "node"]).select(*inner.columns)
    return _matches(inner.unionByName(outer), pattern)


def _micros(clicks: DataFrame) -> Column:
    """Microseconds since 1970 of ts; of a time without a zone whatever the session's zone is."""
    if dict(clicks.dtypes)["ts"] != "timestamp_ntz":
        return F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.unix_date(F.to_date("ts")).cast("long") * 86_400 + F.hour("ts") * 3600 + F.minute("ts") * 60
    return seconds * 1_000_000 + F.expr("cast(extract(second from ts) * 1000000 as bigint)")


def click_rows(clicks: DataFrame) -> DataFrame:
    """Distinct clicks as rows of match_rows(): cents are floor(100 * value + 0.5), null for values that are null or not finite; errors and null kinds are barred, kind click can be last."""
    value = F.col("value").cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 9e16)
    kind = F.when(F.col("kind").isNull() | (F.col("kind") == "error"), BARRED).when(F.col("kind") == "click", GOAL).otherwise(PLAIN)
    some = clicks.where("client_id is not null and ts is not null").distinct()
    cents = F.when(finite, F.floor(100 * value + 0.5))
    return some.select(F.col("client_id").alias("key"), _micros(clicks).alias("ts"), F.col("click_id").alias("id"), cents.alias("cents"), kind.alias("kind"), F.xxhash64(*clicks.columns).alias("tie"))


def click_matches(clicks: DataFrame, pattern: Pattern = FALLS_AND_RISES, chunk: int = CHUNK) -> DataFrame:
    """client_id and the columns of match_rows() for a table of clicks; columns beyond click_id, ts, client_id, kind and value only tell distinct rows apart."""
    return match_rows(click_rows(clicks), pattern, chunk).withColumnRenamed("key", "client_id")
