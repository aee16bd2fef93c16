"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .runtime import ids_and_text, resident
from .textio import CHUNK, Memo, blocks


#: Distinct pieces that a worker remembers, in each of two generations.
PIECES = 400_000


class PerfectHash:
    """Minimal perfect hash of byte strings: levels of bit sets, a key's number is the count of bits before its own.

    A key sits on the first level where no other key shares its slot. Foreign keys are told apart by comparing the
    stored key, so find() is exact for any input.
    """

    def __init__(self, keys: list[bytes], values: list[int], slack: float = 2.0):
        self.sizes, self.starts, marks, left, start = [], [], [], np.arange(len(keys)), 0
        order: list[tuple[int, int]] = []
        while len(left):
            if len(self.sizes) > 64:
                raise ValueError("keys repeat")
            size = int(slack * len(left)) + 1
            slot = np.array([xxhash.xxh64_intdigest(keys[i], len(self.sizes)) % size for i in left.tolist()])
            alone = np.bincount(slot, minlength=size) == 1
            placed = alone[slot]
            order += zip((start + slot[placed]).tolist(), left[placed].tolist())
            marks.append(alone)
            self.sizes.append(size)
            self.starts.append(start)
            left, start = left[~placed], start + size
        bits = np.concatenate(marks) if marks else np.zeros(0, bool)
        self.bits, self.before = bits.tobytes(), (np.cumsum(bits) - bits).astype(np.int32).tolist()
        order.sort()
        self.keys, self.values = [keys[i] for _, i in order], [values[i] for _, i in order]

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, key: bytes) -> int | None:
        """The value of a key, or None."""
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + xxhash.xxh64_intdigest(key, level) % size
            if self.bits[at]:
                n = self.before[at]
                return self.values[n] if self.keys[n] == key else None
        return None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The byte-pair merges of a piece: always the lowest rank, the leftmost of equals."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (b := before[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = after[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteCoder:
    """Encodes as the tiktoken library's encode_ordinary with the same ranks and pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.hash = PerfectHash(list(self.ranks), list(self.ranks.values()))
        # the other library's white space is Unicode White_Space
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.by_name = {str(i): b for i, b in self.bytes_of.items()}
        self.names = Memo(lambda chunk: "".join(f" {i}" for i in self.encode_piecewise(chunk)), PIECES)

    def piece(self, data: bytes) -> list[int]:
        if (whole := self.hash.find(data)) is not None:
            return [whole]
        return [self.ranks[p] for p in merge(data, self.ranks)]

    def encode_piecewise(self, text: str) -> list[int]:
        return [i for p in self.pattern.findall(text) for i in self.piece(p.encode("utf-8"))]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [int(i) for some in blocks(CHUNK, text) for i in "".join(map(self.names.__getitem__, some)).split()]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the bytes decoded from them."""
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for some in blocks(CHUNK, text):
            names = "".join(map(self.names.__getitem__, some))
            ids.update((names if n else names[1:]).encode("ascii"))
            decoded.update(b"".join(map(self.by_name.__getitem__, names.split())))
            n += names.count(" ")
        return n, ids.hexdigest(), decoded.hexdigest()


def coder(path: str, pattern: str) -> ByteCoder:
    """One coder for each worker process and vocabulary."""
    return resident(("bytes", path, pattern), lambda: ByteCoder(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row. Null and empty texts have no ids."""

    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            ids = pa.array([c.encode(t) if t else [] for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that ids stand for. Null ids stand for no bytes; an unknown id is an error."""

    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            out = pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "data"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def encoding_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids.

    Null texts count as empty: no ids, both hashes those of nothing. Repeated rows each have a row, an empty table
    gives an empty table, and other columns are ignored. Very long texts are encoded in bounded blocks.
    """

    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            n, ids, decoded = zip(*(c.digest(t or "") for t in b.column(1).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return ids_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
