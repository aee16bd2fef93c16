"""Exact token counts of every prefix by dynamic programming over a piece's bytes."""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bytepair import merge
from .runtime import ids_and_text, resident
from .textio import CHUNK, WHITE, Memo, blocks

#: The byte-level pre-tokenizer's own pattern. Fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_names() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others shifted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class PrefixCounter:
    """Counts as the tokenizers library does for a byte-level BPE file, without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        names = byte_names()
        plain = lambda s: bytes(map(names.__getitem__, s))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {plain(a) + plain(b): n for n, (a, b) in enumerate(pairs)}
        self.tokens = {bytes([b]) for b in range(256)} | set(self.ranks)
        self.reach: dict[bytes, int] = {}  # length of the longest token with the same last three bytes
        for t in self.tokens:
            self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 0))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.nested = any(x != y and x in y for x in special for y in special)
        self.pattern = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.white = re.compile(f"[{WHITE}]+")
        self.fits = Memo(lambda pair: merge(pair[0] + pair[1], self.ranks) == list(pair), 100_000)
        self.piece = Memo(lambda p: self.prefixes(p.encode("utf-8"))[-1], 400_000)
        split = self.pattern.findall
        self.total = Memo(lambda chunk: sum(map(self.piece.__getitem__, split(chunk))), 400_000)

    def prefixes(self, data: bytes) -> list[int]:
        """Token counts of data[:0], data[:1] ... data, each taken as one pre-token.

        The last token of a prefix is the one that stays apart from the last token of what comes before it.
        """
        counts, last, tokens, fits, reach = [0], [b""], self.tokens, self.fits, self.reach.get
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - reach(data[max(0, i - 3) : i], 2)), i):
                token = data[j:i]
                if token in tokens and (not j or fits[last[j], token]):
                    counts.append(counts[j] + 1)
                    last.append(token)
                    break
        return counts

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        n, at = 0, 0
        for m in self.special.finditer(text):
            n += 1 + self._plain(text[at : m.start()])
            at = m.end()
        return n + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        return sum(sum(map(self.total.__getitem__, some)) for some in blocks(CHUNK, text))

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:0], text[:1] ... text, exact for each of these texts.

        A special string counts as one token once it is whole; until then, what there is of it is plain text after what comes before. Time grows with the text.
        """
        out, at = [0], 0
        for m in self.special.finditer(text):
            before = out[-1]
            table = self._plain_prefixes(text[at : m.end() - 1])
            out += [before + n for n in table[1:]]
            if self.nested:
                out[m.start() + 1 :] = [self.count(text[:k]) for k in range(m.start() + 1, m.end())]
            out.append(before + table[m.start() - at] + 1)
            at = m.end()
        before = out[-1]
        return out + [before + n for n in self._plain_prefixes(text[at:])[1:]]

    def _plain_prefixes(self, text: str) -> list[int]:
        """As prefix_counts(), of a text that is taken as plain: a run of white space is one pre-token wherever a prefix ends in it, so its table is made once."""
        out, before, at, start, table = [0], 0, 0, 0, []
        for chunk in (c for some in blocks(CHUNK, text) for c in some):
            white = len(chunk) if self.white.match(chunk[-1]) else int(chunk[0] == " ")
            if white and at >= start + len(table):
                run = self.white.match(text, at)[0]
                inner, start = self.prefixes(run.encode("utf-8")), at
                table = [out[at] + inner[n] for n in accumulate(len(ch.encode("utf-8")) for ch in run)]
            out += table[at - start : at - start + white] if white else ()
            at += len(chunk)
            if white == len(chunk):
                before += self.total[chunk]
                continue
            for p in self.pattern.findall(chunk):
                inner = self.prefixes(p.encode("utf-8"))
                for k, n in enumerate(accumulate(len(ch.encode("utf-8")) for ch in p)):
                    if white:
                        white = 0  # counted above
                    else:
                        out.append(before + (self.total[p[: k + 1]] if p in CONTRACTIONS and k + 1 < len(p) else inner[n]))
                before += inner[-1]
        return out

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens."""
        counts = self.prefix_counts(text)
        return max(i for i, n in enumerate(counts) if n <= budget)


def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and vocabulary."""
    return resident(("counts", path), lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    Null texts count as empty: zero bytes and tokens. Repeated rows each have a row, an empty table gives an empty
    table, and other columns are ignored. Very long texts are counted in bounded blocks.
    """

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return ids_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and counts (array of int): the token count of every character prefix, for budgets without re-encoding.

    Null texts have the single count 0; special strings count as the library counts them in each prefix.
    """

    def run(batches):
        c = counter(path)
        for b in batches:
            out = [c.prefix_counts(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, counts array<int>")
