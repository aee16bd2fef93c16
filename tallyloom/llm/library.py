"""Encoding with the tokenizers library, each distinct piece of the texts once for each worker."""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import regex

from .runtime import resident
from .textio import CHUNK, WHITE, WORD, Memo, blocks
from .tokencount import byte_names

#: Distinct pieces whose ids a worker remembers, in each of two generations, and pre-tokens within pieces that are no words.
PIECES, MARKS = 300_000, 30_000
#: Pieces whose normal form, pre-tokens and byte names follow without the library: ASCII and the composed letters of Latin-1.
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
SIMPLE = re.compile(f" ?[!-~{LETTERS}]+")
#: A run of such letters before white space, an ASCII character of another kind or the end is a pre-token by itself.
ALONE = rf"[{LETTERS}]+(?![^{WHITE}!-@\[-`{{-~])"


class LibraryCoder:
    """Ids of texts by a tokenizer file, without added special tokens; strings of special tokens inside texts count.

    Pieces are cut only where the file's own pre-tokenizer always cuts, so that ids of a text are those of its pieces.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or spec["post_processor"]:
            raise ValueError(f"{path} needs whole texts")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        if spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["normalizer"]:
            self.pattern, self.inner, self.lower = re.compile(f" ?{ALONE}|{CHUNK.pattern}"), r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", False
            plain = spec["pre_tokenizer"]["use_regex"]
        elif spec["pre_tokenizer"]["type"] == "Sequence" and spec["pre_tokenizer"]["pretokenizers"][0].get("behavior") == "Removed":
            self.pattern, self.inner, self.lower = re.compile(f"{ALONE}|{WORD.pattern}"), spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], True  # white space is dropped
            plain = [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        else:
            raise ValueError(f"{path} has a pre-tokenizer of another kind")
        self.tokenizer = Tokenizer.from_file(path)
        model, shown = self.tokenizer.model, {b: c for c, b in byte_names().items()}
        self.simple = SIMPLE if plain else re.compile(r"(?!)")
        self.split = regex.compile(self.inner).findall
        self.names = {chr(c): "".join(map(shown.__getitem__, chr(c).encode("utf-8"))) for c in (32, *range(33, 127), *range(0xC0, 0x100))}
        self.table = str.maketrans(self.names)
        tokenize, table, space = model.tokenize, self.table, self.names[" "]

        def ids(piece: str) -> bytes:
            if not piece.isascii():
                piece = piece.translate(table)
            elif piece[0] == " ":
                piece = space + piece[1:]
            return struct.pack(f"<{len(found := tokenize(piece))}I", *[t.id for t in found])

        self.model, self.marks, self.pieces = ids, Memo(ids, MARKS), Memo(self._piece, PIECES)

    def _part(self, part: str) -> bytes:
        return self.pieces[part] if part.lstrip(" ").isalpha() else self.marks[part]

    def _piece(self, piece: str) -> bytes:
        if self.simple.fullmatch(piece):  # the library's model alone, on the pre-tokens
            piece = piece.lower() if self.lower else piece
            return self.model(piece) if piece.lstrip(" ").isalpha() else b"".join(map(self._part, self.split(piece)))
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        out = [b"".join(map(self.pieces.__getitem__, some)) for some in blocks(self.pattern, text)]
        return out[0] if len(out) == 1 else b"".join(out)

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()]), np.array([self.tokenizer.token_to_id(m[0])], "<u4").tobytes()
            at = m.end()
        return b"".join([*out, self._plain(text[at:] if at else text)])


def library_coder(path: str) -> LibraryCoder:
    """One coder for each worker process and vocabulary."""
    return resident(("library", path), lambda: LibraryCoder(path))
