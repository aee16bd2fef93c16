"""Coders against the public libraries, without Spark."""

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import flac
from tallyloom.llm.bytepair import ByteCoder, PerfectHash, merge, read_ranks
from tallyloom.llm.library import LibraryCoder
from tallyloom.llm.tokencount import PrefixCounter

TEXTS = [
    "", " ", "  ", "\n", "a", "Hello world", "it's  we'll\n\n\nI'd 'llama  \t x", "naïve café 東京 🙂🙂", "a\x1cb \x85c\xa0d  e", "x" * 500,
    "password = abc123XYZ==", "<|endoftext|>", "a  <|endoftext|>  b <|endoftext|>\n\nc<|startoftext|>d", "ﬁ ÅÅ Ǆ İ ß", "1234567 89 ½ ²", "tail  ", " 'tis don't !!!'s",
]
WILD = st.text(alphabet=st.sampled_from(list("abctheing 's\n\t  !9é東́\x85\xa0")), max_size=40)


@pytest.fixture(scope="module")
def byte_coder():
    return ByteCoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"key{i}".encode() for i in range(5000)]
    h = PerfectHash(keys, list(range(5000)))
    assert [h.find(k) for k in keys] == list(range(5000)) and len(h) == 5000
    assert all(h.find(f"no{i}".encode()) is None for i in range(5000))


@pytest.mark.parametrize("text", TEXTS)
def test_encodes_like_tiktoken(byte_coder, tik, text):
    ids = byte_coder.encode(text)
    assert ids == tik.encode_ordinary(text) and byte_coder.decode(ids) == text.encode()


@given(WILD)
@settings(max_examples=300, deadline=None)
def test_encodes_wild_text_like_tiktoken(byte_coder, tik, text):
    assert byte_coder.encode(text) == tik.encode_ordinary(text)


def test_merge_of_a_long_piece_is_quick_and_right(byte_coder, tik):
    text = "aabbab" * 3000
    assert [byte_coder.ranks[p] for p in merge(text.encode(), byte_coder.ranks)] == tik.encode_ordinary(text)


@pytest.mark.parametrize("text", TEXTS)
def test_counts_like_the_library(counter, library, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@given(WILD)
@settings(max_examples=200, deadline=None)
def test_prefix_counts_are_exact(counter, library, text):
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert counter.prefix_counts(text) == want
    for budget in (0, 1, 3):
        assert counter.fit(text, budget) == max(i for i, n in enumerate(want) if n <= budget)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_whole_texts(name):
    coder, library = LibraryCoder(P.path(name)), Tokenizer.from_file(P.path(name))
    for text in [*TEXTS, "é ́x Å Σας ΣΑΣ İstanbul\x0b\x0cq"]:
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@given(st.lists(st.one_of(st.binary(min_size=1, max_size=300), st.just(b"\0" * 64), st.binary(min_size=1, max_size=4).map(lambda b: b * 3000)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_flac_round_trip(parts):
    payloads = [p + bytes(-len(p) % 64) for p in parts]
    files = flac.encode(payloads)
    assert flac.decode(files) == payloads
    for p, f in zip(payloads, files):
        r = flac.Reader(f)
        first, block = r.block(len(p) - 1)
        assert (block + 128).astype(np.uint8).tobytes() == p[first : first + flac.FRAME]


def test_flac_text_uses_rice_codes_and_shrinks():
    text = b"the quick brown fox jumps over the lazy dog while it rains and rains on " * 120
    payload = text + bytes(-len(text) % 64)
    (file,) = flac.encode([payload])
    assert len(file) < len(payload) and flac.decode([file]) == [payload]


def test_flac_checksums_are_verified():
    (file,) = flac.encode([bytes(range(64)) * 10])
    broken = bytearray(file)
    broken[-10] ^= 1
    with pytest.raises(ValueError, match="CRC-16"):
        flac.decode([bytes(broken)])


def _bits(parts):
    s = "".join(format(v & (1 << w) - 1, f"0{w}b") for v, w in parts)
    s += "0" * (-len(s) % 8)
    return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))


def _frame(body, n):
    head = flac._frame_header(0, n)
    data = head + body
    crc = int(flac.crc16s(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])
    return data + crc.to_bytes(2, "big")


def test_linear_predictor_and_escaped_partitions_decode():
    """A hand-written frame: order 2, coefficients 2 and -1 shifted by 0, so residuals are second differences."""
    x = [5, 7, 10, 12, 11, 9, 6, 4, 3, 1, 0, -2, -1, 0, 2, 5]
    res = [x[i] - 2 * x[i - 1] + x[i - 2] for i in range(2, len(x))]
    parts = [(0, 1), (32 + 1, 6), (0, 1), (x[0], 8), (x[1], 8), (4 - 1, 4), (0, 5), (2, 4), (-1, 4), (0, 2), (1, 4), (15, 4), (6, 5)]
    parts += [(r, 6) for r in res[:6]] + [(1, 4)]
    for r in res[6:]:
        u = 2 * r if r >= 0 else -2 * r - 1
        parts += [(1, (u >> 1) + 1), (u & 1, 1)]
    assert flac.decode_frames([_frame(_bits(parts), 16)])[0].tolist() == x


def test_crc16_matches_bitwise_division():
    data = bytes(range(200))
    c = 0
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    assert int(flac.crc16s(np.frombuffer(data, np.uint8), np.array([0]), np.array([200]))[0]) == c
