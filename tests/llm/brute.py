"""Plain versions of the operators for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text, width=4):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, width=4, distance=4):
    fps = {text: fingerprint(text, width) for text in {t for _, t in rows}}
    distinct = sorted(set(fps.values()))
    a = np.array(distinct, np.uint64)
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= distance).tolist():
            parent[root(i)] = root(i + 1 + j)
    place = {f: i for i, f in enumerate(distinct)}
    least = {}
    for doc_id, text in rows:
        r = root(place[fps[text]])
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((doc_id, format(fps[text], "016x"), least.get(root(place[fps[text]]))) for doc_id, text in rows), key=str)


def substring_dedup(rows, length=20):
    """rows in the order of occurrence: by doc_id; texts of equal ids by themselves."""
    seen, out = set(), []
    for doc_id, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def code_length(texts, text, order=4):
    """Bits of a text by contexts counted one by one, and its bytes."""
    coded = lambda t: "".join(" " + w for w in t.lower().split()).encode()
    seen = defaultdict(Counter)
    for t in texts:
        data = b" " * order + coded(t)
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[data[i - k : i]][data[i]] += 1
    data, bits = b" " * order + coded(text), 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            counts = seen.get(data[i - k : i])
            if counts is None:
                continue
            n, t = sum(counts.values()), len(counts)
            if data[i] in counts:
                bits += np.log2((n + t) / counts[data[i]])
                break
            bits += np.log2((n + t) / t)
        else:
            bits += 8.0
    return bits, len(data) - order


def quality_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return *base, base[0] < 50 or 100 * base[4] > 50 * base[0]


def quality_votes(text):
    """1, -1 or 0 of each rule: length, repetition, symbols, lines, capitals, digits, word length."""
    n, chars, symbols, dup, repeated, _ = quality_counts(text)
    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    upper, digits = (sum(c in some for c in text or "") for some in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
    band = lambda x, of, good, bad: 0 if not of else 1 if 100 * x <= good * of else -1 if 100 * x > bad * of else 0
    mean = 0 if not n else 1 if 3 * n <= chars <= 12 * n else -1 if chars < 2 * n or chars > 20 * n else 0
    return (1 if n >= 100 else -1 if n < 50 else 0, band(repeated, n, 10, 30), band(symbols, n, 2, 10), band(dup, lines, 5, 30), band(upper, chars, 20, 50), band(digits, chars, 10, 30), mean)


def quality_kept(texts, rounds=50):
    """Expectation-maximisation document by document, from a share of one half and accuracies of 0.8; accuracies stay in 0.55 ... 0.99, the share in 0.01 ... 0.99."""
    votes, share, right = [quality_votes(t) for t in texts], 0.5, [0.8] * 7

    def good(v):
        yes, no = share, 1 - share
        for x, a in zip(v, right):
            yes *= a if x > 0 else 1 - a if x < 0 else 1
            no *= 1 - a if x > 0 else a if x < 0 else 1
        return yes / (yes + no)

    for _ in range(rounds):
        p = [good(v) for v in votes]
        share = min(max(sum(p) / len(p), 0.01), 0.99)
        for r in range(7):
            told = [(x if v[r] > 0 else 1 - x) for v, x in zip(votes, p) if v[r]]
            right[r] = min(max(sum(told) / len(told), 0.55), 0.99) if told else right[r]
    return [not quality_counts(t)[5] and round(good(v), 6) >= 0.5 for t, v in zip(texts, votes)]


KINDS = ("assign", "access", "hex")


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
    counts = Counter(k for _, k, _ in found)
    return counts[0], counts[1], counts[2], hashlib.sha256(listed.encode()).hexdigest(), listed


def check_packing(rows, pieces, encode, end_id=1, capacity=2048):
    """Every id lies in one piece, sequences are gapless and within capacity; gives the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc_id, text in rows:
        ids = np.array([*encode(text or ""), end_id], "<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for some in by_sequence.values():
        at = 0
        for p in sorted(some, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, sum(p["length"] for p in pieces))


def shingles(text, width=5):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar_components(rows, width=5, similarity=0.8):
    """component of every row: least doc_id that links of a Jaccard similarity of 0.8 and more lead to, all pairs compared."""
    sets, parent = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= similarity * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, least[root(i)]) for i, (d, _) in enumerate(rows))


def line_dedup(rows, least=10):
    """rows of (doc_id, text) with distinct ids or the same one for equal documents."""
    tidy = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for doc_id, text in rows:
        for key in map(tidy, (text or "").split("\n")):
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(tidy(x)) < least or first[tidy(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def looped(w, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def periodic_runs(w, least=6, times=4):
    """All (start, length, period), every stretch of every period looked at."""
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and smallest_period(w[i : j + q]) == q:
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_digests(rows):
    out = []
    for doc_id, text in rows:
        w = looped(words(text), doc_id)
        runs = periodic_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        listed, kept = "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone)
        longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((doc_id, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def row_matches(rows, most_gap=30 * 60 * 1_000_000):
    """rows of (client, ts, id, value, kind), ts in microseconds, distinct; every start tried by backtracking in the order of a greedy regular expression."""
    by_client, out = defaultdict(list), []
    for client, ts, click, value, kind in set(rows):
        if client is not None and ts is not None:
            by_client[client].append((ts, click, None if value is None else int(np.floor(100 * value + 0.5)), kind))
    for client, some in by_client.items():
        some.sort(key=lambda r: (r[0], r[1]))
        near = lambda i: some[i][0] - some[i - 1][0] <= most_gap

        def fits(letter, i, a):
            if i >= len(some) or some[i][2] is None or not near(i):
                return False
            if letter == "P":
                return some[i][3] == "click" and some[i][2] >= some[a][2]
            if some[i][3] in (None, "error") or some[i - 1][2] is None:
                return False
            return some[i][2] < some[i - 1][2] if letter == "D" else some[i][2] > some[i - 1][2]

        def body(i, a, state):
            """Labels of the first match from row i on, or None. state: what came last."""
            for letter, to in {"A": [("D", "D")], "D": [("D", "D"), ("U", "U")], "U": [("U", "U"), ("D", "D")]}[state]:
                if fits(letter, i, a) and (rest := body(i + 1, a, to)) is not None:
                    return letter + rest
            if state != "U":
                return None
            return "P" if fits("P", i, a) else ""

        n = 0
        for a in range(len(some)):
            if some[a][2] is None or (labels := body(a + 1, a, "A")) is None:
                continue
            n += 1
            taken = some[a : a + 1 + len(labels)]
            out.append((client, n, taken[0][1], taken[-1][1], len(taken), sum(r[2] for r in taken), hashlib.sha256(("A" + labels).encode()).hexdigest()))
    return sorted(out)
