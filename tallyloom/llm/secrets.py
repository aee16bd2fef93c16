"""Secret scans in DataFrame functions only.

Base patterns find assignments, access keys and hexadecimal runs. The entropy scan adds strings (hexadecimal, of both cases and digits, or of one
case and digits) of which some window has a Shannon entropy that is high for its character class: counts of the window's characters are kept up as it slides, and the
sum of c * log2(c) over them, in whole millionths, says the entropy exactly. An allow-list suppresses known harmless strings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .runtime import ids_and_text

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_SQL = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of 16 and more always starts a match at its first character, so the shorter ones need not be found to be dropped.
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: Strings whose windows the entropy scan looks at.
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"
WINDOW = 20
#: Within a candidate of neither class below, runs of digits and letters of one case are looked at by themselves.
RUN = r"(?<![A-Za-z0-9])(?:[a-z0-9]{24,}|[A-Z0-9]{24,})(?![A-Za-z0-9])"
#: Least entropy of a window in bits: strings of hexadecimal digits, and strings with small and capital letters and digits;
#: runs with digits and small letters, and runs with digits and capital letters (base-32 has only six digits).
HEX_BITS, MIXED_BITS = 3.0, 3.6
LOWER_BITS, UPPER_BITS = 3.5, 3.4
#: Strings with placeholders and paths of several parts are harmless.
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|^[^/]*(/[a-z_-]+){3,}"

KINDS = ("assign", "access", "hex", "entropy")
SCALE = 1_000_000


#: Values of which running totals are taken at a time: appending to an array copies it.
STEPS = 64


def _running(values: Column, add, zero: Column) -> Column:
    """add of all values up to each place, in blocks, so that time grows with the number of values and not with its square."""
    n = F.size(values)
    one = lambda block: F.aggregate(block, F.array().cast("array<int>"), lambda out, x: F.array_append(out, add(F.coalesce(F.get(out, F.size(out) - 1), zero), x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STEPS).cast("int")), lambda k: one(F.slice(values, k * STEPS + 1, STEPS)))

    def joined(parts: Column) -> Column:
        ends = F.transform(parts, lambda p: F.get(p, F.size(p) - 1))
        before = lambda all_ends, k: F.aggregate(F.slice(all_ends, 1, k), zero, add)
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: let(before(e, k), lambda base: F.transform(p, lambda x: add(base, x))))))

    return F.when(n > 0, let(blocks, joined)).otherwise(F.array().cast("array<int>"))


def _found(text: Column, pattern: str) -> Column:
    """struct(at, s) of all matches of a pattern, leftmost first; positions in code points."""

    def place(pieces: Column, hits: Column) -> Column:
        gaps = F.transform(hits, lambda h, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0))
        return F.zip_with(_running(gaps, lambda a, x: a + x, F.lit(0)), hits, lambda at, h: F.struct(at.alias("at"), h.alias("s")))

    none = F.array().cast("array<struct<at:int,s:string>>")
    placed = let(F.split(text, pattern, -1), lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: place(pieces, hits)))
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _spans(found: Column, kind: str, keep) -> Column:
    rank = KINDS.index(kind)
    kept = F.filter(found, keep)
    return F.transform(kept, lambda x: F.struct(x.at.alias("start"), F.lit(rank).alias("kind"), (x.at + F.length(x.s)).alias("end")))


def _hot_windows(s: Column, most: Column) -> Column:
    """struct(first, last): starts of the first and last window whose sum of c * log2(c) is at most `most`; -1 if none.

    The sum follows the window: the character that leaves and the one that comes change it by their own counts, which are taken from the window's other characters.
    """
    table = F.lit([0] + [round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1)])
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def slide(all_codes: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            others = F.slice(all_codes, F.greatest(i - (WINDOW - 2), F.lit(1)), F.least(i, F.lit(WINDOW - 1)))  # those of both windows
            same = lambda x: F.size(F.filter(others, lambda c: c == x))
            gain = let(same(F.get(all_codes, i)), lambda n: F.get(table, n + 1) - F.get(table, n))
            loss = F.when(i >= WINDOW, let(same(F.get(all_codes, i - WINDOW)), lambda n: F.get(table, n + 1) - F.get(table, n))).otherwise(0)

            def moved(total: Column) -> Column:
                hot, at = (i >= WINDOW - 1) & (total <= most), i - (WINDOW - 1)
                return F.struct(total.cast("bigint").alias("sum"), F.when(hot & (a["first"] < 0), at).otherwise(a["first"]).alias("first"), F.when(hot, at).otherwise(a["last"]).alias("last"))

            return let(a["sum"] + gain - loss, moved)

        places = F.sequence(F.lit(0), F.size(all_codes) - 1)
        return F.aggregate(places, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return let(codes, slide)


def _limit(bits: float) -> int:
    """The sum of c * log2(c) in a window of at least so many bits."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE)


def _covered(x: Column, base: Column) -> Column:
    """Whether sorted base spans hold all of a span."""
    return F.aggregate(base, x.start, lambda at, b: F.when(b.start <= at, F.greatest(at, b.end)).otherwise(at)) >= x.end


def _entropy_spans(text: Column, base: Column) -> Column:
    """Added spans: from the first hot window of a string to the end of its last, unless base spans hold all of it."""
    is_hex = lambda s: s.rlike("^[0-9A-Fa-f]+$") & s.rlike("[0-9]")
    of_class = lambda s: is_hex(s) | s.rlike("[a-z]") & s.rlike("[A-Z]") & s.rlike("[0-9]")

    def strings(x: Column) -> Column:
        runs = F.filter(F.transform(_found(x.s, RUN), lambda r: F.struct((x.at + r.at).alias("at"), r.s.alias("s"))), lambda r: r.s.rlike("[0-9]"))
        return F.when(of_class(x.s), F.array(F.struct(x.at.alias("at"), x.s.alias("s")))).otherwise(runs)

    rank = KINDS.index("entropy")

    def span(x: Column) -> Column:
        one_case = F.when(x.s.rlike("^[a-z0-9]+$"), _limit(LOWER_BITS)).when(x.s.rlike("^[A-Z0-9]+$"), _limit(UPPER_BITS))
        most = F.when(x.s.rlike("^[0-9A-Fa-f]+$"), _limit(HEX_BITS)).otherwise(F.coalesce(one_case, F.lit(_limit(MIXED_BITS))))
        return let(
            _hot_windows(x.s, most),
            lambda w: F.struct(
                F.when(w.first < 0, -1).otherwise(x.at + w.first).alias("start"), F.lit(rank).alias("kind"), (x.at + w.last + WINDOW).alias("end")
            ),
        )

    looked_at = F.flatten(F.transform(F.filter(_found(text, CANDIDATE), lambda x: ~x.s.rlike(ALLOWED)), strings))
    return F.filter(F.transform(looked_at, span), lambda x: (x.start >= 0) & ~_covered(x, base))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def scan(docs: DataFrame, base_name: str = "base", found_name: str = "found") -> DataFrame:
    """docs (text as string) with columns of these names: sorted arrays of struct(start, kind, end), end exclusive.

    Base spans are the leftmost non-overlapping matches of each kind that are long enough; kinds may overlap each other. found has
    the entropy scan's as well. Null and empty texts have none. Columns that have the names already are replaced; rows are neither added nor dropped.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    value = lambda s: F.length(F.regexp_extract(s, ASSIGN, 1))
    base = F.concat(
        _spans(_found(text, ASSIGN), "assign", lambda x: value(x.s) >= LEAST_ASSIGN),
        _spans(_found(text, ACCESS), "access", lambda x: F.length(x.s) >= LEAST_ACCESS),
        _spans(_found(text, HEX), "hex", lambda x: F.lit(True)),
    )
    both = let(F.sort_array(base), lambda b: F.struct(b.alias("base"), F.sort_array(F.concat(b, _entropy_spans(text, b))).alias("found")))
    rest = docs.drop(base_name, found_name)
    return rest.select("*", both.alias("__spans")).select(*rest.columns, F.col("__spans.base").alias(base_name), F.col("__spans.found").alias(found_name))


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    Null and empty texts have no spans; repeated rows each have a row; an empty table gives an empty table; other columns are ignored.
    """
    found = scan(ids_and_text(docs)).select("doc_id", "base", "found")
    many = lambda kind: F.size(F.filter("base", lambda x: x.kind == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(many, KINDS[:3]), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span of text replaced by the mask, spans that overlap as one.

    Null and empty texts stay as they are, equal texts are masked alike, other columns stay whatever their names, and an empty table stays empty.
    """

    def masked(text: Column, spans: Column) -> Column:
        def pieces(ends: Column) -> Column:
            """What comes before each span, with the mask unless the span goes on from those before it; and the rest."""

            def piece(x: Column, i: Column) -> Column:
                end = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
                return F.when(x.start < end, "").otherwise(F.concat(F.substring(text, end + 1, x.start - end), F.lit(mask)))

            return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, F.get(ends, F.size(ends) - 1) + 1, F.length(text)))

        return let(_running(F.transform(spans, lambda x: x.end), lambda a, x: F.greatest(a, x), F.lit(0)), pieces)

    new = F.when(F.size("__found") > 0, masked(F.col("text"), F.col("__found"))).otherwise(F.col("text"))
    return scan(docs, "__base", "__found").select(*(new.alias(c) if c == "text" else F.col(c) for c in docs.columns))
