r"""Secret scan (operator 2), with DataFrame functions alone.

Base kinds are regular expressions, leftmost and non-overlapping per kind, over whole texts; failing
matches are dropped after matching. The entropy kinds come from candidate strings: maximal runs of key
characters with digits and letters of both cases, and maximal runs of letters and digits, each with the
threshold of its character class, so '/', '_', '=' and '+' end the latter. The counts of a window's characters are kept up while it slides, one entering and one
leaving at each step, and the window's Shannon entropy follows from the sum of c*log2(c). Windows that touch
a match of the allow-list are suppressed; base spans never are. A span is a stretch that hot windows cover without a
gap, so keys with a placeholder or cold characters between them are spans of their own. A span inside that of a longer
run is part of it.

Positions are code points, end exclusive. Spark gives matches without positions; they follow from the
lengths of what ``split`` leaves between them.

Defined results: null text is empty text (no spans, the hash of the empty string); a null doc_id stays
null; repeated rows each get a row; other columns, of any name, are ignored by the scan and kept by ``redact``.
A text of megabytes or a single run of that length takes a few steps a character.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import fresh_name

# The base kinds in the order of the output.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_mixed", "entropy_lower", "entropy_upper", "entropy_letters"]


def _series(first: str, rest: str) -> str:
    """A series and as much of what follows in it as is there."""
    tail = ""
    for ch in reversed(rest):
        tail = f"(?:{ch}{tail})?"
    return first + tail


@dataclass(frozen=True)
class EntropyRule:
    """window: characters; least_bits: entropy of a window that is reported, by character class."""

    window: int = 20
    least_bits: dict[str, float] = field(default_factory=lambda: {"entropy_hex": 3.0, "entropy_mixed": 3.7, "entropy_lower": 3.6, "entropy_upper": 3.5, "entropy_letters": 3.85})
    #: Windows that touch a match are not reported: placeholders, alphabets, digits in order.
    allow: str = rf"(?i)example|sample|dummy|placeholder|changeme|x{{6,}}|{_series('abcdefgh', 'ijklmnopqrstuvwxyz')}|{_series('01234567', '89')}|{_series('12345678', '90')}|wjalrxutnfemi"


_KEY = r"A-Za-z0-9+/_="
#: Maximal runs of key characters with a digit, letters of both cases and one that is no hex digit.
RUN = rf"(?<![{_KEY}])(?=[{_KEY}]{{20}})(?=[{_KEY}]*[g-zG-Z+/_=])(?=[{_KEY}]*[0-9])(?=[{_KEY}]*[A-Z])(?=[{_KEY}]*[a-z])[{_KEY}]+"
#: Maximal runs of letters and digits with a letter.
PIECE = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]{20})(?=[0-9]*[A-Za-z])[A-Za-z0-9]+"
#: Character classes of pieces, the first that fits; others are entropy_mixed.
CLASSES = {"entropy_letters": "^[A-Za-z]+$", "entropy_hex": "^[0-9a-fA-F]+$", "entropy_lower": "^[0-9a-z]+$", "entropy_upper": "^[0-9A-Z]+$"}
#: Matches whose places are summed at once.
BLOCK = 256
#: Runs that begin as image data do, in Base64; the hot span may begin later.
IMAGE = "(?i)^ivborw0kggo"


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches.

    Starts are running sums of what lies between and in the matches before, in blocks of ``BLOCK``, so that
    many matches do not cost their square.
    """
    spans = "array<struct<start:int,end:int,value:string>>"
    empty = F.lit([]).cast(spans)

    def step(state: Column, x: Column) -> Column:
        return _let(state["at"] + x["before"], lambda a: F.struct((a + F.length(x["value"])).alias("at"), F.concat(state["spans"], F.array(F.struct(a.alias("start"), (a + F.length(x["value"])).alias("end"), x["value"].alias("value")))).alias("spans")))

    def block(xs: Column) -> Column:
        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)

    def shifted(b: Column, by: Column) -> Column:
        return F.transform(b["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    def joined(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: b["at"])
        bases = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<int>").alias("bases")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["bases"], F.array(s["at"])).alias("bases")), lambda s: s["bases"])
        return F.flatten(F.zip_with(blocks, bases, shifted))

    def paired(found: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), F.length)
        return F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, v: F.struct(b.alias("before"), v.alias("value")))

    def cut(pairs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK))
        return _let(F.transform(firsts, lambda a: block(F.slice(pairs, a, F.lit(BLOCK)))), joined)

    return F.when(text.rlike(pattern), _let(paired(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), cut)).otherwise(empty)


def _as_spans(located: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(located, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def masked(value: Column, allow: str) -> Column:
    """The value with every character of a match of ``allow`` replaced by NUL."""
    put = lambda v, m: F.overlay(v, F.repeat(F.lit("\x00"), m["end"] - m["start"]), m["start"] + 1, m["end"] - m["start"])
    return F.when(value.rlike(allow), F.aggregate(_located(value, allow), value, put)).otherwise(value)


def window_spans(value: Column, window: int, least: Column | float) -> Column:
    """array<struct<lo, hi>>: the stretches that windows with enough entropy and without a NUL cover, from left to right.

    The counts of the window's characters are one string of 128 counters, a character each; a step changes
    the counter of the character that enters and that of the one that leaves, and the sum of c*log2(c) by
    what these two changes add and take.
    """
    none = F.lit("\x01" * 128)  # the counter of character k is at string position k + 1; \x01 is count 0
    grows = F.lit([(c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    empty = F.lit([]).cast("array<struct<lo:int,hi:int>>")

    def counter(counts: Column, ch: Column) -> Column:
        return F.ascii(F.substring(counts, ch + 1, F.lit(1)))

    def put(counts: Column, ch: Column, c: Column) -> Column:
        return F.overlay(counts, F.char(c), ch + 1, F.lit(1))

    def with_last(s: Column) -> Column:
        return F.when(s["hi"] > 0, F.concat(s["spans"], F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))).otherwise(s["spans"])

    def run(chars: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            entering, leaving = F.get(chars, i), F.get(chars, i - window)
            c_in, c_out = counter(s["counts"], entering), counter(s["counts"], leaving)
            grown, more = put(s["counts"], entering, c_in + 1), s["total"] + F.get(grows, c_in - 1)
            # The two changes touch different counters, or undo each other.
            counts = F.when(i < window, grown).when(entering == leaving, s["counts"]).otherwise(put(grown, leaving, c_out - 1))
            total = F.when(i < window, more).when(entering == leaving, s["total"]).otherwise(more - F.get(grows, c_out - 2))
            # The window that the step before has completed begins at i - window; it goes on with the last stretch if it touches it.
            hot = (i >= window) & (F.log2(F.lit(float(window))) - s["total"] / window >= least) & (counter(s["counts"], F.lit(0)) == 1)
            fresh = hot & (i - window > s["hi"])
            return F.struct(
                counts.alias("counts"), total.alias("total"), F.when(fresh | (hot & (s["hi"] == 0)), i - window).otherwise(s["lo"]).alias("lo"), F.when(hot, i).otherwise(s["hi"]).alias("hi"),
                F.when(fresh, with_last(s)).otherwise(s["spans"]).alias("spans"),
            )

        start = F.struct(none.alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), empty.alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars)), start, step, with_last)

    return _let(F.transform(F.split(value, ""), F.ascii), run)


def _hot(candidates: Column, kind: Callable[[Column], Column], rule: EntropyRule) -> Column:
    """array<struct<start, k, end>> of the candidates' hot stretches."""
    least = F.lit([rule.least_bits.get(k, 99.0) for k in KINDS])  # a class without a threshold has no hot window

    def scored(s: Column) -> Column:
        k = F.struct(kind(s["value"]).alias("k"), F.get(least, kind(s["value"])).alias("least"))
        span = lambda k, r: F.struct((s["start"] + r["lo"]).alias("start"), k["k"].alias("k"), (s["start"] + r["hi"]).alias("end"))
        return _let(k, lambda k: F.transform(window_spans(masked(s["value"], rule.allow), rule.window, k["least"]), lambda r: span(k, r)))

    return F.flatten(F.transform(F.filter(candidates, lambda s: ~s["value"].rlike(IMAGE)), scored))


def _covered(p: Column, by: Column) -> Column:
    return F.exists(by, lambda r: (r["start"] <= p["start"]) & (p["end"] <= r["end"]))


def _class(value: Column) -> Column:
    out = F.lit(KINDS.index("entropy_mixed"))
    for kind, pattern in reversed(CLASSES.items()):
        out = F.when(value.rlike(pattern), F.lit(KINDS.index(kind))).otherwise(out)
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, found: str, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """``docs`` with a column ``found``: struct<base, spans>, arrays of struct<start, k, end>, sorted."""
    text = F.coalesce(docs["text"], F.lit(""))
    assign = F.filter(_located(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    # A run of the class starts at its first character, so the least length can be part of these two patterns.
    access = _located(text, rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
    hexes = _located(text, rf"[0-9a-f]{{{HEX_LEAST},}}")
    parts = {"assign": _as_spans(assign, "assign"), "access": _as_spans(access, "access"), "hex": _as_spans(hexes, "hex"), "run": _located(text, RUN), "piece": _located(text, PIECE)}
    at = {k: fresh_name(k) for k in (*parts, "image", "run_hot", "piece_hot")}
    out = docs.withColumns({at[k]: v for k, v in parts.items()})
    out = out.withColumns({at["run_hot"]: _hot(F.col(at["run"]), lambda _: F.lit(KINDS.index("entropy_mixed")), rule), at["image"]: F.filter(at["run"], lambda s: s["value"].rlike(IMAGE))})
    # Pieces of image data are image data; those inside a hot run are part of it.
    pieces = F.filter(at["piece"], lambda p: ~_covered(p, F.col(at["image"])) & ~_covered(p, F.col(at["run_hot"])))
    out = out.withColumn(at["piece_hot"], _hot(pieces, _class, rule))
    more = F.filter(at["piece_hot"], lambda p: ~_covered(p, F.col(at["run_hot"])))
    base = F.array_sort(F.concat(at["assign"], at["access"], at["hex"]))
    out = out.withColumn(found, F.struct(base.alias("base"), F.array_sort(F.concat(at["assign"], at["access"], at["hex"], at["run_hot"], more)).alias("spans")))
    return out.drop(*at.values())


def secret_scan(docs: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans: one row per document."""
    found = fresh_name("found")
    out = with_spans(docs.select("doc_id", "text"), found, rule)
    base, spans = F.col(found)["base"], F.col(found)["spans"]
    count = lambda k: F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), sum((count(k) for k in range(4, len(KINDS))), count(3)).alias("n_entropy"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def redact(docs: DataFrame, rule: EntropyRule = EntropyRule(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` (overlapping spans by one), and n_chars set anew where there is one."""
    columns, found = docs.columns, fresh_name("found")
    text = docs["text"]
    none = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<string>").alias("out"))

    def cut(chars: Column, spans: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            gap = F.array_join(F.slice(chars, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0))), "")
            fresh_mark = F.when((s["start"] >= state["at"]) | (F.size(state["out"]) == 0), F.lit(mark)).otherwise(F.lit(""))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], F.array(F.concat(gap, fresh_mark))).alias("out"))

        return F.aggregate(spans, none, step, lambda s: F.concat(F.array_join(s["out"], ""), F.array_join(F.slice(chars, s["at"] + 1, F.size(chars)), "")))

    out = with_spans(docs, found, rule)
    spans = F.col(found)["spans"]
    out = out.withColumn("text", F.when(F.size(spans) > 0, _let(F.split(text, ""), lambda chars: cut(chars, spans))).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast("long"))
    return out.select(*columns)
