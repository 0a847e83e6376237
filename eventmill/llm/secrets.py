"""Secret scan: fixed patterns, and sliding-window entropy of candidate strings with an allow-list.

Everything is a column expression: no shuffle, no Python, and a row's result depends on its text alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.once import let
from eventmill.llm.common import fresh, text_of


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(k) for k in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
# These find the same as a pattern without a least length whose shorter matches are dropped: a run that is too short
# holds no match that is long enough.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

KINDS = ("assign", "access", "hex", "entropy64", "entropy16", "entropy36", "entropy32")
BASE = KINDS[:3]

SPAN = "struct<kind:int,start:bigint,end:bigint>"


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of `members` at least `window` long that hold a character of each of `needs`.

    A window of `window` characters is suspicious when the Shannon entropy of its characters is at least `bits`.
    """

    kind: str
    alphabet: str
    members: str
    window: int
    bits: float
    needs: tuple[str, ...]

    @property
    def table(self) -> list[int]:
        """n * log2(n) for n from 0 to the window, in whole 2**-20 bits, so that sums are exact in any order."""
        return [0] + [round(n * math.log2(n) * 2**20) for n in range(1, self.window + 1)]

    @property
    def bound(self) -> int:
        """Entropy is at least `bits` when the sum of n * log2(n) over the character counts is at most this."""
        return math.floor((math.log2(self.window) - self.bits) * self.window * 2**20)


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("entropy64", _LOWER.upper() + _LOWER + _DIGITS + "+/_=-", "A-Za-z0-9+/_=-", 20, 3.85, ("[a-z]", "[A-Z]", "[0-9]")),
    CharacterClass("entropy16", _DIGITS + "ABCDEFabcdef", "0-9A-Fa-f", 32, 3.0, ("[0-9]", "[A-Fa-f]")),
    CharacterClass("entropy36", _LOWER + _DIGITS, "a-z0-9", 20, 3.7, ("[a-z]", "[0-9]")),
    CharacterClass("entropy32", _LOWER.upper() + _DIGITS, "A-Z0-9", 20, 3.7, ("[A-Z]", "[0-9]")),
)

#: A candidate that matches one of these is no secret: UUIDs, paths of plain words, the rest of a key from manuals. Groups
#: that repeat are possessive: otherwise a long path takes a stack frame for each of its parts.
ALLOWED = (
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^[/=]?[A-Za-z]+[0-9]*(?:[-/_=]+(?:[A-Za-z]+[0-9]*|[0-9]+))++[-/_=]*$",
    "^wJalrXUtnFEMI/K7MDENG/bPxRfiCY$",
)
#: Alphabets and sample words, by length. They part candidates: what is glued to one is measured without it.
SAMPLES = {10: "ABCDEFGHIJ|abcdefghij|0123456789", 7: "EXAMPLE|example"}


def without_samples(text: Column) -> Column:
    """The text with blanks in place of the sample words; positions stay."""
    for size, words in SAMPLES.items():
        text = F.regexp_replace(text, words, " " * size)
    return text


def _running(lengths: Column) -> Column:
    """Sums of all elements up to each one; in pieces, so that long arrays cost little more than their length."""
    piece = 128
    pieces = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(piece)), lambda i: F.slice(lengths, i + 1, piece))

    def inner(state: Column, x: Column) -> Column:
        total = state["t"] + x
        return F.struct(total.alias("t"), F.concat(state["a"], F.array(total)).alias("a"))

    def outer(state: Column, part: Column) -> Column:
        start = F.struct(state["t"].alias("t"), F.array().cast("array<bigint>").alias("a"))
        return let(
            F.aggregate(part, start, inner),
            lambda r: F.struct(r["t"].alias("t"), F.concat(state["a"], F.array(r["a"])).alias("a")),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("t"), F.array().cast("array<array<bigint>>").alias("a"))
    return F.flatten(F.aggregate(pieces, start, outer)["a"])


def _found(text: Column, pattern: str) -> Column:
    """Matches as array of struct<start, value>, positions in code points; empty mostly."""
    none = F.array().cast("array<struct<start:bigint,value:string>>")

    def placed(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
        return F.zip_with(
            _running(lengths), matches, lambda end, m: F.struct((end - F.length(m)).alias("start"), m.alias("value"))
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m))
    )


def _spans(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end")
        ),
    )


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns: each kind leftmost and without overlap, then without those that are too short."""
    value = f"^{ASSIGN}$"
    assigned = F.filter(_found(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], value, 2)) >= ASSIGN_VALUE)
    found = F.concat(_spans(assigned, "assign"), _spans(_found(text, ACCESS), "access"), _spans(_found(text, HEX), "hex"))
    return found.cast(f"array<{SPAN}>")


def hot_windows(value: Column, group: CharacterClass) -> Column:
    """Stretches of a candidate that suspicious windows cover: array of struct<from, to>, end exclusive.

    The character counts of the window go from one position to the next: one count up, one down, and the sum of
    n * log2(n) changes by two table entries.
    """
    table = F.array(*[F.lit(n).cast("bigint") for n in group.table])
    width = group.window
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(group.alphabet), c) - 1)

    def scan(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            gone = F.when(i >= width, F.get(codes, i - width)).otherwise(F.lit(-1))
            come = F.get(codes, i)

            def counted(c: Column, g: Column) -> Column:
                up = F.get(state["n"], c)
                less = F.when(g >= 0, F.get(state["n"], g)).otherwise(F.lit(0))
                change = F.when(c == g, F.lit(0)).otherwise(
                    F.get(table, up + 1) - F.get(table, up) + F.when(g >= 0, F.get(table, less - 1) - F.get(table, less)).otherwise(F.lit(0))
                ).cast("bigint")
                counts = F.transform(
                    state["n"], lambda x, k: x + F.when(k == c, F.lit(1)).otherwise(F.lit(0)) - F.when(k == g, F.lit(1)).otherwise(F.lit(0))
                )
                return let(state["s"] + change, lambda s: marked(counts, s))

            def marked(counts: Column, s: Column) -> Column:
                hot = (i >= width - 1) & (s <= group.bound)
                joins = state["to"] >= i - (width - 1)
                closes = hot & ~joins & (state["to"] > 0)
                closed = F.array(F.struct(state["from"].alias("from"), state["to"].alias("to")))
                return F.struct(
                    counts.alias("n"),
                    s.alias("s"),
                    F.when(hot & ~joins, i - (width - 1)).otherwise(state["from"]).alias("from"),
                    F.when(hot, i + 1).otherwise(state["to"]).alias("to"),
                    F.when(closes, F.concat(state["out"], closed)).otherwise(state["out"]).alias("out"),
                )

            return let(F.struct(come.alias("c"), gone.alias("g")), lambda x: counted(x["c"], x["g"]))

        start = F.struct(
            F.array_repeat(F.lit(0), len(group.alphabet)).alias("n"),
            F.lit(0).cast("bigint").alias("s"),
            F.lit(-1).alias("from"),
            F.lit(-1).alias("to"),
            F.array().cast("array<struct<from:int,to:int>>").alias("out"),
        )
        last = F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step)
        return let(
            last,
            lambda s: F.when(
                s["to"] > 0, F.concat(s["out"], F.array(F.struct(s["from"].alias("from"), s["to"].alias("to"))))
            ).otherwise(s["out"]),
        )

    return let(codes, scan)


def entropy_spans(text: Column, group: CharacterClass, allowed: Sequence[str] = ALLOWED) -> Column:
    """Spans of suspicious stretches in candidates that the allow-list does not know."""
    run = rf"(?<![{group.members}])[{group.members}]{{{group.window},}}"

    def suspicious(m: Column) -> Column:
        keep = F.lit(True)
        for need in group.needs:
            keep = keep & m["value"].rlike(need)
        for known in allowed:
            keep = keep & ~m["value"].rlike(known)
        return keep

    found = F.filter(_found(text, run), suspicious)
    return F.flatten(
        F.transform(
            found,
            lambda m: F.transform(
                hot_windows(m["value"], group),
                lambda w: F.struct(
                    F.lit(KINDS.index(group.kind)).alias("kind"),
                    (m["start"] + w["from"]).alias("start"),
                    (m["start"] + w["to"]).alias("end"),
                ),
            ),
        )
    ).cast(f"array<{SPAN}>")


def scan_secrets(
    df: DataFrame, column: str = "text", classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED
) -> DataFrame:
    """Add `base` and `spans`: arrays of struct<kind, start, end>, by start and then kind (a place in `KINDS`).

    Positions count code points, ends are exclusive. `base` holds what the fixed patterns find; `spans` holds these and
    the stretches of high entropy that lie in none of them. Texts and candidates of any length are scanned whole. NULL counts as the empty text and has no spans; an empty
    table gives an empty table; every row is looked at on its own, so ties and repeated rows do not matter. Columns of
    the input named `base` or `spans` are replaced.
    """
    text = text_of(df, column)
    (low,) = fresh(df, "_base")

    def ordered(spans: Column) -> Column:
        plain = F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))
        return F.transform(
            F.array_sort(plain), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        )

    found = df.withColumn(low, base_spans(text))
    measured = without_samples(text)
    more = F.concat(*[entropy_spans(measured, group, allowed) for group in classes])
    own = F.filter(more, lambda e: ~F.exists(F.col(low), lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("base", "spans")]
    return found.select(*kept, ordered(F.col(low)).alias("base"), ordered(F.concat(F.col(low), own)).alias("spans"))


def described(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact_secrets(df: DataFrame, column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace every span by the mask; overlapping spans become one. Texts without spans, NULL too, stay as they are."""
    scanned = scan_secrets(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).select("row", F.col(f"row.`{column}`").alias("text")))
    text = F.col("text")

    def piece(state: Column, s: Column) -> Column:
        open_ = s["start"] >= state["to"]
        return F.struct(
            F.when(
                open_,
                F.concat(state["out"], F.array(F.substring(text, (state["to"] + 1).cast("int"), (s["start"] - state["to"]).cast("int")))),
            ).otherwise(state["out"]).alias("out"),
            F.greatest(state["to"], s["end"]).alias("to"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("to"))
    clean = let(
        F.aggregate("spans", start, piece),
        lambda s: F.array_join(F.concat(s["out"], F.array(F.substring(text, (s["to"] + 1).cast("int"), F.length(text)))), mask),
    )
    new = F.when(F.size("spans") > 0, clean).otherwise(text)
    return scanned.select(*[new.alias(c) if c == column else F.col(f"row.`{c}`").alias(c) for c in df.columns])
