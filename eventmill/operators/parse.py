"""Lines of text to event records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.json_text import strict_record, strip_space
from eventmill.functions.once import kept, let

# Line lengths at which loggers were seen to cut lines (for `cut_lengths`), and the endings that complete a
# cut line.
CUT_LENGTHS = [(32000, 32999), (9980, 10000), (2039, 2043)]
ENDINGS = ["", "}", '"}', '""}', '"}}', '"}}}', '"}}}}', '"}}}}}', '"}}}}}}']


def _line(text: Column) -> Column:
    # most lines have nothing to strip, and two looks tell
    return let(text, lambda t: F.when(t.startswith("{") & t.endswith("}"), t).otherwise(strip_space(t)))


def _some(record: Column, least: int = 1) -> Column:
    """Array of the record, empty when there is none or it has too few entries."""
    return F.filter(F.array(record), lambda r: r.isNotNull() & (F.size(r) >= least))


def parse_events(
    df: DataFrame, column: str = "value", cut_lengths: Sequence[tuple[int, int]] = (), keep_empty: bool = False
) -> DataFrame:
    """Replace the text column by `rec`; drops lines that are no JSON object or, unless kept, are an empty one.

    A line that was cut is no JSON object. `cut_lengths` (off, or `CUT_LENGTHS`) also drops lines of suspicious lengths
    unseen, whole ones too.
    """

    def parse(line: Column) -> Column:
        cut = reduce(or_, [F.length(line).between(low, high) for low, high in cut_lengths], F.lit(False))
        return F.when(line.startswith("{") & ~cut, strict_record(line))

    return kept(df, "rec", _some(let(_line(F.col(column)), parse), 0 if keep_empty else 1)).drop(column)


def repair_events(df: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """Like `parse_events`, but completes cut lines; lines beyond repair are dropped, or fail when strict."""

    def parse(line: Column) -> Column:
        record = _repaired(line)
        if strict:
            failed = F.raise_error(F.concat(F.lit("line beyond repair: "), line)).cast("map<string,variant>")
            record = F.coalesce(record, failed)
        return F.when(line.startswith("{"), record)

    return kept(df, "rec", _some(let(_line(F.col(column)), parse))).drop(column)


def beyond_repair(df: DataFrame, column: str = "value") -> DataFrame:
    """The lines that look like objects and that no ending completes."""
    lines = let(
        _line(F.col(column)),
        lambda line: F.when(line.startswith("{"), F.filter(F.array(line), lambda v: _repaired(v).isNull())),
    )
    return kept(df, column, lines)


def _repaired(line: Column) -> Column:
    return F.coalesce(*[strict_record(F.concat(line, F.lit(end))) for end in ENDINGS])
