"""Spans of regular-expression matches as column expressions; nothing leaves the JVM.

The patterns are written so that the Java engine needs linear time and constant stack on any text: possessive
quantifiers where nothing after them could use a shorter match, and for runs of one character class a guard that
starts a match only at the beginning of the run or where the previous match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


#: Values that one pass of a running total takes; an array that grows by one value is copied each time.
_RUN = 64


def running(values: Column, combine, zero: int) -> Column:
    """Running totals of an array of longs under an associative ``combine``, in blocks, so that long arrays stay cheap."""

    def scan(part: Column) -> Column:
        empty = F.expr("cast(array() as array<long>)")
        grow = lambda acc, x: F.array_append(acc, combine(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(zero).cast("long")), x))
        return F.aggregate(part, empty, grow)

    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _RUN).cast("int"))
    blocks = F.transform(starts, lambda k: scan(F.slice(values, k * _RUN + 1, F.lit(_RUN))))
    long = F.aggregate(
        blocks,
        F.struct(F.lit(zero).cast("long").alias("total"), F.expr("cast(array() as array<long>)").alias("before")),
        lambda acc, block: F.struct(combine(acc["total"], F.try_element_at(block, F.lit(-1))).alias("total"), F.array_append(acc["before"], acc["total"]).alias("before")),
        lambda acc: F.flatten(F.zip_with(blocks, acc["before"], lambda block, at: F.transform(block, lambda x: combine(at, x)))),
    )
    return F.when(F.size(values) <= _RUN, scan(values)).otherwise(long)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points, end exclusive.

    ``text`` must not be null. The places come from the running total of the lengths of the pieces between the matches
    and of the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start:long,end:long,value:string>>)")
    lengths = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: (F.length(g) + F.length(m)).cast("long"))
    place = lambda m, end: F.struct((end - F.length(m)).cast("long").alias("start"), end.alias("end"), m.alias("value"))
    placed = F.zip_with(found, running(lengths, lambda a, b: a + b, 0), place)
    return F.when(F.size(found) > 0, placed).otherwise(empty)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figure = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(figure, F.lit(0), lambda a, b: a + b) % 10 == 0


def digest_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
