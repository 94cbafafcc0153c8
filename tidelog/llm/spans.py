"""Match positions from built-in functions alone.

Spark has no function that returns where all matches of a pattern stand, but
splitting a text at the matches gives what lies between them: the start of
match i is the length of pieces 0..i and of matches 0..i-1.  Lengths count code
points.  Patterns must not match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,value:string>>"
#: Every step of an aggregate copies its state, so matches are gathered in arrays of so many.
CHUNK = 256


def match_spans(text: Column, pattern: Column, value_group: int | Column = 0) -> Column:
    """Leftmost matches that don't overlap, as (start, stop, value) with the text of a group as value."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = hits if isinstance(value_group, int) and value_group == 0 else F.regexp_extract_all(text, pattern, F.lit(value_group))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"))), values, lambda p, v: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), v.alias("value")))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + p["size"]
        one = F.array(F.struct(begin.alias("start"), end.alias("stop"), p["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(SPAN)), one).alias("out"))

    def fill(ps: Column, at: Column) -> Column:
        begin = F.struct(at.alias("at"), F.lit(None).cast(SPAN).alias("out"))
        return F.aggregate(ps, begin, step, lambda acc: F.coalesce(acc["out"], F.array().cast(SPAN)))

    def whole(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda ps: F.aggregate(ps, F.lit(0), lambda n, p: n + p["gap"] + p["size"]))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), fill))

    def cut(ps: Column) -> Column:
        last = F.floor(F.greatest(F.size(ps) - 1, F.lit(0)) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(ps, c * CHUNK + 1, F.lit(CHUNK)))

    # One-element arrays name what is used more than once, so that it is made once for a text.
    return F.coalesce(F.flatten(F.transform(F.transform(F.array(parts), cut), whole)), F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")
