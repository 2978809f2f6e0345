"""Spans of regular expressions with code point positions, from SQL functions alone.

Spark returns matches but not where they are.  ``regexp_extract_all`` and
``split`` find the same leftmost, non-overlapping matches, so the lengths of
the pieces between matches give every position.

SQL arrays cannot be appended to in place.  Running values are therefore taken
in chunks: the fold of each chunk, what stands before it, and then the values
inside, so that a text of many matches costs little more than one step a match.

Loops in patterns here are possessive where that changes no match: they then
run without recursion, and a run of characters is read once, however long.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,end:int,match:string,left:string>>"
#: Array elements that are folded one by one, by appending to a short array.
CHUNK = 128


def matches(text: Column, pattern: str) -> Column:
    """All matches of ``pattern``; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def nothing(gap: Column) -> Column:
    return F.lit(None).cast("string")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """``step`` folded over ``values`` up to and with each element: an array of ``kind`` as long as ``values``.

    ``step`` is associative with ``zero`` as its neutral element, over values of type ``kind``.
    """
    empty = F.array().cast(f"array<{kind}>")

    def inside(chunk: Column, before: Column) -> Column:
        def push(acc: Column, x: Column) -> Column:
            return bound(step(acc["at"], x), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out")))

        return F.aggregate(chunk, F.struct(before.alias("at"), empty.alias("out")), push, lambda acc: acc["out"])

    def of_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, step))
        return bound(totals, lambda t: F.flatten(F.transform(chunks, lambda c, i: inside(c, F.aggregate(F.slice(t, F.lit(1), i), zero, step)))))

    def of_values(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_), F.lit(CHUNK))
        return bound(F.transform(starts, lambda s: F.slice(all_, s, F.lit(CHUNK))), of_chunks)

    return bound(values, lambda all_: F.when(F.size(all_) > 0, of_values(all_)).otherwise(empty))


def locate(text: Column, patterns: Sequence[str], found: Sequence[Column], left: Callable[[Column], Column] = nothing) -> Column:
    """``found`` (see ``matches``) of each pattern with start, end (exclusive) and ``left`` of all text back to the match before.

    An array by pattern of arrays of spans; one expression serves all patterns.
    """

    def spans(x: Column) -> Column:
        steps = F.transform(x["pieces"], lambda p: F.length(p["match"]) + F.length(p["gap"]))
        ends = running(steps, F.lit(0), lambda a, b: a + b, "int")
        span = lambda p, e: F.struct((e - F.length(p["match"])).alias("start"), e.alias("end"), p["match"].alias("match"), left(p["gap"]).alias("left"))
        return F.zip_with(x["pieces"], ends, span)

    empty = F.array().cast("array<struct<match:string,gap:string>>")
    pieces = lambda p, m: F.zip_with(m, F.slice(F.split(text, p, -1), F.lit(1), F.size(m)), lambda a, g: F.struct(a.alias("match"), g.alias("gap")))
    return F.transform(F.array(*[F.struct(F.when(F.size(m) > 0, pieces(p, m)).otherwise(empty).alias("pieces")) for p, m in zip(patterns, found, strict=True)]), spans)


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``; both are arrays of ``struct<start, end, ...>``.

    Both are walked in order of their starts: a span is apart if all others that
    start before its end also end before its start.
    """
    def walk(events: Column) -> Column:
        # Others begin at their start; a span asks at its last character, so that all others that could overlap come before.
        reach = running(F.transform(events, lambda e: F.when(e["rank"] < 0, e["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b), "int")
        asked = F.filter(F.zip_with(events, reach, lambda e, r: F.struct(e["rank"].alias("rank"), (r <= e["start"]).alias("apart"))), lambda x: x["rank"] >= 0)
        return F.transform(F.array_sort(asked), lambda x: x["apart"])

    event = lambda s, at, rank: F.struct(at.alias("at"), rank.alias("rank"), s["start"].alias("start"), s["end"].alias("end"))
    events = F.concat(F.transform(others, lambda s: event(s, s["start"], F.lit(-1))), F.transform(spans, lambda s, i: event(s, s["end"] - 1, i)))
    kept = bound(F.array_sort(events), walk)
    flagged = F.zip_with(spans, kept, lambda s, k: F.struct(s.alias("span"), k.alias("kept")))
    thinned = F.transform(F.filter(flagged, lambda x: x["kept"]), lambda x: x["span"])
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(thinned)


def tagged(spans: Column, kind: int) -> Column:
    """Spans as ``struct<start, kind, end>``, which sort by start and then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def joined(tags: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of sorted tags, comma-joined; an empty string for none."""
    names = F.array(*[F.lit(k) for k in kinds])
    text = F.transform(F.array_sort(tags), lambda t: F.concat(F.element_at(names, t["kind"] + 1), F.lit(":"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string")))
    return F.concat_ws(",", text)
