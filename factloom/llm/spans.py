"""Regular-expression matches with their places, in DataFrame functions alone.

The matches of a pattern are what regexp_extract_all returns, and the texts between them are what split on the same pattern returns;
running lengths of both give every match's place in code points. Nothing here takes more than about linear time in the matches and the length of one text. The patterns below find the same matches as the plain ones
in their comments, in linear time and without recursion on long runs (possessive quantifiers, and a
start only where a run starts or the last match ended).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,rank:int,start:int,end:int,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def with_matches(df: DataFrame, text: str, kinds: list[tuple[str, str, Column | None, Callable[[Column], Column]]]) -> DataFrame:
    """df with a SPAN column named after each kind: its leftmost non-overlapping matches that pass. kinds: (name, pattern, a cheap
    condition that any matching text meets or None, the test of a match). text is not null."""
    found = {f"__{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) if when is None else F.when(when, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p, when, _ in kinds}
    df = df.withColumns(found)
    df = df.withColumns({f"__{k}_gaps": F.when(F.size(f"__{k}") > 0, F.split(text, p, -1)) for k, p, _, _ in kinds})
    return df.withColumns({k: _placed(F.col(f"__{k}"), F.col(f"__{k}_gaps"), k, i, test) for i, (k, _, _, test) in enumerate(kinds)}).drop(*found, *(f"{x}_gaps" for x in found))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


#: Elements that running() adds up by appending; longer arrays are cut into blocks of so many, and the blocks' totals again.
BLOCK = 64


def running(numbers: Column, add: Callable[[Column, Column], Column], depth: int = 2) -> Column:
    """The totals of the array numbers up to each element, by the associative add. With the blocks' totals taken the same way an element is copied
    BLOCK / 2 times or so, however many there are."""
    step = lambda acc, x: F.concat(acc, F.array(F.coalesce(add(F.try_element_at(acc, F.lit(-1)), x), x)))
    plain = lambda part: F.aggregate(part, F.array().cast("array<int>"), step)
    if not depth:
        return plain(numbers)
    places = lambda a: F.sequence(F.lit(0), F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / BLOCK).cast("int"))
    parts = let(numbers, lambda a: F.transform(places(a), lambda i: plain(F.slice(a, i * BLOCK + 1, F.lit(BLOCK)))))
    totals = lambda ps: running(F.transform(ps, lambda p: F.try_element_at(p, F.lit(-1))), add, depth - 1)
    onto = lambda ps, ts: F.transform(ps, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: add(F.get(ts, i - 1), x))))
    return F.flatten(let(parts, lambda ps: let(totals(ps), lambda ts: onto(ps, ts))))


def _placed(found: Column, gaps: Column, kind: str, rank: int, test: Callable[[Column], Column]) -> Column:
    ends = running(F.zip_with(found, gaps, lambda m, g: F.length(g) + F.coalesce(F.length(m), F.lit(0))), lambda a, b: a + b)
    span = lambda m, e: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))
    placed = F.zip_with(found, ends, lambda m, e: F.when(m.isNotNull() & test(m), span(m, e)))
    return F.when(F.size(found) > 0, F.filter(placed, lambda s: s.isNotNull()).cast(SPAN)).otherwise(no_spans())


#: Characters of a chunk of a text. A place of a chunk is found in time that does not depend on the text's length.
CHUNK = 1024


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def chunk_of(at: Column) -> Column:
    return F.floor(at / CHUNK).cast("int")


def text_before(parts: Column, at: Column, size: int) -> Column:
    """size characters (CHUNK at most) that end before the place at of a text in chunks, or as many as there are."""
    i = chunk_of(at)
    upto = at - F.greatest(i - 1, F.lit(0)) * CHUNK
    both = F.concat(F.coalesce(F.get(parts, i - 1), F.lit("")), F.coalesce(F.get(parts, i), F.lit("")))
    return F.substring(both, F.greatest(upto - (size - 1), F.lit(1)), F.least(upto, F.lit(size)))


def text_after(parts: Column, at: Column, size: int) -> Column:
    """size characters (CHUNK at most) from the place at on, or as many as there are."""
    i = chunk_of(at)
    both = F.concat(F.coalesce(F.get(parts, i), F.lit("")), F.coalesce(F.get(parts, i + 1), F.lit("")))
    return F.substring(both, at - i * CHUNK + 1, F.lit(size))


def text_between(parts: Column, start: Column, end: Column) -> Column:
    """The characters from start to before end of a text in chunks."""
    i = chunk_of(start)
    return F.substring(F.array_join(F.slice(parts, i + 1, chunk_of(end) - i + 1), ""), start - i * CHUNK + 1, end - start)


def disjoint(spans: Column) -> Column:
    """(start, end) by start of what spans cover, none reaching into another."""
    inorder = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    cut = lambda s, ends: F.transform(s, lambda x, i: F.struct(F.greatest(x["start"], F.get(ends, i - 1)).alias("start"), x["end"].alias("end")))
    every = let(inorder, lambda s: let(running(F.transform(s, lambda x: x["end"]), F.greatest), lambda ends: cut(s, ends)))
    return F.filter(every, lambda x: x["end"] > x["start"])


#: Steps of a binary search in an array of any size.
STEPS = [1 << k for k in range(30, -1, -1)]


def count_first(items: Column, holds: Callable[[Column], Column]) -> Column:
    """How many items of an array, on whose first ones alone holds is true, these are."""
    further = lambda n, step: (n + step <= F.size(items)) & holds(F.get(items, (n + step - 1).cast("int")))
    return F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda n, step: F.when((step <= F.size(items)) & further(n, step), n + step).otherwise(n))


def covered(parts: Column, spans: Column, mask: str) -> Column:
    """The chunks parts of a text with mask for each character that spans cover."""

    def one(part: Column, i: Column, inorder: Column) -> Column:
        low = i * CHUNK
        first, past = count_first(inorder, lambda s: s["end"] <= low), count_first(inorder, lambda s: s["start"] < low + CHUNK)
        start, end = lambda s: F.greatest(s["start"] - low, F.lit(0)), lambda s: F.least(s["end"] - low, F.length(part))
        put = lambda t, s: F.overlay(t, F.repeat(F.lit(mask), end(s) - start(s)), start(s) + 1, end(s) - start(s))
        return F.aggregate(let(first, lambda n: F.slice(inorder, n + 1, past - n)), part, put)

    return let(disjoint(spans), lambda inorder: F.transform(parts, lambda part, i: one(part, i, inorder)))


def clear_of(items: Column, spans: Column) -> Column:
    """Those of items that no span overlaps."""
    apart = lambda t, inorder: count_first(inorder, lambda s: s["end"] <= t["start"]) == count_first(inorder, lambda s: s["start"] < t["end"])
    return F.when((F.size(items) == 0) | (F.size(spans) == 0), items).otherwise(let(disjoint(spans), lambda inorder: F.filter(items, lambda t: apart(t, inorder))))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then rank, comma-joined."""
    inorder = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(inorder, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
