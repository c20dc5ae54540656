"""Places in texts: where a pattern matches, where comments stand, and which places lie inside them.

Everything is regular expressions, an explode and running sums over one sort by file, so the work grows with the text and with the number of
matches, and the texts are never shuffled. A file is named by (root_name, rel_path). Offsets count characters from 0, lines and columns
from 1; a file without content has no matches. Patterns repeat groups possessively (``*+``), which the JVM works off in a loop; other repeated groups
recurse there and end in an error on long texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = ["root_name", "rel_path"]
PLACE = ["start", "end", "line", "column"]
#: Comments and strings as a state machine over the text: whichever opens first holds until it closes, or to the end. A string goes on over lines and
#: a backslash in it takes the next character along; /*/ is a whole comment.
_STRINGS = [rf"{q}(?:[^{q}\\]|\\[\s\S])*+\\?(?:{q}|\z)" for q in "'\"`"]
SLASH_TOKENS = "|".join([r"/\*(?:/|[\s\S]*?(?:\*/|\z))", r"//[^\n]*", *_STRINGS])
HASH_TOKENS = SLASH_TOKENS + r"|#[^\n]*"


def ascii_boundaries(pattern: str) -> str:
    r"""The pattern with \b as ASCII looks at one side, which its place gives away: the end of a word before the end, white space or a set, its
    start elsewhere. (The JVM's own goes by Unicode letters, and looking at both sides at every place is slow.)"""
    return re.sub(r"\\b(?=(\\s|\[|$)?)", lambda m: r"(?!\w)" if m[1] is not None else r"(?<!\w)", pattern)


def _lines(text: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))


def placed(found: DataFrame, by: list[str]) -> DataFrame:
    """found(*by, pos, gap, match, ...) with start, end, line and column in place of pos and gap: the texts before and in the matches, added up."""
    w = Window.partitionBy(*by).orderBy("pos")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rest = [c for c in found.columns if c not in ("pos", "gap", *by)]  # the match among them
    tail = lambda text: F.length(F.substring_index(text, "\n", -1))
    sized = found.select(
        *by, "pos", *rest, F.length("gap").cast("long").alias("__g"), F.length("match").cast("long").alias("__m"), _lines("gap").cast("long").alias("__g_lines"), _lines("match").cast("long").alias("__m_lines"),
        tail("gap").cast("long").alias("__g_tail"), tail("match").cast("long").alias("__m_tail"),
    )
    at = sized.withColumns({"end": F.sum(F.col("__g") + F.col("__m")).over(upto), "line": F.sum(F.col("__g_lines") + F.col("__m_lines")).over(upto) - F.col("__m_lines") + 1})
    at = at.withColumn("start", F.col("end") - F.col("__m"))
    own = F.when(F.col("__g_lines") > 0, F.col("start") - F.col("__g_tail"))  # where the match's line starts, if in the gap
    last = F.max(F.when(F.col("__m_lines") > 0, F.col("end") - F.col("__m_tail")).otherwise(own)).over(before)
    return at.withColumn("column", F.col("start") - F.coalesce(own, last, F.lit(0)) + 1).select(*by, *PLACE, *rest)


def pieces(text: Column, pattern: str) -> Column:
    """array of struct(match, gap) of a text; the last has the rest of the text and no match."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)).cast("array<struct<match:string,gap:string>>")


def locate(files: DataFrame, pattern: str, groups: tuple[str, ...] = (), ahead: int = 0, more: dict[str, Column] | None = None) -> DataFrame:
    """(root_name, rel_path, start, end, line, column, match, *groups, before) of every match of the pattern in files(root_name, rel_path, content). groups names the pattern's groups
    in order, which are read from the match alone (an absent one is empty); before is the text since the match before, its last 24 characters, ahead, if wanted, so many
    characters after the match, and more what is made of these columns (match, gap, ahead) where the text is read. Only columns that are used later are shuffled: name in more what is wanted of
    long matches."""
    pattern, text = ascii_boundaries(pattern), F.col("content")
    zipped = pieces(text, pattern)
    if ahead:
        after = F.regexp_extract_all(text, F.lit(rf"(?:{pattern})(?=([\s\S]{{0,{ahead}}}))"), F.lit(len(groups) + 1))
        zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), after).cast("array<struct<match:string,gap:string,ahead:string>>")
    found = files.select(*FILE, F.posexplode(zipped).alias("pos", "x")).select(*FILE, "pos", "x.*").where("match is not null")
    named = [F.regexp_extract("match", pattern, i + 1).alias(g) for i, g in enumerate(groups)]
    return placed(found.select(*FILE, "pos", "gap", "match", *named, F.right("gap", F.lit(24)).alias("before"), *(["ahead"] if ahead else []), *(c.alias(n) for n, c in (more or {}).items())), FILE)


def comments(files: DataFrame, hash_comments: bool = True) -> DataFrame:
    """(root_name, rel_path, start, end) of every comment: block, //, and # where that starts one; never inside strings."""
    found = locate(files, HASH_TOKENS if hash_comments else SLASH_TOKENS, more={"is_comment": F.left("match", F.lit(1)).isin("/", "#")})
    return found.where("is_comment").select(*FILE, "start", "end")


def outside(places: DataFrame, spans: DataFrame) -> DataFrame:
    """The places(root_name, rel_path, start, ...) of which no span(root_name, rel_path, start, end) holds the start: a running maximum of the ends over
    both by start, in place of a join on ranges."""
    both = places.withColumns({"__at": F.col("start"), "__end": F.lit(None).cast("long")}).unionByName(spans.select(*FILE, F.col("start").alias("__at"), F.col("end").alias("__end")), allowMissingColumns=True)
    upto = Window.partitionBy(*FILE).orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__held", F.max("__end").over(upto)).where("__end is null and not coalesce(__held > __at, false)").select(*places.columns)
