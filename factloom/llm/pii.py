"""Personal data: pattern matches, and identifiers found by bootstrapped contextual extraction, in DataFrame functions alone.

Base matches (e-mail, IP, payment card, phone) are the seeds. The parts of text around a seed are lexical patterns, whatever the seed looks
like: two before it (L), one before and one after it (LR), two before and one after it (LLR). What stands in the same place of any text is an
instance of the pattern: a part, or a run of parts with digits, and for LLR each run of up to ``MOST`` parts, with digits or
without. On the graph of patterns and instances a pattern's confidence is the smoothed mean score of its distinct instances and an instance's score
that of its best accepted pattern (1 for seeds), in ``rounds`` rounds; a pattern is accepted with ``min_seeds`` distinct
seeds and ``min_confidence``. Instances of accepted patterns that no base match covers are added as ``found_<kind>``, without those inside
others. Only patterns with ``min_seeds`` distinct seeds can be accepted, so only their instances are gathered.

Defined cases: null and empty texts have no spans; rows that repeat an id are judged by their own text each, equal rows alike; a
null doc_id is kept; a token that is a seed of two kinds counts for the one listed first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_lookup, lower_ascii, materialize, text_hash
from .spans import chunks, count_kind, covered, joined, no_spans, running, text_after, text_before, text_between, with_matches

KINDS = ("email", "ip", "card", "phone")


def _byte_parts(m: Column) -> Column:
    """Dotted numbers of at most 255."""
    number = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(number(p)) < 3) | ((F.length(number(p)) == 3) & (number(p) <= "255")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column) -> Column:
    return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))


def base_kinds(text: str) -> list:
    return [
        # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
        ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", F.contains(text, F.lit("@")), lambda m: F.lit(True)),
        # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
        ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", F.contains(text, F.lit(".")), _byte_parts),
        # [0-9]([\x20-]?[0-9])+ with at least 14 digits
        ("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", None, _card),
        # \+[0-9][\x20().0-9-]+[0-9]
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", F.contains(text, F.lit("+")), lambda m: F.length(_digits(m)).between(10, 15)),
    ]


#: Characters of identifiers and of spaces. A part is a run of the former or of neither, with the spaces before it; base matches are masked.
ID, SPACE, MASK = r"\p{L}\p{M}\p{N}._%+@/\-", r"\x20\x09-\x0D", "\ue000"
PART = rf"[{SPACE}]*+(?:{MASK}++|[{ID}]++|[^{SPACE}{ID}{MASK}]++)"
#: Parts of an instance at most ("name [at] host [dot] com" has nine).
MOST = 9
BLANKS = " \t\n\x0b\f\r"
#: Bits of the table of hashes that rules out places without a pattern; a byte of the constant (an ASCII character) holds BITS of them.
SLOTS, BITS = 1 << 18, 6


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text, base SPAN); th names the text."""
    text = docs.select("doc_id", text_hash(), F.coalesce("text", F.lit("")).alias("__text"))
    return with_matches(text, "__text", base_kinds("__text")).select("doc_id", "th", F.col("__text").alias("text"), F.concat(*KINDS).alias("base"))


def masked_chunks() -> Column:
    """text in lower case, of the same length, with MASK for each character of a base match, in chunks."""
    return covered(chunks(lower_ascii(F.translate("text", MASK, "\ue001"))), F.col("base"), MASK)


def masked() -> Column:
    return F.when(F.size("base") > 0, F.array_join(masked_chunks(), "")).otherwise(lower_ascii(F.translate("text", MASK, "\ue001")))


def words_in(text: Column) -> Column:
    word = lambda p: F.ltrim(p, F.lit(BLANKS))
    return F.transform(F.regexp_extract_all(text, F.lit(PART), F.lit(0)), lambda p: F.when(word(p).startswith(MASK), MASK).otherwise(word(p)))


def seed_edges(base: DataFrame) -> DataFrame:
    """(value, kind, pattern, opening) of each base match; opening is what a place shows before the instance's end is known."""
    near = lambda s: F.struct(s["value"].alias("value"), s["rank"].alias("kind"), text_before(F.col("m"), s["start"], 200).alias("before"), text_after(F.col("m"), s["end"], 200).alias("after"))
    s = base.where(F.size("base") > 0).select("base", masked_chunks().alias("m")).select(F.inline(F.transform("base", near)))
    before, after = words_in(F.regexp_replace("before", f"[{ID}{MASK}]+$", "")), words_in(F.regexp_replace("after", f"^[{ID}{MASK}]+", ""))
    s = s.select(lower_ascii(F.col("value")).alias("value"), "kind", before.alias("b"), F.coalesce(F.get(after, F.lit(0)), F.lit("$")).alias("r"))
    last = lambda i: F.coalesce(F.try_element_at("b", F.lit(-i)), F.lit("^"))
    left, both = F.concat_ws(" ", F.lit("L"), last(2), last(1)), F.concat_ws(" ", F.lit("LR"), last(1), F.lit("_"), "r")
    pairs = [F.struct(p.alias("pattern"), o.alias("opening")) for p, o in ((left, left), (both, both), (F.concat_ws(" ", F.lit("LL"), left, F.lit("_"), "r"), left))]
    return s.select("value", "kind", F.explode(F.array(*pairs)).alias("p")).select("value", "kind", "p.*")


def slot(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(SLOTS)).cast("int")


def slots_taken(patterns: DataFrame) -> Column:
    """A constant of SLOTS bits: 1 where a pattern, its opening, or the first word of an LR opening falls."""
    left = F.regexp_extract("opening", "^(LR [^ ]*) ", 1)
    keys = F.array(slot(F.col("pattern")), slot(F.col("opening")), slot(F.when(left != "", left).otherwise(F.col("opening"))))
    bits = bytearray(SLOTS // BITS + 1)
    for r in patterns.select(F.explode(keys).alias("at")).distinct().collect():  # SLOTS numbers at most, however many patterns there are
        bits[r.at // BITS] |= 1 << r.at % BITS
    return F.lit(bits)


def instances(base: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, th, at, parts, value, pattern): what stands in a place of patterns(pattern, opening) and is no base match; at counts parts.
    What no pattern can have is left out where the text is read, by a fixed-size table of hashes; the join settles the rest."""
    bits = slots_taken(patterns)
    byte = lambda h: F.ascii(F.substring(bits, (h / BITS).cast("int") + 1, F.lit(1)).cast("string"))
    may = lambda *p: F.exists(F.array(slot(*p)), lambda h: F.getbit(byte(h), F.pmod(h, F.lit(BITS))) == 1)
    words = base.select("doc_id", "th", words_in(masked()).alias("w"))
    word = lambda i, none: F.coalesce(F.get(F.col("w"), i), F.lit(none))
    digit = lambda t: t.rlike("[0-9]")

    def run_at(i: Column) -> Column:
        """Parts of the run that begins at i."""
        rest = F.slice(F.col("w"), i + 1, F.lit(MOST))
        stop = F.array_position(F.transform(rest, digit), F.lit(False)) - 1
        return F.when(digit(F.col("w")[i]), F.when(stop < 0, F.size(rest)).otherwise(stop)).otherwise(1).cast("int")

    left = lambda i: F.concat_ws(" ", F.lit("L"), word(i - 2, "^"), word(i - 1, "^"))
    both = lambda i: F.concat_ws(" ", F.lit("LR"), word(i - 1, "^"), F.lit("_"), word(i + run_at(i), "$"))
    fits = lambda i: (F.col("w")[i] != MASK) & (may(left(i)) | (may(F.concat_ws(" ", F.lit("LR"), word(i - 1, "^"))) & may(both(i))))
    at = F.filter(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)), fits)

    def held(i: Column) -> Column:
        """The instances that begin at i."""
        rest = F.slice(F.col("w"), i + 1, F.lit(MOST))
        masks = F.array_position(rest, MASK).cast("int")
        upto = F.when(masks > 0, masks - 1).otherwise(F.size(rest))
        one = lambda pattern, n: F.struct(i.alias("at"), n.cast("int").alias("parts"), F.concat_ws(" ", F.slice(F.col("w"), i + 1, n)).alias("value"), pattern.alias("pattern"))
        none = F.array().cast("array<struct<at:int,parts:int,value:string,pattern:string>>")
        wider = F.transform(F.sequence(F.lit(1), upto), lambda n: one(F.concat_ws(" ", F.lit("LL"), left(i), F.lit("_"), word(i + n, "$")), n))
        every = F.concat(F.array(one(left(i), run_at(i)), one(both(i), run_at(i))), F.when(may(left(i)), wider).otherwise(none))
        return F.filter(every, lambda x: may(x["pattern"]))

    each = words.select("doc_id", "th", F.inline(F.flatten(F.transform(at, held)))).where(F.rlike("value", F.lit(r"[\p{L}\p{N}]")))
    return each.join(patterns.select("pattern").distinct(), "pattern", "left_semi")


def spans_at(base: DataFrame, hits: DataFrame) -> DataFrame:
    """(f_id, f_th, found SPAN) of hits(doc_id, th, at, parts, kind); punctuation that ends an instance does not belong to it."""
    hits = hits.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("at", "parts", "kind"))).alias("hits")).withColumnsRenamed({"doc_id": "f_id", "th": "f_th"})
    text = base.select("doc_id", "th", "text", masked().alias("m")).dropDuplicates(["doc_id", "th"])
    both = hits.join(text, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th"))).withColumn("p", F.regexp_extract_all("m", F.lit(PART), F.lit(0)))
    both = both.withColumns({"ends": running(F.transform("p", F.length), lambda a, b: a + b)})
    upto = lambda n: F.coalesce(F.get(F.col("ends"), n - 1), F.lit(0))
    first = lambda h: F.get(F.col("p"), h["at"])
    blank = lambda h: F.length(first(h)) - F.length(F.ltrim(first(h), F.lit(BLANKS)))
    placed = F.transform("hits", lambda h: F.struct(h["kind"].alias("kind"), (upto(h["at"]) + blank(h)).alias("start"), upto(h["at"] + h["parts"]).alias("end")))
    both = both.withColumns({"placed": placed, "c": chunks(F.col("text"))})
    cut = lambda s: F.rtrim(text_between(F.col("c"), s["start"], s["end"]), F.lit(".,;:!?-/%"))
    name = lambda k: reduce(lambda c, i: c.when(k == i, f"found_{KINDS[i]}"), range(1, len(KINDS)), F.when(k == 0, f"found_{KINDS[0]}"))
    span = lambda s: F.struct(name(s["kind"]).alias("kind"), (s["kind"] + len(KINDS)).alias("rank"), s["start"].alias("start"), (s["start"] + F.length(cut(s))).alias("end"), cut(s).alias("value"))
    both = both.select("f_id", "f_th", F.transform("placed", span).alias("all"))
    inside = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    # A longer one around the i-th begins at most MOST - 1 parts before it, and at most MOST begin at a part.
    near = lambda i: F.slice(F.col("all"), F.greatest(i - MOST * MOST, F.lit(0)) + 1, F.lit(MOST * MOST + MOST + 1))
    outer = F.transform("all", lambda s, i: F.when((s["end"] > s["start"]) & ~F.exists(near(i), lambda o: inside(s, o)), s))
    return both.select("f_id", "f_th", F.filter(outer, lambda s: s.isNotNull()).alias("found"))


def accepted_patterns(edges: DataFrame, rounds: int, min_seeds: int, min_confidence: float) -> DataFrame:
    """(pattern, kind, confidence) after the given rounds over edges(value, kind, pattern)."""
    edges = materialize(edges.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    seeds = edges.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")).withColumns({"score": F.lit(1.0), "seed": F.lit(1)})
    scores, accepted = seeds, None
    for k in range(rounds):
        weight = edges.select("pattern", "value").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("weight"), F.sum("seed").alias("seeds"))
        accepted = weight.join(sizes, "pattern").withColumn("confidence", F.col("weight") / (F.col("size") + 1)).where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= min_confidence))
        accepted = materialize(accepted.select("pattern", "kind", "confidence"), "patterns")
        if k + 1 < rounds:
            new = edges.select("pattern", "value").join(accepted, "pattern").join(seeds.select("value"), "value", "left_anti").groupBy("value", "kind").agg(F.max("confidence").alias("score")).withColumn("seed", F.lit(0))
            scores = materialize(seeds.unionByName(new), "scores")
    return accepted


def specific_patterns(seeds: DataFrame, min_seeds: int, min_purity: float) -> DataFrame:
    """(pattern, opening) of those that stand around min_seeds distinct seeds of one kind, which are min_purity of all their distinct seeds: a context
    that goes with every kind says nothing of any."""
    kinds = seeds.groupBy("pattern", "kind").agg(F.countDistinct("value").alias("n"), F.first("opening").alias("opening"))
    both = kinds.groupBy("pattern").agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.first("opening").alias("opening"))
    return both.where((F.col("most") >= min_seeds) & (F.col("most") >= min_purity * F.col("all"))).select("pattern", "opening")


def find_personal_data(docs: DataFrame, rounds: int = 3, min_seeds: int = 3, min_confidence: float = 0.6, min_purity: float = 0.9) -> DataFrame:
    """doc_id, base and found (SPAN arrays) for each row of docs(doc_id, text)."""
    base = materialize(base_spans(docs), "spans")
    seeds = materialize(seed_edges(base), "seeds")
    patterns = materialize(specific_patterns(seeds, min_seeds, min_purity), "candidates")
    free = materialize(instances(base, patterns), "instances")
    edges = seeds.join(patterns.select("pattern"), "pattern", "left_semi").select("value", "kind", "pattern").unionByName(free.select("value", F.lit(None).cast("int").alias("kind"), "pattern"))
    accepted = accepted_patterns(edges, rounds, min_seeds, min_confidence)
    best = dealt_lookup(free, accepted, "pattern", ["doc_id", "th", "at"]).groupBy("doc_id", "th", "at", "parts").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    found = spans_at(base, best)
    return base.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left").select("doc_id", "base", F.coalesce("found", no_spans()).alias("found"))


def personal_data_digest(found: DataFrame) -> DataFrame:
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    every = F.concat("base", "found")
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("found").cast("long").alias("n_found"), F.size(every).cast("long").alias("n_spans"))
