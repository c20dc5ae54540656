"""Secrets: pattern matches judged by corpus-wide ownership frequency, in DataFrame functions alone.

Candidate values (of base matches, and of long mixed tokens besides) are hashed and counted by distinct repositories and owners. What
many owners hold is a widely copied example; what one owner holds, in however many repositories, is live-looking; what a few
owners share is no example either. For documents the owner is the source and the repository the document. Long mixed tokens are added as
``token`` spans, and values are redacted, where they are no example.

Defined cases: null and empty texts have no spans; a null owner is an owner of its own; rows that repeat an id are
one repository, and each is judged by its own text; a null doc_id is a repository of its own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, dealt_lookup, materialize, text_hash
from .spans import chunks, clear_of, count_kind, joined, let, no_spans, running, text_between, with_matches

KINDS = ("assign", "access", "hex")
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)"
#: Tokens of both letters and digits.
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+"


def secret_value(kind: Column, value: Column) -> Column:
    return F.when(kind == "assign", F.regexp_extract(value, ASSIGN, 1)).otherwise(value)


def kinds(text: str) -> list:
    varied = lambda m: F.size(F.array_distinct(F.split(m, ""))) >= 12
    return [
        ("assign", ASSIGN, None, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12),
        ("access", "AKIA[A-Z0-9]{14,}", F.contains(text, F.lit("AKIA")), lambda m: F.lit(True)),  # AKIA[A-Z0-9]+ of 18 or more
        ("hex", "[0-9a-f]{16,}", None, lambda m: F.lit(True)),  # [0-9a-f]+ of 16 or more
        ("token", MIXED, None, varied),
    ]


def scan(docs: DataFrame, owner: str) -> DataFrame:
    """(doc_id, th, owner, base SPAN, tokens SPAN) of each row; th names the text."""
    text = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), text_hash(), F.coalesce("text", F.lit("")).alias("__text"))
    found = with_matches(text, "__text", kinds("__text")).withColumn("base", F.concat(*KINDS))
    return found.select("doc_id", "th", "owner", "base", clear_of(F.col("token"), F.col("base")).alias("tokens"))


def ownership(found: DataFrame, example_owners: int) -> DataFrame:
    """(value, repositories, owners, verdict) of each candidate hash: example, live, or shared for what a few owners hold."""
    each = found.where("size(base) + size(tokens) > 0").select("doc_id", "owner", F.explode(F.concat("base", "tokens")).alias("s"))
    each = each.select(F.sha2(secret_value(F.col("s.kind"), F.col("s.value")), 256).alias("value"), F.struct("doc_id").alias("repository"), F.struct("owner").alias("owner"))
    counts = each.distinct().groupBy("value").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"))
    verdict = F.when(F.col("owners") >= example_owners, "example").when(F.col("owners") == 1, "live").otherwise("shared")
    return counts.withColumn("verdict", verdict)


def find_secrets(docs: DataFrame, owner: str = "source", example_owners: int = 3) -> DataFrame:
    """doc_id, th and spans (SPAN with its verdict; base ones, and added tokens that are no example) for each row of docs."""
    found = materialize(scan(docs, owner), "secrets")
    verdicts = materialize(ownership(found, example_owners), "verdicts")
    each = found.where("size(base) + size(tokens) > 0").select("doc_id", "th", F.explode(F.concat("base", "tokens")).alias("s")).withColumn("value", F.sha2(secret_value(F.col("s.kind"), F.col("s.value")), 256))
    judged = dealt_lookup(each, verdicts.select("value", "verdict"), "value", ["doc_id", "th"]).where("s.kind <> 'token' or verdict <> 'example'")
    span = F.struct("s.kind", "s.rank", "s.start", "s.end", "s.value", "verdict")
    spans = judged.groupBy("doc_id", "th").agg(F.collect_set(span).alias("spans")).withColumnsRenamed({"doc_id": "f_id", "th": "f_th"})
    none = no_spans().cast("array<struct<kind:string,rank:int,start:int,end:int,value:string>>")
    empty = F.transform(none, lambda s: s.withField("verdict", F.lit("")))
    return found.join(spans, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left").select("doc_id", "th", F.coalesce("spans", empty).alias("spans"))


def secrets_digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != "token")
    judged = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long").alias(f"n_{v}")
    verdicts = [judged("live"), judged("example"), judged("shared")]
    return found.select("doc_id", *(count_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *verdicts)


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text that is no example replaced by mark (overlapping ones by one); n_chars, if there, follows."""
    hidden = F.filter("spans", lambda s: s["verdict"] != "example")
    live = found.select(F.col("doc_id").alias("__f_id"), F.col("th").alias("__f_th"), F.array_sort(F.transform(hidden, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("__live"))
    rows, names = carried(docs)
    text = F.col("text")

    def cut(s: Column, before: Column, parts: Column) -> Column:
        """What stands for the secret s and the text before it, of which before characters are done."""
        return F.when((s["end"] > before) & (s["start"] >= before), F.concat(text_between(parts, before, s["start"]), F.lit(mark))).otherwise("")

    def clean(parts: Column, done: Column) -> Column:
        pieces = F.transform("__live", lambda s, i: let(F.coalesce(F.get(done, i - 1), F.lit(0)), lambda before: cut(s, before, parts)))
        return F.concat(F.array_join(pieces, ""), text_between(parts, F.try_element_at(done, F.lit(-1)), F.length(text)))

    cleaned = let(chunks(text), lambda parts: let(running(F.transform("__live", lambda s: s["end"]), F.greatest), lambda done: clean(parts, done)))
    rows = rows.withColumns({"__id": F.col(names[docs.columns.index("doc_id")]), "__th": text_hash()})
    both = rows.join(live.where("size(__live) > 0").distinct(), F.col("__id").eqNullSafe(F.col("__f_id")) & (F.col("__th") == F.col("__f_th")), "left")
    both = both.withColumn("__cleaned", F.when(F.col("__live").isNotNull(), cleaned))
    new = {"text": F.coalesce("__cleaned", text), "n_chars": F.length("__cleaned").cast("long")}
    kept = [F.coalesce(new[c], F.col(n)).alias(c) if c in new else F.col(n).alias(c) for c, n in zip(docs.columns, names)]
    return both.select(*kept)
