"""Places in texts: running totals, masks, neighbourhoods and redaction against plain Python, and their time on very many matches."""

import itertools
import random
import time

from pyspark.sql import functions as F

from factloom.llm import pii, secret_scan, spans


def test_running_totals_of_any_length(spark):
    r = random.Random(3)
    rows = [(n, [r.randint(-9, 9) for _ in range(n)]) for n in (0, 1, 2, 63, 64, 65, 128, 4095, 4096, 4097, 9000)]
    df = spark.createDataFrame(rows, "n int, v array<int>").select("n", "v", spans.running(F.col("v"), lambda a, b: a + b).alias("sums"), spans.running(F.col("v"), F.greatest).alias("tops"))
    for row in df.collect():
        assert row.sums == list(itertools.accumulate(row.v)) and row.tops == list(itertools.accumulate(row.v, max))


def span_rows(seed):
    """Texts of several chunks and spans on them that nest, overlap, touch and repeat."""
    r = random.Random(seed)
    for n, m in ((0, 0), (5, 1), (1023, 3), (1024, 2), (1025, 2), (3000, 40), (7000, 300), (5000, 0)):
        text = "".join(r.choice("aB é🙂\n") for _ in range(n))
        found = [(a, min(n, a + r.choice([1, 3, 20, 1500]))) for a in (r.randrange(n) for _ in range(m))] if n else []
        yield n * 1000 + m, text, sorted(found + found[:2])


def test_masks_and_neighbourhoods(spark):
    rows = [(i, t, [(f"k{a % 3}", a % 3, a, b, t[a:b]) for a, b in s]) for i, t, s in span_rows(1)]
    df = spark.createDataFrame(rows, f"id long, text string, base {spans.SPAN}")
    near = F.transform("base", lambda s: F.struct(spans.text_before(F.col("m"), s["start"], 200).alias("b"), spans.text_after(F.col("m"), s["end"], 200).alias("a"), spans.text_between(F.col("m"), s["start"], s["end"]).alias("v")))
    clear = spans.clear_of(F.transform(F.sequence(F.lit(0), F.length("text")), lambda i: F.struct(i.alias("start"), (i + 7).alias("end"))), F.col("base"))
    got = df.withColumn("m", spans.chunks(F.col("text"))).select("id", "text", "base", pii.masked().alias("masked"), near.alias("near"), F.transform(clear, lambda s: s["start"]).alias("clear")).collect()
    assert len(got) == len(rows)
    for row in got:
        hidden = [any(s.start <= i < s.end for s in row.base) for i in range(len(row.text))]
        assert row.masked == "".join("" if h else "" if c == "" else "b" if c == "B" else c for c, h in zip(row.text, hidden))
        for s, n in zip(row.base, row.near, strict=True):
            assert (n.b, n.a, n.v) == (row.text[max(0, s.start - 200) : s.start], row.text[s.end : s.end + 200], s.value)
        assert row.clear == [i for i in range(len(row.text) + 1) if not any(hidden[i : i + 7])]


def test_redaction_of_overlapping_secrets(spark):
    verdicts = lambda s: [("hex", 2, a, b, "", "example" if k % 5 == 4 else "live") for k, (a, b) in enumerate(s)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in span_rows(2)], "doc_id long, text string, n_chars long")
    found = spark.createDataFrame([(i, t, verdicts(s)) for i, t, s in span_rows(2)], "doc_id long, text string, spans array<struct<kind:string,rank:int,start:int,end:int,value:string,verdict:string>>")
    found = found.select("doc_id", F.xxhash64("text").alias("th"), "spans")
    got = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact(docs, found).collect()}
    for i, text, s in span_rows(2):
        out, at = "", 0
        for a, b in sorted((a, b) for k, (a, b) in enumerate(s) if k % 5 != 4):
            if b > at:
                out, at = out + (text[at:a] + "[SECRET]" if a >= at else ""), b
        out += text[at:]
        assert got[i] == (out, len(out))


def test_very_many_matches_in_one_text(spark):
    """Two hundred thousand matches; with a copy of what came before for each of them this would take hours."""
    n = 200_000
    lines = [f"mail to user{i}@host.example or +12125{i:06} now\n" for i in range(n // 2)]
    keys = "".join(f"password={i:032x} or so\n" for i in range(n // 2))
    base = [pii.base_spans(spark.createDataFrame([(1, "".join(part))], "doc_id long, text string")) for part in (lines, lines[: n // 20])]
    began = time.time()
    assert base[0].select(F.size("base"), F.length(F.translate(pii.masked(), "\ue000", ""))).first() == (n, len("mail to  or  now\n") * (n // 2))
    assert pii.seed_edges(base[1]).agg(F.count("*"), F.countDistinct("value")).first() == (3 * (n // 10), n // 10)
    docs = spark.createDataFrame([(1, keys, "s")], "doc_id long, text string, source string")
    found = secret_scan.find_secrets(docs)
    assert found.select(F.size("spans")).first()[0] == n
    assert secret_scan.redact(docs, found).select(F.sha2("text", 256)).first()[0] == spark.range(1).select(F.sha2(F.repeat(F.lit("[SECRET] or so\n"), n // 2), 256)).first()[0]
    assert time.time() - began < 300
