"""The pipeline's stages on a small table against what they promise, and the whole against a brute-force version."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from factloom.llm.langid import predict_languages

from .conftest import DOCS, PARAGRAPH, edge_rows
from .test_operators import SECRETS, brute_components, brute_languages, counted, lower


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(edge_rows(), DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "jumps over the lazy dog while seven silent owls watch"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    docs, seen = P.table(spark, sf_dir, "documents"), {}
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert out.columns == docs.columns and out.schema == docs.schema
        seen[name], docs = out.collect(), out
    ids = {n: [r.doc_id for r in rows] for n, rows in seen.items()}
    assert not {100, 101, 102, 115} & set(ids["language_id"]) and {0, 1, 106, 108, 113} <= set(ids["language_id"])
    assert 107 not in ids["near_dedup"] and 106 in ids["near_dedup"] and ids["near_dedup"].count(116) == 1 and ids["near_dedup"].count(117) == 2
    assert 108 in ids["near_dedup"] and not {109, 110} & set(ids["near_dedup"])
    texts = [r.text for r in seen["decontamination"]]
    assert all(PARAGRAPH.lower() not in t.lower() for t in texts) and len(texts) >= 35
    secret = next(r.text for r in seen["secret_scan"] if r.doc_id == 114)
    assert "abcdEFGH1234" not in secret and "[SECRET]" in secret and ids["secret_scan"].count(114) == 1
    assert sorted(ids["secret_scan"], key=repr) == sorted(ids["decontamination"], key=repr)
    assert set(ids["packing"]) == set(ids["secret_scan"])
    assert sum(r.length for r in seen["packing"]) == sum(r.doc_tokens for r in seen["packing"] if r.start == 0)


def brute_redacted(rows, mark="[SECRET]"):
    """Values that three owners hold are examples; all others go, overlapping ones as one."""
    found, owners = [], {}
    for i, (_, text, _, source, _) in enumerate(rows):
        spans = [(m.start(), m.end(), m[1] if k == "assign" else m[0]) for k, p, ok in SECRETS for m in re.finditer(p, text or "") if ok(m)]
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}", text or ""):
            if len(set(m[0])) >= 12 and all(m.end() <= a or b <= m.start() for a, b, _ in spans):
                spans.append((m.start(), m.end(), m[0]))
        found.append(sorted(spans))
        for *_, v in spans:
            owners.setdefault(v, set()).add(source)
    out = []
    for (i, text, lang, source, n), spans in zip(rows, found):
        made, at = "", 0
        for a, b, v in spans:
            if len(owners[v]) < 3 and b > at:
                made += text[at:a] + mark if a >= at else ""
                at = b
        out.append((i, made + text[at:] if at else text, lang, source, n))
    return out


def test_run_is_that_of_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in P.table(spark, sf_dir, "documents").collect()]
    known = brute_languages([r[:4] for r in rows], 400)
    rows = [r for r, (_, lang, score) in zip(rows, known) if lang != "und" and score >= 0.2]
    rows = sorted({r for r, (*_, kept) in zip(rows, brute_components([r[:4] for r in rows], 5, 80)) if kept}, key=repr)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    item = " ".join(word.findall("jumps over the lazy dog while seven silent owls watch"))
    rows = brute_redacted([r for r in rows if f" {item} " not in f" {' '.join(word.findall(lower(r[1])))} "])
    tokenizer, want = Tokenizer.from_file(P.tokenizer_path("word_bpe_49k.json")), []
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    got = P.run(spark, sf_dir).collect()
    assert counted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == counted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_stages_take_empty_tables(spark, sf_dir):
    for _, stage in P.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCS), sf_dir).count() == 0


def test_stage_carries_clashing_columns(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").selectExpr("*", "1 as score", "2 as lang_pred", "3 as spans", "4 as n_hit", "5 as __id")
    for name, stage in P.STAGES[:4]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    assert predict_languages(docs, spark.createDataFrame([], "lang string, code long, rank int"), ["doc_id"]).where("lang_pred <> 'und'").count() == 0
