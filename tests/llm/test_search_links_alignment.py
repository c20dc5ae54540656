"""Ranked search, URL filters and tokenizer alignment against brute force, on edge rows, planted cases and empty tables."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import alignment, lexical, url_filter
from factloom.llm.queries import tokenizer_path
from factloom.llm.tokens import byte_alphabet

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def counted(items):
    return sorted(items, key=repr)


# 11 --------------------------------------------------------------------------------------------------------------------------


def brute_search(docs, items, k):
    """(item_id, rank, doc_id, score); a null id is None and comes last among equals."""
    terms = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    n_docs, words = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        q = Counter(TERM.findall(lower(text)))
        scores = []
        for i, c, n in terms:
            m = 75 + 25 * n * n_docs // words
            s = sum(o * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, o in q.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


ITEMS = [(0, "The quick brown fox, a LAZY dog"), (0, "river_bank noise"), (1, None), (2, " ,;! "), (3, "one"), (3, "one"), (4, "émigré мир b co 017"), (None, "owls watch, watch, watch"), (5, "x" * 5000), (6, "zzzz-unknown")]


@pytest.mark.parametrize(("tree", "block"), [(8192, 2000), (16, 3)])
def test_ranked_search(spark, docs, rows, monkeypatch, tree, block):
    monkeypatch.setattr(lexical, "TREE", tree)
    monkeypatch.setattr(lexical, "LEAF", 4)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    items = spark.createDataFrame([(i, t, "n", 1) for i, t in ITEMS], "item_id int, text string, term string, score int")
    got = lexical.ranked_search(docs, items, 5)
    assert dict(got.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert counted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == counted(brute_search([(r[0], r[1]) for r in rows], ITEMS, 5))


def test_ranked_search_of_copies_takes_the_smallest_ids(spark):
    """A third of all rows are copies of the best text: ties go by doc_id, over all tasks."""
    texts = [(i, "needle in the hay" if i % 3 == 0 else f"the hay {i}") for i in range(300, 0, -1)]
    got = lexical.ranked_search(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), spark.createDataFrame([(1, "Needle hay")], "item_id long, text string")).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == list(range(3, 63, 3))


def test_trees_prune_and_stay_exact():
    """Rows of two vocabularies: most leaves of the other one are never opened, and the places are those of all products."""
    r = np.random.default_rng(3)
    n, v = 4000, 400
    rows = [np.sort(r.choice(v // 2, 12, replace=False)) + v // 2 * (i % 2) for i in range(n)]
    offsets, terms = np.append(0, np.cumsum([len(x) for x in rows])), np.concatenate(rows)
    values, scale = r.integers(1, 1_000_000, len(terms)), np.sqrt(r.integers(1, 9000, v))
    class_of = np.arange(v) // 8
    tree = lexical.BallTree(offsets, terms, values, np.arange(n), scale, class_of)
    assert sorted(tree.ids.tolist()) == list(range(n)) and sum(b - a for a, b in tree.nodes[tree.first_leaf :]) == n
    opened = 0
    for _ in range(20):
        own, weights = np.sort(r.choice(v // 2, 6, replace=False)), r.integers(1, 9000, 6)
        places = lexical.Places(10)
        opened += tree.search(own, weights, scale, class_of, places)
        full = np.zeros(v, np.int64)
        full[own] = weights
        scores = np.add.reduceat(full[terms] * values, offsets[:-1])
        order = np.lexsort((np.arange(n), -scores))[:10]
        assert places.ids.tolist() == order.tolist() and places.scores.tolist() == scores[order].tolist()
    assert opened < 0.6 * 20 * (len(tree.nodes) - tree.first_leaf)


def test_bounds_hold_for_every_row_below():
    r = np.random.default_rng(4)
    rows = [np.sort(r.choice(60, r.integers(1, 20), replace=False)) for _ in range(500)]
    offsets, terms = np.append(0, np.cumsum([len(x) for x in rows])), np.concatenate(rows)
    scale, class_of = np.sqrt(r.integers(1, 9000, 60)), np.arange(60) % 7
    tree = lexical.BallTree(offsets, terms, r.integers(1, 1_000_000, len(terms)), np.arange(500), scale, class_of)
    own, weights = np.arange(0, 60, 3), r.integers(1, 9000, 20)
    q, full = weights / scale[own], np.zeros(60, np.int64)
    full[own] = weights
    bounds = (tree.centers[:, own] @ q + tree.radii @ np.sqrt(np.bincount(class_of[own], q * q, 7))) * (1 + 1e-9) + 1
    scores = np.add.reduceat(full[tree.terms] * tree.values, tree.offsets[:-1])
    assert all((scores[a:b] <= bound).all() for (a, b), bound in zip(tree.nodes, bounds))


def test_terms_of_parts_of_a_column():
    texts = pa.array(["skip", "A-b c", None, "", "é9_x"], pa.string())
    words, at = lexical.terms_of(texts.slice(1))
    assert words.to_pylist() == ["a", "b", "c", "é9", "x"] and at.tolist() == [0, 3, 3, 3, 5]


def test_long_lengths_do_not_overflow():
    n = np.array([10, 10**9])
    assert lexical.lengths_of(n, 10**11, 10**13).tolist() == [75 + 25 * int(x) * 10**11 // 10**13 for x in n]


# 12 --------------------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, rule string"


def link(*hosts):
    return "".join(f"<a href='https://{h}/x'>x</a>" for h in hosts)


def test_rules_and_urls(spark):
    urls = {
        1: "http://a.ORG/p?q#f", 2: "https://www.example.org/es/1", 3: "https://Example.org/en/12", 4: "https://example.org/en/2", 5: "http://x.com/fr/", 6: "http://x.com/de/y", 7: "http://notexample.org/es/",
        8: None, 9: "no scheme.org/", 10: "http://b.org", 11: "http://b.org?x=/", 12: "://", 13: "x://y.com/fr/z://org/", 14: "http://a.net/q", 15: "http://org/", 16: "http://a.com/fr", 17: "http://e.org/\n/x",
    }
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame([(i, u, None, "h", "r") for i, u in urls.items()], PAGES)).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == {
        1: ("a.org", "/p", "org/"), 2: ("www.example.org", "/es/1", "example.org/es/"), 3: ("example.org", "/en/12", "example.org/en/1"), 4: ("example.org", "/en/2", "org/"), 5: ("x.com", "/fr/", "com/fr/"),
        6: ("x.com", "/de/y", "com/de/"), 7: ("notexample.org", "/es/", "org/"), 8: ("", "", None), 9: ("", "", None), 10: ("b.org", "", None), 11: ("b.org", "", None), 12: ("", "", None), 13: ("y.com", "/fr/z://org/", "com/fr/"),
        14: ("a.net", "/q", None), 15: ("org", "/", "org/"), 16: ("a.com", "/fr", None), 17: ("e.org", "/\n/x", "org/"),
    }
    assert [got[i].verdict for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == ["allow", "block", "block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert all(got[i].by_rule == (got[i].rule is not None) for i in got)


def brute_spread(links, hosts, seeds, rounds, damping):
    """kind, host -> mass, by dictionaries."""
    edges = Counter()
    for src, dst in links:
        edges[src, dst] += 1
    pairs = set()
    for h in {*hosts, *(x for e in links for x in e)}:
        labels = h.split(".")
        for i in range(len(labels) - 2):
            pairs |= {(".".join(labels[i:]), ".".join(labels[i + 1 :])), (".".join(labels[i + 1 :]), ".".join(labels[i:]))}
    for p in pairs:
        edges[p] += 1
    out = {}
    for kind, own in seeds.items():
        along = Counter({(a, b) if kind == "trust" else (b, a): w for (a, b), w in edges.items()})
        leaving = Counter()
        for (a, _), w in along.items():
            leaving[a] += w
        start = {h: url_filter.UNIT // sum(own.values()) * n for h, n in own.items()}
        mass = dict(start)
        for _ in range(rounds):
            new = Counter({h: m // 100 * (100 - damping) for h, m in start.items()})
            for (a, b), w in along.items():
                new[b] += mass.get(a, 0) // 100 * damping // leaving[a] * w
            mass = {h: m for h, m in new.items() if m > 0}
        out |= {(kind, h): m for h, m in mass.items()}
    return out


def test_masses_are_those_of_brute_force(spark):
    r = random.Random(2)
    hosts = [f"{r.choice(['', 'www.', 'a.b.'])}h{i}.example.net" for i in range(25)]
    pages, links = [], []
    for i in range(300):
        h = hosts[int(r.random() ** 3 * 25)]
        to = sorted({r.choice(hosts) for _ in range(r.randint(0, 3))})
        pages.append((i, f"http://{h}/{r.choice(['good', 'bad', 'else', 'else'])}", link(*to, *to)))
        links += [(h, t) for t in to if t != h]
    rules = (("net", "/good", "allow"), ("net", "/bad", "block"))
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5), rules, rounds=4).collect()
    seeds = {k: Counter(u.split("/")[2] for _, u, _ in pages if u.endswith(end)) for k, end in (("trust", "/good"), ("distrust", "/bad"))}
    want = brute_spread(links, hosts, seeds, 4, url_filter.DAMPING)
    assert all((r.trust, r.distrust) == (want.get(("trust", r.host), 0), want.get(("distrust", r.host), 0)) for r in got)
    assert {r.verdict for r in got if not r.by_rule} == {"allow", "block"}


def test_distrust_reaches_those_who_link_to_the_blocked_and_trust_those_linked_by_the_trusted(spark):
    pages = [(1, "http://spam.net/bad/", None), (2, "http://farm.net/x", link("spam.net")), (3, "http://farmer.net/x", link("farm.net")), (4, "http://good.net/good/", link("friend.net")), (5, "http://friend.net/x", link("spam.net", "good.net")), (6, "http://lone.net/", "<a href='/spam.net'>")]
    rules = (("net", "/good/", "allow"), ("net", "/bad/", "block"))
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
    assert got[5].trust > got[5].distrust > 0 and got[6].trust == got[6].distrust == 0


def test_links_in_html(spark):
    html = """<a HREF = "HTTP://One.net:80/a">1</a><a href=//two.net?x>2</a><a href='/three.net/'>3</a> href="mailto:x@y" <link href="https://One.net:80#z"><a href='https://p.net/'>self</a>"""
    df = spark.createDataFrame([(1, "http://p.net/", html), (2, "http://p.net/2", html), (3, None, html), (4, "http://q.net/", None)], "page_id long, url string, html string")
    assert counted(tuple(r) for r in url_filter.link_edges(df).collect()) == [("p.net", "one.net:80", 2), ("p.net", "two.net", 2)]


def test_the_longest_of_equal_rules_blocks(spark):
    rules = spark.createDataFrame([("a.net", "/x", "allow"), ("a.net", "/x", "block"), ("a.net", "/x/y", "allow")], "rule_host string, rule_path string, rule_verdict string")
    got = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.net/x", None), (2, "http://b.a.net/x/yz", None), (2, "http://b.a.net/x/yz", None)], "page_id long, url string, html string"), rules).collect()
    assert counted((r.page_id, r.rule, r.verdict) for r in got) == [(1, "a.net/x", "block"), (2, "a.net/x/y", "allow"), (2, "a.net/x/y", "allow")]


# 13 --------------------------------------------------------------------------------------------------------------------------

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()


def brute_tokens(text):
    """(ids, ends in bytes) of both tokenizers by their libraries on the whole text, or none."""
    if not text:
        return None
    a, b, alphabet = libraries()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    return ids_a, np.cumsum([len(x) for x in bytes_a]).tolist(), ids_b, np.cumsum([len(x) for x in bytes_b]).tolist()


def brute_alignment(texts):
    docs, counts = [], Counter()
    for text in texts:
        if (got := brute_tokens(text)) is None:
            docs.append((0, 0, [], ""))
            continue
        ids_a, ends_a, ids_b, ends_b = got
        shared = sorted({*ends_a} & {*ends_b})
        links = [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in shared] if len(text) < 3000 else [(dict(zip(ends_a, ids_a))[e], dict(zip(ends_b, ids_b))[e]) for e in shared]
        counts.update(links)
        groups = [(",".join(str(i) for i, e in zip(ids_a, ends_a) if lo < e <= hi), ",".join(str(i) for i, e in zip(ids_b, ends_b) if lo < e <= hi)) for lo, hi in zip([0, *shared], shared)] if len(text) < 3000 else None
        docs.append((len(ids_a), len(ids_b), links, hashlib.sha256(";".join(map("|".join, groups)).encode()).hexdigest() if groups else None))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(a, b, len(own), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), digest) for a, b, own, digest in docs]


HOSTILE = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a\n  b \n\n c  ", "\t x\r\n y", "▁x", "x ▁ y", "<s> </s><unk>", "<|endoftext|> it's we'll", "<0x41>", "émigré мир 🙂🙂 ναι 日本語テキスト", "a\x00b \x1c c\x85d e　f", "x" * 2000,
    "!!!???...---", "1234567 89", " " * 300 + "z" + "\n" * 40, "can't won't I'D", "﻿bom", "é e\u0301", "\u200b zero", "\r;\r\n );\r",
]


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_alignment(spark, docs, rows, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE", size)
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HOSTILE)], "doc_id long, text string")
    both = docs.select("doc_id", "text", "key").unionByName(extra, allowMissingColumns=True)
    out = alignment.align_tokenizers(both, A, B).collect()
    got = {(r.doc_id, r.groups_sha256) for r in out}
    all_rows = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(HOSTILE)]
    found = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in out]
    want = brute_alignment([t for _, t in all_rows])
    assert counted(found) == counted((i, *w[:6]) for (i, _), w in zip(all_rows, want))
    assert all((i, w[6]) in got for (i, _), w in zip(all_rows, want) if w[6] is not None)


def test_chunks_give_the_ids_of_whole_texts():
    r = random.Random(9)
    pieces = [" ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", "\u2003", "\u3000", "\x1c", "the", "Ünï", "12", "'s", "'re", "!", "...", "▁", "é", "日本", "🙂", "x", "\u200d", "a", "ing", "<s>", "\x00"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(1500)]
    vocabularies = alignment.token_pair(A, B)
    got = alignment.align_slice(texts, vocabularies)
    want = [brute_tokens(t) for t in texts]
    assert got["n_a"].tolist() == [len(w[0]) if w else 0 for w in want] and got["n_b"].tolist() == [len(w[2]) if w else 0 for w in want]
    one_by_one = brute_alignment(texts)
    assert got["digests"] == [w[6] for w in one_by_one] and got["n_groups"].tolist() == [w[2] for w in one_by_one]


@pytest.mark.parametrize("piece", [1, 2, 5, 64])
def test_merge_paths(piece):
    r = np.random.default_rng(piece)
    for n, m in ((0, 0), (0, 5), (7, 0), (1, 1), (40, 3), (500, 700), (64, 64)):
        a, b = (np.unique(r.integers(0, 900, k)) for k in (n, m))
        at_a, at_b = alignment.common_ends(a, b, piece)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted({*a.tolist()} & {*b.tolist()})


def test_pair_counts_are_of_the_whole_corpus(spark):
    """The same text in many slices and partitions: every link counts each copy."""
    df = spark.createDataFrame([(i, "plain words here" if i % 3 else "other words") for i in range(60)], "doc_id long, text string").repartition(6)
    got = alignment.align_tokenizers(df, A, B).collect()
    assert {(r.doc_id % 3 > 0, r.n_links, r.count_sum, r.n_best) for r in got} == {(True, 3, 40 + 60 + 40, 3), (False, 2, 20 + 60, 2)}


# all -------------------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "the quick")], "item_id long, text string")
    assert lexical.ranked_search(no_docs, items).collect() == [] == lexical.ranked_search(docs, items.where("item_id > 1")).collect() == lexical.ranked_search(docs, spark.createDataFrame([(1, "!!")], items.schema)).collect()
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).collect() == []
    assert alignment.align_tokenizers(no_docs, A, B).collect() == []


def test_a_slice_is_aligned_in_a_few_dozen_times_its_bytes():
    """Before, numbers and parts of all tokens of a slice were Python objects at once."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=2000)) for _ in range(60)]
    pair = alignment.token_pair(A, B)
    tracemalloc.start()
    got = alignment.align_slice(texts, pair)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(got["digests"])) == 60 and peak < 75 * sum(map(len, texts))
