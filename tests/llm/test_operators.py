"""Every operator against a brute-force version, on nulls, empty and long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickforge.llm import chat, decontaminate, hmm, html, jaccard, kneser_ney, packing, quality, substring, toxicity
from tickforge.llm.words import hash_words
from tests.llm.conftest import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def oracle(sql, rows, columns=("doc_id", "text")):
    import pandas as pd

    con = duckdb.connect()
    con.register("d", pd.DataFrame([r[:2] for r in rows], columns=list(columns)))
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM d")
    return con.execute(sql).fetchall()


# 1 ------------------------------------------------------------------------------------------------


def packed_right(rows, docs, capacity):
    whole = packing.BlockTokenizer(TOKENIZER).whole
    expected = {d: whole.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(expected)
    for d, pieces in by_doc.items():
        ids, pieces = expected[d], sorted(pieces, key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.length == capacity for p in pieces[:-1])
        at = 0
        for p in pieces:
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(documents, nothing):
    rows = packing.pack_documents(documents, TOKENIZER, 512).collect()
    n = packed_right(rows, [(r.doc_id, r.text) for r in documents.collect()], 512)
    assert n <= 1.05 * sum(r.length for r in rows) / 512 + 1
    assert packing.pack_documents(nothing, TOKENIZER).collect() == []


def test_tokenizer_blocks_equal_whole_texts():
    rng = random.Random(3)
    pieces = [*"abc ABC'sStT'rEe\n\t.,!?;-éßüİΣσς٣Ⅷ²½漢字👍 　_#1", "<|endoftext|>", "<|ENDOFTEXT|>", "\ń", "'LL", "é."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["a" + "-!" * 40 + " b", "-" * 100, "é" + "." * 70, ""]
    tokenizer = packing.BlockTokenizer(TOKENIZER)
    ids, stops = tokenizer([t.encode() for t in texts], 0)
    at = 0
    for t, stop in zip(texts, stops, strict=True):
        assert ids[at:stop].tolist() == [*tokenizer.whole.encode(t, add_special_tokens=False).ids, 0], t
        at = stop


@pytest.mark.parametrize("start", [packing.Bins.arrival, packing.Bins.single])
def test_local_search_empties_bins(start):
    lengths = np.random.default_rng(0).integers(300, 1200, 3000).tolist()
    bins = start(lengths, 2048)
    before, squares = bins.used, sum(f * f for f in bins.fill)
    packing.search(bins)
    assert bins.used < 0.85 * before and sum(f * f for f in bins.fill) > squares
    assert max(bins.fill) <= 2048 and sorted(itertools.chain(*bins.items)) == list(range(3000))
    assert all(bins.fill[b] == sum(lengths[i] for i in items) for b, items in enumerate(bins.items))


def test_every_step_raises_the_squared_fills(monkeypatch):
    lengths = np.random.default_rng(1).integers(1, 900, 400).tolist()
    kinds = Counter()
    swap = packing.Bins._swap

    def checked(self, i, dst, back):
        before = sum(f * f for f in self.fill)
        out = swap(self, i, dst, back)
        assert sum(f * f for f in self.fill) > before
        kinds[len(back)] += 1
        return out

    monkeypatch.setattr(packing.Bins, "_swap", checked)
    packing.arrange(lengths, 1024)
    assert set(kinds) == {0, 1, 2}  # moves, one for one, two for one


def test_search_reaches_the_bound_on_documents():
    import pyarrow.parquet as pq

    texts = [(t or "").encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    _, stops = packing.BlockTokenizer(TOKENIZER)(texts, 0)
    sizes = [n for n in (np.diff(stops, prepend=0) % 2048).tolist() if n]
    assert packing.arrange(sizes, 2048).used == -(-sum(sizes) // 2048)
    assert packing.arrange([], 2048).used == 0


def test_packing_of_repeated_rows_and_clashing_names(spark):
    rows = [(None, "", 1, 2, 3), (None, None, 1, 2, 3)] * 50 + [(5, "a b c", 1, 2, 3)] * 40
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int, part int, sequence_id int").repartition(3), TOKENIZER, 64).collect()
    assert len(out) == 140 and sorted(Counter(r.doc_id for r in out).items(), key=str) == [(5, 40), (None, 100)]
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == list(itertools.accumulate([0] + [n for _, n in sorted(parts)]))[:-1]
        assert sum(n for _, n in parts) <= 64


# 2 ------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><a href="/">Home</a></header>
<nav><ul><li><a href="#">m{n}</a></li><li>x</li></ul></nav><div class="cookie-notice">We use cookies</div><{box}><h1>Head {n}</h1><p>First   <b>bo</b>ld &amp; more{n}<p>Second&nbsp;block
<br>after<form><input name=q>Search</form>{extra}</{box}><aside>side {n}</aside><div id="comments"><p>Nice {n}!</p></div><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("box", ["article", 'div class="content"'])
def test_html(spark, box):
    tag = box.split()[0]
    pages = [(i, f"http://h.example/{i}", PAGE.format(n=i, box="@", extra=f"<ul><li>one</li><li>two{i}</li></ul>" if i % 2 else "").replace("<@>", f"<{box}>").replace("</@>", f"</{tag}>")) for i in range(6)]
    pages += [(90, None, None), (91, "http://h.example/e", ""), (92, "nonsense", "<p>alone")]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert out[i] == f"Head {i} First bold & more{i} Second block after" + (f" one two{i}" if i % 2 else "")
    assert out[90] == out[91] == "" and out[92] in ("", "alone")


def test_html_wrapper_is_inferred():
    tokens = ["<ul", *["<li", "#", ">li"] * 3, ">ul"]
    assert html.fold(tokens) == ["<ul", ["+", ["<li", "#", ">li"]], ">ul"]
    a = html.fold(["<a1", "#", ">a1", *tokens])
    b = html.fold(["<a1", "#", ">a1", "<b", "#", ">b", "<ul", "<li", "#", ">li", ">ul"])
    assert html.pattern(html.align(a, b)) == "<a1 # >a1 (<b # >b)? <ul (<li # >li)+ >ul"
    assert html.slots(html.align(a, b)) == {"a1", "b", "ul/li"}


def test_html_wrappers_of_many_streams_in_levels(spark, monkeypatch):
    monkeypatch.setattr(html, "FAN", 3)
    shapes = ["<i>x</i>" * (i % 5) + "<em>y</em>" * (i // 5) for i in range(20)]
    pages = spark.createDataFrame([(i, "http://h/x", f"<article><p>t{i}{shapes[i]}</p></article>") for i in range(20)], "page_id long, url string, html string")
    found = html.wrappers(pages.withColumn("host", F.lit("h"))).collect()
    assert len(found) == 1 and set(found[0].main) == {"article/p", "article/p/i", "article/p/em"}


def extracted(spark, pages):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_html_constant_blocks_are_slots_of_the_wrapper(spark):
    """Template text at the same path as main text is known by its place in the wrapper only."""
    page = "<div class=content><p>Welcome to us<h1>Head {n}</h1><p>Text {n} of {n}</p>{extra}<hr><p>All rights reserved</div>"
    out = extracted(spark, [(i, "http://h/x", page.format(n=i, extra="<ul><li>a<li>b%d</ul>" % i if i % 2 else "")) for i in range(6)])
    assert out == {i: f"Head {i} Text {i} of {i}" + (f" a b{i}" if i % 2 else "") for i in range(6)}


def test_html_templates_of_one_host(spark):
    """Pages without article beside one with it, two templates without it, and copies of one page."""
    pages = [(0, "http://h/0", "<article><p>In the article</p></article>")]
    pages += [(i, "http://h/x", f"<div class=story><p>A long story number {i} of many words</p></div>") for i in range(1, 5)]
    pages += [(i, "http://h/x", f"<section class=note><p>Note {i}</p></section>") for i in range(5, 9)]
    pages += [(i, "http://copies/x", f"<nav>{i}</nav><div class=story><p>One page, copied</p></div>") for i in range(9, 14)]
    pages += [(i, None, f"<main><p>M{i}</p></main>" if i % 2 else f"<div><p>D{i}</p></div>") for i in range(14, 20)]
    out = extracted(spark, pages)
    assert out[0] == "In the article"
    assert all(out[i] == f"A long story number {i} of many words" for i in range(1, 5)) and all(out[i] == f"Note {i}" for i in range(5, 9))
    assert all(out[i] == "One page, copied" for i in range(9, 14)) and all(out[i] == ("M%d" if i % 2 else "D%d") % i for i in range(14, 20))


def test_html_matches_every_stream_it_was_inferred_from():
    rng = random.Random(1)
    for _ in range(200):
        streams = [["<u"] + [t for _ in range(rng.randrange(5)) for t in rng.choice((["<a", "#", ">a"], ["<b", "#", ">b"], ["#", "<br"], ["<a", "<b", "#", ">b", ">a"]))] + [">u"] for _ in range(6)]
        streams = [html._joined(s) for s in streams]
        nodes = html.fold(list(streams[0]))
        for s in streams[1:]:
            nodes = html.align(nodes, html.fold(list(s)))
        steps = html.program(nodes)
        for s in streams:
            at = html.match(steps, s)
            assert at is not None and [steps[k] for k in at] == [("token", t) for t in s]


def test_html_keeps_what_belongs_to_the_article(spark):
    body = '<header><h1>Title {n}</h1><nav>x</nav></header><p class="related">Para {n}</p><div class="search-results"><p>Found {n}</p></div><math><mi>x</mi>={n}</math><ul><li class="share">item {n}</ul>'
    drop = '<div class="ad">Buy {n}</div><div class="comments"><p>Nice {n}</p></div><aside>side {n}</aside><form><textarea>write {n}</textarea></form><header>top {n}</header>'
    out = extracted(spark, [(i, "http://h/x", f"<header><h2>Site</h2></header><article>{body}{drop}</article>".replace("{n}", str(i))) for i in range(5)])
    assert out == {i: f"Title {i} Para {i} Found {i} x={i} item {i}" for i in range(5)}


@pytest.mark.parametrize("box", ["article", "div"])
def test_html_wrapper_decides_at_the_edges(spark, monkeypatch, box):
    """Strings that never mismatch at the edges are template text, in an article too; without the wrapper's places they would stay."""
    page = f"<{box}><p>Our daily paper</p><h1>Head {{n}}</h1><h2>Summary</h2><p>Text {{n}}</p><p>Printed on paper</p></{box}>"
    pages = [(i, "http://h/x", page.replace("{n}", str(i))) for i in range(4)]
    inner = "Summary " if box == "article" else ""
    assert extracted(spark, pages) == {i: f"Head {i} {inner}Text {i}" for i in range(4)}
    paths = {"article/p", "article/h1"} if box == "article" else {"div/p", "div/h1"}
    stats = [{"block": 0, "path": p, "chars": 9, "linked": 0, "least": 1, "most": 2, "pages": [1, 2, 3]} for p in paths]
    assert len(html.choose(stats)[0]) == 2  # one place for all: nothing is template text


def test_html_random_sites_against_their_makers(spark):
    """Sites with a template each, of which the main text of every page is known exactly."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    pages, want = [], {}
    for host in range(12):
        box = rng.choice(['<article class="story">', "<main>", '<div class="main">'])
        menu, foot, lead = say(4), say(5), rng.choice(["", f"<p>{say(5)}</p>"])
        for k in range(rng.randint(4, 7)):
            i = host * 10 + k
            blocks, text = [], []
            for _ in range(rng.randint(1, 5)):
                a, b, c = say(6), say(2), say(3)
                kind = rng.randrange(4)
                if kind == 0:
                    blocks.append(f"<p>{a}  <b>{b}</b>\n{c}")
                    text.append(f"{a} {b} {c}")
                elif kind == 1:
                    blocks.append(f"<ul><li>{a}</li><li>{b} &amp; {c}</li></ul>")
                    text += [a, f"{b} & {c}"]
                elif kind == 2:
                    blocks.append(f"<h2>{b}</h2><div class=ad>{c}</div><blockquote>{a}</blockquote>")
                    text += [b, a]
                else:
                    blocks.append(f"<table><tr><td>{a}<td>{b}</table>")
                    text += [a, b]
            title = say(3)
            tag = box[1:].split()[0].rstrip(">")
            pages.append((i, f"https://site{host}.example/{i}", f"<html><head><title>{title}</title></head><body><nav><a href=/>{menu}</a></nav>{box}{lead}<h1>{title}</h1>{''.join(blocks)}</{tag}><aside>{say(3)}</aside><footer>{foot}</footer></body></html>"))
            want[i] = " ".join([title, *text])
    assert extracted(spark, pages) == want


def test_html_deep_unclosed_and_repeated(spark):
    deep = "<article>" + "<div>" * 20000 + "deep" + "<i>" * 5000 + " text"
    pages = [(1, "http://h/1", deep), (1, "http://h/1", deep), (None, None, "<article><p>one<p>two"), (2, "http://i/2", "<article>" + "<p>x</p>" * 20000 + "</article>")]
    rows = html.extract(spark.createDataFrame([(*p, "a", "b") for p in pages], "page_id long, url string, html string, host string, text string")).collect()
    assert Counter((r.page_id, len(r.text), r.text[:7]) for r in rows) == {(1, 9, "deep te"): 2, (None, 7, "one two"): 1, (2, 39999, "x x x x"): 1}


def test_html_empty(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# 3 ------------------------------------------------------------------------------------------------


def test_quality(spark, documents, nothing):
    rows = [tuple(r) for r in documents.collect()]
    documents.createOrReplaceTempView("quality_documents")
    out = quality.cascade(documents, metrics=True)
    base = quality.rejects(quality.BASE[0]) | quality.rejects(quality.BASE[1])
    got = {r[0]: tuple(r[1:]) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, "kept").collect()}
    want = {r[0]: tuple(r[1:]) for r in oracle(quality.ORACLE["op3_quality_rules"], rows)}
    assert got == want
    lazy = {r.doc_id: r.kept for r in quality.cascade(documents).collect()}
    assert lazy == {k: v[-1] for k, v in want.items()}
    assert quality.cascade(nothing).collect() == []


def test_quality_plan_is_native(documents):
    plan = quality.cascade(documents, metrics=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_order_is_conditional():
    """Rule 1 rejects most, but nothing beyond rule 0, which is cheap: after rule 0, rule 2 comes first."""
    patterns = {0b011: 50, 0b001: 10, 0b100: 5, 0b000: 100}
    assert quality.greedy([1.0, 1.0, 1.0], patterns) == [0, 2, 1]
    assert quality.greedy([100.0, 1.0, 0.01], patterns) == [2, 1, 0]
    assert quality.greedy([1.0, 1.0], {}) == [0, 1]


def test_quality_nulls_repeats_and_sample_over_the_table(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(None, good, 1), (None, good, 1), (1, None, 1), (1, "a", 1)]
    out = quality.cascade(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert sorted([(r.doc_id, r.kept) for r in out], key=str) == sorted([(None, True), (None, True), (1, False), (1, False)], key=str)
    many = spark.range(4000).repartition(8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, good).otherwise("x").alias("text"))
    (share,) = [s for rule, _, s in quality.order_rules(many, quality.RULES) if rule[0] == "few_words"]
    assert 0.4 < share < 0.6


# 4 ------------------------------------------------------------------------------------------------


def kneser_ney_by_hand(trusted, queries, order):
    """Interpolated modified Kneser-Ney over bytes, straight from the definition."""
    counts = [None, *(Counter() for _ in range(order))]
    for t in trusted:
        data = bytes([2]) * (order - 1) + t.encode()
        for i in range(len(data) - order + 1):
            counts[order][data[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    cuts = [None]
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        if not (n[1] and n[2]):
            cuts.append((0.5, 1.0, 1.5))
            continue
        y = n[1] / (n[1] + 2 * n[2])
        ds = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2] if n[3] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] and n[4] else 1.5)
        cuts.append(tuple(d if 0 < d < j + 1 else 0.5 * (j + 1) for j, d in enumerate(ds)))
    sums = [None, *(defaultdict(lambda: [0, 0.0]) for _ in range(order))]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            s = sums[k][g[:-1]]
            s[0] += c
            s[1] += cuts[k][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        k, total = len(g), sums[len(g)].get(g[:-1])
        if total is None:
            return p(g[1:])
        c = counts[k].get(g, 0)
        own = max(c - cuts[k][min(c, 3) - 1], 0) / total[0] if c else 0.0
        return own + total[1] / total[0] * p(g[1:])

    out = []
    for t in queries:
        data = bytes([2]) * (order - 1) + t.encode()
        grams = [data[i : i + order] for i in range(len(data) - order + 1)]
        out.append(math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)) if grams else None)
    return out


def test_kneser_ney(documents, nothing):
    rows = documents.collect()
    trusted = F.col("doc_id") % 2 == 0
    scored = kneser_ney.score_kneser_ney(documents, trusted).collect()
    got = {r.doc_id: r for r in scored}
    assert all((r.trusted or r.held_out) == (r.doc_id % 2 == 0) and not (r.trusted and r.held_out) for r in scored)
    assert any(r.held_out for r in scored)
    texts = [r.text or "" for r in rows]
    want = kneser_ney_by_hand([r.text or "" for r in rows if got[r.doc_id].trusted], texts, kneser_ney.ORDER)
    for r, w in zip(rows, want, strict=True):
        assert (got[r.doc_id].perplexity is None) == (w is None)
        assert w is None or got[r.doc_id].perplexity == pytest.approx(w, rel=3e-6)
    judged = kneser_ney.classify(kneser_ney.score_kneser_ney(documents, trusted)).collect()
    assert all(r.kept == (r.perplexity is not None and r.perplexity <= r.threshold) for r in judged)
    nobody = kneser_ney.classify(kneser_ney.score_kneser_ney(documents, F.lit(False))).collect()
    assert all(r.kept == (r.perplexity is not None) for r in nobody)
    assert kneser_ney.score_kneser_ney(nothing, trusted).collect() == []


def test_classifier_thresholds(spark, monkeypatch):
    """Thresholds are quantiles of held-out documents of a language; null languages are one; few of them: all languages."""
    monkeypatch.setattr(kneser_ney, "LEAST", 20)
    rows = [(i, lang, False, True, 5, float(i)) for lang, lo in ((None, 0), ("en", 100)) for i in range(lo, lo + 30)]
    rows += [(200 + i, "de", True, False, 5, 500.0 + i) for i in range(30)] + [(300, "de", False, False, 0, None)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, trusted boolean, held_out boolean, n_symbols long, perplexity double")
    got = {r.doc_id: (r.threshold, r.kept) for r in kneser_ney.classify(frame, quantile=0.5).collect()}
    assert got[0] == (14.0, True) and got[29] == (14.0, False) and got[100] == (114.0, True) and got[129] == (114.0, False)
    assert got[200] == (29.0, False) and got[300] == (29.0, False)
    monkeypatch.setattr(kneser_ney, "LEAST", 1000)
    assert {r.threshold for r in kneser_ney.classify(frame, quantile=1.0).collect()} == {529.0}


def test_kneser_ney_nulls_and_repeats(spark):
    rows = [(None, "a b", None, 1), (None, "a b", None, 1), (3, "a b", "en", 1), (3, "", "en", 1), (4, None, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, trusted int")
    got = kneser_ney.classify(kneser_ney.score_kneser_ney(frame, F.lit(True))).collect()
    assert sorted([(r.doc_id, r.lang, r.n_symbols, r.kept) for r in got], key=str) == sorted([(None, None, 3, True)] * 2 + [(3, "en", 3, True), (3, "en", 0, False), (4, None, 0, False)], key=str)


# 5 ------------------------------------------------------------------------------------------------


def dedup_by_hand(docs, k=13):
    first = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = words(t)
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("frequent", [4096, 3, 0])
def test_substring(documents, nothing, monkeypatch, frequent):
    monkeypatch.setattr(substring, "FREQUENT", frequent)  # 0: every prefix is lengthened up to the window; 3: some are
    got = {r.doc_id: r for r in substring.dedup_substrings(documents, keep=("kept", "chunk", "lang")).collect()}
    want = dedup_by_hand([(r.doc_id, r.text) for r in documents.collect()])
    assert {d: (r.n_words, r.n_removed, r.kept_text) for d, r in got.items()} == want
    for r in got.values():
        assert sum(s.n for s in r.removed_spans) == r.n_removed and r.chunk == "x" and r.kept is None
    assert substring.dedup_substrings(nothing).collect() == []


def test_suffix_array_and_deep_nodes():
    rng = np.random.default_rng(0)
    words_, cut = rng.integers(0, 3, 300).astype(np.uint64), np.sort(rng.choice(np.arange(1, 300), 20, replace=False))
    left = np.concatenate([np.arange(n, 0, -1) for n in np.diff([0, *cut, 300])])
    starts = np.flatnonzero(left >= 4)
    order, shared = substring.suffix_array(words_, left, starts)
    suffix = [words_[i : i + left[i]].tolist() for i in starts]
    rank = {w: k for k, w in enumerate(sorted(set(words_.tolist())))}
    assert [[rank[w] for w in suffix[i]] for i in order] == sorted([rank[w] for w in x] for x in suffix)
    for k in range(1, len(order)):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    groups = {tuple(sorted(starts[order[a : a + n]])) for a, n in zip(*substring.deep_nodes(shared, 4))}
    by_hand = defaultdict(list)
    for i, x in zip(starts, suffix):
        by_hand[tuple(x[:4])].append(i)
    assert groups == {tuple(v) for v in by_hand.values()}


def test_substring_nulls_and_repeats(spark):
    text = " ".join(f"x{i}" for i in range(20))
    rows = [(None, text), (5, text), (5, text), (3, text + " end"), (None, None)]
    got = sorted(((r.doc_id, r.n_removed) for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 20), (5, 20), (5, 20), (3, 0), (None, 0)], key=str)


# 6 ------------------------------------------------------------------------------------------------


def shingle_set(text, n=5):
    w = words(text, True)
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components_by_hand(docs, percent=75):
    sets = [(d, shingle_set(t)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard(spark, nothing, seed):
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(60)]
    docs = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c")]
    for i in range(5, 120):  # chains of edits around the threshold, and documents that share half of their text
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(60)] = f"e{i}{rng.randrange(9)}"
        docs.append((i, " ".join(w if i % 3 else w[:25] + [f"u{i}_{j}" for j in range(rng.choice([5, 20, 40]))])))
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, id string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect()}
    assert got == components_by_hand(docs)
    if seed == 1:
        assert jaccard.jaccard_components(nothing).collect() == []


def test_jaccard_null_ids_and_repeats(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "q r s t u")]
    got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (8, 1, 8)], key=str)


def test_jaccard_sends_copies_of_a_chunk_once():
    """5,000 copies, some texts more than once and empty texts: one row for each distinct set, of the smallest id."""
    import pyarrow as pa

    from tickforge.llm import chunks

    texts = ["one two three four five six"] * 5000 + ["", "a b", "A  b", "x y z"]
    ids = np.arange(len(texts), dtype=np.int64)[::-1].copy()
    body = "\n".join([*texts, ""]).encode()
    row = {"chunk": [3], "ids": [ids.tobytes()], "ends": [np.cumsum([len(t) + 1 for t in texts], dtype=np.int64).tobytes()], "body": [chunks.zstandard.compress(body)]}
    (out,) = list(jaccard._collapsed(5, 4)(iter([pa.RecordBatch.from_pydict(row)])))
    asked = np.concatenate([np.frombuffer(x["vals"], jaccard._ROW) for x in out["asked"][0].as_py()])
    assert sorted(asked["id"].tolist()) == [0, 1, 4] and sorted(asked["nth"].tolist()) == [0, 1, 2]


# 7 ------------------------------------------------------------------------------------------------


def test_string_kernel_matches_definition():
    s = toxicity.Strings([b"idiot clown idxiot", b"clown", b""])
    def phi(word):
        c = [1, *(toxicity.CODE[b] for b in word)]
        out = Counter()
        for i, j, k in itertools.combinations(range(len(c)), 3):
            if k - i <= toxicity.SPAN:
                out[(c[i], c[j], c[k])] += toxicity.DECAY ** (k - i + 1)
        return out, float(toxicity.self_kernel(np.array([len(word)]))[0])

    names = {}
    for w in (b"idiot", b"clown", b"idxiot"):
        names[toxicity.Strings([w]).hashes[0]] = w
    order = [names[h] for h in s.hashes]
    got = toxicity.kernel(s, np.arange(3), np.arange(3))
    for i, j in itertools.product(range(3), repeat=2):
        (a, na), (b, nb) = phi(order[i]), phi(order[j])
        assert got[i, j] == pytest.approx(sum(a[t] * b[t] for t in a) / math.sqrt(na * nb))


def test_toxicity_learns_and_tolerates_gaps(spark):
    rng = random.Random(5)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es"]

    def clean():
        return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))]

    def toxic():
        w = clean()[0].split()
        w[rng.randrange(len(w))] = rng.choice(["idiot", "moron", "scumbag"])
        return [" ".join(w)]

    rows = [(i, *(toxic() if i % 3 == 0 else clean()), int(i % 3 == 0)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, y int")
    machine = toxicity.train(frame, frame.filter("doc_id < 400").select("doc_id", F.col("y").alias("label")))
    tests = [(1000, "the ren idi-ot hand"), (1001, "heren mo.ron then"), (1002, "i d i o t"), (1003, None), (1004, "then heren an")]
    out = {r.doc_id: r.score for r in toxicity.score(frame.filter("doc_id >= 400").select("doc_id", "text").union(spark.createDataFrame(tests, "doc_id long, text string")), machine).collect()}
    right = [(out[i] >= 0.5) == (y == 1) for i, _, y in rows[400:]]
    assert sum(right) >= 0.97 * len(right)
    assert all(out[i] > 0.5 for i in (1000, 1001, 1002)) and out[1003] < 0.5 and out[1004] < 0.5


def test_toxicity_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    """One id a thousand times and long texts: no more rows and bytes than the parameters say are learnt from."""
    rows = [(1, "clean words here", 0)] * 1000 + [(2, "an idiot here", 1), (3, "x" * 3000, 1), (None, "idiot", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", F.col("toxic").alias("label")).distinct()
    for sample, size in ((10, 1 << 20), (2000, 200)):
        machine = toxicity.train(frame, labels, sample, size)
        scores = toxicity.score(frame, machine).collect()
        assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)


def test_toxicity_without_labels(spark, nothing):
    machine = toxicity.train(nothing, nothing.select("doc_id", F.lit(1).alias("label")))
    assert toxicity.score(nothing, machine).collect() == []
    (row,) = toxicity.score(spark.createDataFrame([(None, "x y", "a")], "doc_id long, text string, score string"), machine).collect()
    assert row.doc_id is None and 0 <= row.score <= 1


# 8 ------------------------------------------------------------------------------------------------


def test_decontamination(spark, nothing):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(16, 40)))) for i in range(12)] + [(90, None), (91, "too short")]
    docs, expected = [], {}
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        kind = i % 4
        if kind:
            item = rng.randrange(12)
            leak = items[item][1].split()
            if kind == 2:  # every seventh word replaced
                leak = [x if j % 7 else rng.choice(vocabulary) for j, x in enumerate(leak)]
            if kind == 3:  # other case and punctuation
                leak = [x.upper() + "," for x in leak]
            w[5:5] = leak
            expected[i] = item
        docs.append((i, " ".join(w), "x"))
    docs += [(200, None, "x"), (None, "", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, items string").repartition(2)
    out = {r.doc_id: r for r in decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {d: list(r["items"]) for d, r in out.items() if r.contaminated} == {d: [i] for d, i in expected.items()}
    assert len(out) == len(docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.decontaminate(nothing, bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontaminate(frame, bench.limit(0)).collect())


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 6, 8, 15, 20, 40, 100])
def test_decontamination_finds_all_that_passes_the_rule(length):
    """Every fifth word or random words substituted, and whole short items, against the rule on the planted diagonal."""
    rng = random.Random(length)
    item = [f"item{i}" for i in range(length)]
    bench = decontaminate.Benchmark([(7, " ".join(item).encode())])
    for trial in range(60):
        away = set(range(trial % 5, length, 5)) if trial < 5 else set(rng.sample(range(length), rng.randint(0, length // 3)))
        equal = np.array([i not in away for i in range(length)])
        a, b = decontaminate.overlap(equal)
        n = int(equal[a:b].sum())
        passes = n >= min(13, math.ceil(0.75 * length)) and n >= 0.75 * (b - a)
        words = ["before"] * 4 + [f"other{i}" if i in away else w for i, w in enumerate(item)] + ["after"] * 4
        found = list(bench.found(*decontaminate.normal_words([" ".join(words).encode()]), 1))
        assert [f[1:] for f in found] == ([(7, a + 4, b - a, n)] if passes else []), (length, away)


def fits(equal, mask):
    return any(all(equal[i + k] for k, c in enumerate(mask) if c == "1") for i in range(len(equal) - len(mask) + 1))


def test_spaced_mask_misses_no_overlap():
    """All ways in which the words of short items can be equal; beyond, the most equal words that a stretch without a place for the mask can have."""
    for length in range(1, 13):
        (mask,) = [m for m, least, most in decontaminate.MASKS if least <= length <= most]
        for bits in itertools.product([False, True], repeat=length):
            need = math.ceil(0.75 * length)
            if sum(bits) >= need and not fits(bits, mask):
                a, b = decontaminate.overlap(np.array(bits))
                assert sum(bits[a:b]) < need, bits
    (mask,) = [m for m, _, most in decontaminate.MASKS if most == math.inf]
    assert "0" in mask
    best = {bits: sum(bits) for bits in itertools.product([0, 1], repeat=len(mask) - 1)}
    for length in range(len(mask), 200):
        after: dict = {}
        for bits, n in best.items():
            for x in (0, 1):
                now = (*bits, x)
                if not fits(now, mask):
                    after[now[1:]] = max(after.get(now[1:], 0), n + x)
        best = after
        assert length < 13 or max(best.values()) < 13 or max(best.values()) < 0.75 * length, length


def test_decontamination_equals_all_diagonals(spark):
    """Every document against every item at every offset, without seeds; repeated rows, null ids and clashing columns too."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 12, 20])))) for i in range(25)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(None, items[7][1]), (3, items[9][1]), (3, items[9][1])]
    want = Counter()
    for d, text in docs:
        w, found = text.split(), set()
        for i, item in items:
            x = item.split()
            need = min(13, math.ceil(0.75 * len(x)))
            for offset in range(1 - len(x), len(w)):
                equal = np.array([0 <= offset + k < len(w) and w[offset + k] == x[k] for k in range(len(x))])
                lo, hi = max(0, -offset), min(len(x), len(w) - offset)
                a, b = decontaminate.overlap(equal[lo:hi])
                n = int(equal[lo:hi][a:b].sum())
                if n >= need and n >= 0.75 * (b - a):
                    found.add(i)
        want[d, text, tuple(sorted(found))] += 1
    frame = spark.createDataFrame([(d, t, 1, True) for d, t in docs], "doc_id long, text string, row int, contaminated boolean").repartition(3)
    got = decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.text, tuple(r["items"])) for r in got) == want
    assert all(r.row == 1 and r.contaminated == bool(r["items"]) for r in got)


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(30)]
    docs = spark.createDataFrame([(i, "pre " + t + " post") for i, t in items], "doc_id long, text string")
    found = decontaminate.find_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.n_equal) for r in found) == [(i, i, 1, 20) for i in range(30)]


# 9 ------------------------------------------------------------------------------------------------


def test_chat(spark):
    rng = random.Random(4)
    pieces = ["\\", "#", "###", "<", "</turn>", " </turn>\n", "a", " ", ": ", "\n", "### assistant: ", "é", "字", "<|endoftext|>", "👍", "\x00", "�"]
    rows = []
    for conv in range(40):
        turns = list(range(rng.randint(1, 6)))
        rng.shuffle(turns)
        for t in turns:
            rows.append((conv, t, rng.choice(["user", "assistant", "System", "a: ### b", None]), None if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))), "x"))
    rows += [(None, 0, "user", "no id", "x"), (41, None, "user", "null first", "x"), (41, 0, "assistant", "tie b", "x"), (41, 0, "assistant", "tie a", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame, path), path).collect()}
    by = defaultdict(list)
    for conv, t, role, text, _ in rows:
        by[conv].append((-1 if t is None else t, role or "unknown", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(frame.limit(0), path), path).collect() == []


def test_chat_of_one_long_conversation(spark):
    """One conversation over all ranges, repeated rows and a null id with many turns; lengths are those of the formatted strings in a row."""
    rows = [(7, t, "assistant" if t % 2 else "user", f"turn {t} " * (t % 5), 0) for t in range(2000)] + [(7, 5, "user", "twice", 0)] * 2 + [(None, t, "user", "x", 0) for t in range(300)] + [(9, 0, None, None, 0)]
    rows.append((8, 0, "assistant", "long " * 50000, 0))
    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int").repartition(4), path)
    got = {r.conv_id: r for r in chat.read_back(turns, path).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {7: 2002, None: 300, 9: 1, 8: 1}
    for conv in got:
        own = sorted((r.char_start, r.formatted, r.token_start, len(r.ids)) for r in turns.collect() if r.conv_id == conv)
        assert [a for a, *_ in own] == list(itertools.accumulate([0] + [len(f) for _, f, _, _ in own]))[:-1]
        assert [t for _, _, t, _ in own] == list(itertools.accumulate([0] + [n for *_, n in own]))[:-1]
        assert got[conv].formatted_chars == sum(len(f) for _, f, _, _ in own) and got[conv].n_tokens == sum(n for *_, n in own)


def test_chat_control_ids_cannot_come_from_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(1, 0, "assistant", "### user: hi </turn>\n <|endoftext|>")], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_turns(frame, path).collect()
    assert [i for i in row.ids if i >= 50257] == [50257, 50258, 50259] and 50256 not in row.ids
    assert chat.parse(row.formatted)[0][:2] == ("assistant", row.text)


def test_chat_range_keys_are_short_and_in_order(spark, monkeypatch):
    """Spark samples them to the driver; whole long texts there ended the run."""
    rng = random.Random(6)
    roles = ["user", "", "assistant", "r" * 64, "r" * 65, "r" * 64 + "a", "r" * 63]
    texts = ["", "a", "é", "字", "👍", "\x00", "t" * 63, "t" * 64, "t" * 65, "t" * 64 + "é", "long " * 50000]
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, 0, 1]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    keys = []
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda self, n, *cols, f=type(spark.range(0)).repartitionByRange: keys.append(cols) or f(self, n, *cols))
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.n_turns for r in chat.read_back(chat.format_turns(frame, path), path).collect()} == set(Counter(c for c, *_ in rows).values())
    got = [tuple(r) for r in frame.orderBy("conv_id", "turn", "role", "text").select(*keys[0]).collect()]
    assert max(len(x or "") for r in got for x in r[2:]) <= 64
    order = [tuple((x is not None, x.encode() if isinstance(x, str) else x or 0) for x in r) for r in got]
    assert order == sorted(order) and len(set(order)) > 100


CHAT_MEMORY = """
import re, types
import public_tokenizers, pyarrow as pa, pyspark
from tickforge.llm import chat

def peak():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

pyspark.TaskContext.get = classmethod(lambda cls: types.SimpleNamespace(partitionId=lambda: 0))
path = public_tokenizers.path("byte_bpe_50k.json")
words = [f"word{i}" for i in range(5000)]
texts = [" ".join(words[(i * 31 + k * 17) % 5000] for k in range(100)) for i in range(10000)]
batch = pa.RecordBatch.from_arrays([pa.array([i // 8 for i in range(10000)]), pa.array(range(10000)), pa.array(["user", "assistant"] * 5000), pa.array(texts)], ["conv_id", "turn", "role", "text"])

def formatted(batch):
    whole = pa.concat_batches([*chat._format(path)(iter([batch]))]).select(["conv_id", "formatted", "ids", "loss"])
    return whole.append_column("char_start", whole["conv_id"]).append_column("token_start", whole["conv_id"])

def read(batch):
    return sum(x.num_rows for x in chat._read_turns(path)(iter([batch])))

read(formatted(batch.slice(0, 8)))
before = peak()
whole = formatted(batch)
made = peak()
assert read(whole) == 10000
print(made - before, peak() - made)
"""


def test_chat_memory_of_a_batch():
    """Neither 10,000 turns at once nor threads: a worker's memory grows by little more than the batch that comes or goes."""
    run = subprocess.run([sys.executable, "-c", CHAT_MEMORY], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    made, read = map(float, run.stdout.split())
    assert made < 60 and read < 40


def test_chat_slices_are_bounded_and_whole():
    texts = ["x" * n for n in (0, 10, chat.BYTES + 5, 1, chat.BYTES // 2, chat.BYTES // 2, 1)] + [None] * (chat.ROWS + 3)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["r"] * len(texts))], ["text", "role"])
    got = list(chat._slices(batch, "text", "role"))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]).combine_chunks()) and all(0 < x.num_rows <= chat.ROWS for x in got)
    assert all(x.num_rows == 1 or sum(len(t or "") for t in x["text"].to_pylist()) + x.num_rows <= chat.BYTES for x in got)
    assert list(chat._slices(batch.slice(0, 0), "text")) == []


# 10 -----------------------------------------------------------------------------------------------


def test_hmm_recursions_match_enumeration():
    rng = np.random.default_rng(0)
    k, n = 3, 6
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k), rng.dirichlet(np.ones(n), size=k).T.copy())
    size = np.array([1, 4, 2, 4, 5])
    flat, first = rng.integers(0, n, size.sum()), np.cumsum(size) - size
    want, likelihood = np.zeros(k + k * k + n * k), np.zeros(5)
    for i in range(5):
        x = flat[first[i] : first[i] + size[i]]
        total, part = 0.0, np.zeros_like(want)
        for path in itertools.product(range(k), repeat=len(x)):
            w = model.start[path[0]] * model.emit[x[0], path[0]]
            for t in range(1, len(x)):
                w *= model.move[path[t - 1], path[t]] * model.emit[x[t], path[t]]
            total += w
            part[path[0]] += w
            for t, s in enumerate(path):
                part[k + k * k + x[t] * k + s] += w
            for a, b in itertools.pairwise(path):
                part[k + a * k + b] += w
        want += part / total
        likelihood[i] = math.log(total)
    got, logs = 0.0, np.zeros(5)
    for own, lengths, block in hmm._batches(flat, first, size):
        got = got + hmm.expected(model, lengths, block)
        logs[own] = hmm.forward(model, lengths, block)
    assert np.allclose(got[:-1], want, atol=1e-5) and np.allclose(logs, likelihood)
    assert got[-1] == pytest.approx(likelihood.sum(), rel=1e-5)


def test_hmm(documents, nothing):
    rows = documents.collect()
    train = F.col("doc_id") % 3 != 0
    got = {r.doc_id: r for r in hmm.score_hmm(documents, train, states=4, rounds=3).collect()}
    tokens = {r.doc_id: [*words(r.text, True), "\0end"] for r in rows}
    c = Counter(t for d, ts in tokens.items() if d % 3 for t in ts)
    n, v = sum(c.values()), len(c)
    for d, ts in tokens.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ts), sum(c[t] > 0 for t in ts), n, d % 3 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts))
        assert r.score < 0
    learned = [r for r in got.values() if not r.held_out]
    assert sum(r.score for r in learned) > sum(r.base_score for r in learned)
    assert hmm.score_hmm(nothing, train).collect() == []


def test_hmm_likelihood_rises_with_rounds_and_score_is_the_model(spark, monkeypatch):
    """Two alternating word classes: training finds them, and scores are the forward recursion of the model it returns, by hand."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("a", "b", "c") if j % 2 else ("x", "y", "z")) for j in range(rng.randint(2, 30))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {}
    train = hmm.baum_welch

    def watched(classes, unigram, states, rounds):
        kept["model"], kept["likelihoods"] = train(classes, unigram, states, rounds)
        kept["unigram"] = unigram
        return kept["model"], kept["likelihoods"]

    monkeypatch.setattr(hmm, "baum_welch", watched)
    scores = {r.doc_id: r.score for r in hmm.score_hmm(frame, F.lit(True), states=3, rounds=12).collect()}
    rises = np.diff(kept["likelihoods"])
    assert (rises > -1e-3 * abs(kept["likelihoods"][0])).all() and rises.sum() > 0.05 * abs(kept["likelihoods"][0])
    model, tokens = kept["model"], [[*t.split(), None] for t in texts]
    hashes = {w: hash_words(np.frombuffer(w.encode(), np.uint8))[2][0] for w in "abcxyz"}
    order = sorted(hashes, key=lambda w: hashes[w])
    kind = {w: order.index(w) for w in order} | {None: hmm._KINDS - 1}
    for d in range(20):
        a, total = model.start, 0.0
        for t, w in enumerate(tokens[d]):
            a = (a @ model.move if t else a) * model.emit[kind[w]]
            total += math.log10(a.sum())
            a = a / a.sum()
        assert scores[d] == pytest.approx(total, rel=1e-6)


def test_hmm_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a b", 1), (None, None, 1), (5, "a b", 1), (5, "a b", 1), (2, "a" * 5000 + " b" * 5000, 1)]
    out = hmm.score_hmm(spark.createDataFrame(rows, "doc_id long, text string, held_out int"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2, states=2, rounds=2).collect()
    assert sorted((r.n_tokens for r in out)) == [1, 3, 3, 3, 5002] and all(r.score < 0 for r in out)
    assert len({r.score for r in out if r.n_tokens == 3}) == 1 and all(r.held_out in (True, False) for r in out)


def test_hmm_is_a_distribution(spark):
    """The probabilities of all texts of one word, known or not, and of no word, sum to at most 1 and near it with more words."""
    rows = [(i, t) for i, t in enumerate(["a b", "a", "b b a", "", "c a"])]
    frame = spark.createDataFrame(rows + [(100, "a"), (101, "b"), (102, "c"), (103, "unseen"), (104, "")], "doc_id long, text string")
    out = {r.doc_id: r.score for r in hmm.score_hmm(frame, F.col("doc_id") < 100, states=2, rounds=2).collect()}
    assert sum(10 ** out[i] for i in range(100, 105)) < 1


@pytest.mark.parametrize("schema", [SCHEMA])
def test_schema_has_clashing_names(schema):
    assert {"kept", "chunk"} <= {c.split()[0] for c in schema.split(", ")}


def test_a_written_table_asks_for_its_shuffles_to_be_deleted(spark):
    from tickforge.llm import storage

    before, seen = spark.conf.get(storage._CLEANUP), []
    with storage.shuffles_deleted(spark):
        seen.append(spark.conf.get(storage._CLEANUP))
    assert seen == ["true"] and spark.conf.get(storage._CLEANUP) == before
    table = storage.durable(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert sorted(r["count"] for r in table.collect()) == [142] * 1 + [143] * 6 and spark.conf.get(storage._CLEANUP) == before
