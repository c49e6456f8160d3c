"""Trained operators by held-out accuracy, chat formatting by round trip, and the pipeline stage by stage."""

import hashlib
import math
import shutil
import tempfile
import time
import tracemalloc
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from platelume.llm import chat, html_text, language, quality, queries, toxicity

from .test_pairs import CLASH, ODD, clashing, docs, slow_classes, slow_hits, slow_print

BIG = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


def ratio(rows, label, key):
    return sum(r[key] == r[label] for r in rows) / len(rows)


@pytest.mark.parametrize(("query", "label", "recall", "precision"), [("op3_toxicity", "toxic", 0.75, 0.9), ("op5_quality", "quality", 0.98, 0.97)])
def test_scores_on_held_out_rows(spark, query, label, recall, precision):
    out = queries.QUERIES[query](spark, LARGE)
    assert out.count() == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    hit = sum(r[label] == r.predicted == 1 for r in rows)
    assert hit >= recall * sum(r[label] == 1 for r in rows) and hit >= precision * sum(r.predicted == 1 for r in rows)


def test_toxicity_against_brute_force():
    texts = ["Abc abd", "", "x", "ABC\u0130 \u00e9\u03a3 end", "long text " * 30]
    seen = np.zeros(toxicity.BUCKETS, np.int32)

    def bucket(gram):
        h, mask = 0, (1 << 64) - 1
        for c in gram:
            h = (h * 0x100000001B3 + ord(c)) & mask
        k = 0x9E3779B97F4A7C15
        return ((((h ^ h >> 29) * k + len(gram)) & mask) * k & mask) >> 64 - toxicity.BITS

    def slow_set(text):
        low = text.lower()
        return {bucket(low[i : i + n]) for n in toxicity.NGRAMS for i in range(len(low) - n + 1)}

    for stretch in (7, 1 << 17):
        toxicity.STRETCH, kept = stretch, toxicity.STRETCH
        assert [set(toxicity.gram_set(t, seen).tolist()) for t in texts] == list(map(slow_set, texts))
        assert all(len(toxicity.gram_set(t, seen)) == len(slow_set(t)) for t in texts)
        toxicity.STRETCH = kept
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS), -0.5)
    for t in texts:
        z = -0.5 + sum(model.weights[b] for b in slow_set(t))
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(-z)))
    # a gram in 9 of 10 toxic and 1 of 90 clean texts, one as common in both, one never seen
    toxic, clean = np.array([9.0, 5.0, 0.0]), np.array([1.0, 45.0, 0.0])
    share, off = 0.1, (0.9 - 0.1) / np.sqrt(0.1 * 0.9 / 10)
    want = np.log((10 / 12) / (2 / 92)) * min(1, off / toxicity.SURE) ** 2
    assert toxicity.ratios(toxic, clean, 10, 100).tolist() == pytest.approx([want, 0, 0])


def test_factorisation_machine_against_pairs():
    """The sum-of-squares identity and the arrays against all pairs of features; statistics and gradient against plain code."""
    texts = ["Two words, TWO lines\nand | 5 more\nand | 5 more", "", "one", "\u00e9 \u00e9 \u00e9"]
    words, sizes, stats = quality.features(texts)
    assert sizes.tolist() == [7, 0, 1, 1] and stats.shape == (4, quality.STATS) and not stats[1].any()
    raw = texts[0].encode()
    assert stats[0, 0] == sum(65 <= b <= 90 for b in raw) / len(raw) and stats[0, 1] == 2 / len(raw)
    assert stats[0, 12:14].tolist() == pytest.approx([8 / 11, 2 / 3]) and stats[3, 7] == 6 / 8
    stats = np.column_stack((stats, [1.0, np.nan, 2.0, 3.0]))
    m = quality.Machine(np.sort(np.random.default_rng(1).normal(0, 1, (stats.shape[1], quality.BINS - 1)), axis=1))
    m.w, m.w0 = np.random.default_rng(4).normal(0, 0.3, len(m.w)), 0.1
    m.v = np.random.default_rng(5).normal(0, 0.3, m.v.shape)
    got = m.score(words, sizes, stats)
    at, x, starts = m.rows(words, sizes, stats)
    for d, (a, b) in enumerate(zip(starts, [*starts[1:], len(at)], strict=True)):
        p, v = at[a:b], x[a:b]
        pairs = sum(m.v[p[i]] @ m.v[p[j]] * v[i] * v[j] for i in range(len(p)) for j in range(i))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-(0.1 + m.w[p] @ v + pairs))))
    assert m.places(stats)[1, -1] == quality.WORDS + len(m.cuts) * (quality.BINS + 1) - 1


def test_models_take_ids_of_any_type(spark):
    own = spark.createDataFrame([(f"id-{i}", "nasty moron text" if i % 3 == 0 else "calm and kind text", i % 3 == 0, i) for i in range(300)], "doc_id string, text string, bad boolean, n_chars int")
    marks = own.select("doc_id", F.col("bad").cast("int").alias("toxic"), (~F.col("bad")).cast("int").alias("quality"))
    for out, label in ((toxicity.score(own, toxicity.train(own, marks)), "bad"), (quality.score(own, quality.train(own, marks), 0.5), "NOT bad")):
        assert out.filter(f"(predicted = 1) <> ({label})").count() == 0
    assert html_text.train(spark.createDataFrame([("p", "<article><p>x</article>")], "page_id string, html string")) is not None


def test_language_on_held_out_rows(spark):
    out = queries.op4_language(spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet"), "doc_id").collect()
    rows = [r for r in out if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert ratio(rows, "lang", "lang_pred") >= 0.95


def test_language_beside_a_tiny_one(spark):
    own = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text", "lang")
    text = "Tämä on lyhyt suomenkielinen teksti, jossa kerrotaan metsästä ja järvestä. Kesällä lapset uivat rannalla."
    tiny = next(i for i in range(10**9, 10**9 + 99) if zlib.crc32(str(i).encode()) % 4 != 2)
    plain, made = language.train(own), language.train(own.unionByName(spark.createDataFrame([(tiny, text, "fi")], own.schema)))
    assert {k: v for k, v in made.items() if k != "fi"} == plain and made["fi"] == text.lower().encode()
    assert not any(map(any, language.misses(tuple(b"x" * 99 for _ in plain)))) and language.misses((b"", b"a b" * 50))[1] == (0.0,) * len(language.LENGTHS)
    rows = [r for r in language.identify(own, made).collect() if r.held_out]
    assert ratio(rows, "lang", "lang_pred") >= 0.95
    new = spark.createDataFrame([(1, "Kesällä metsässä ja järven rannalla on lapset, ja lapset uivat rannalla.")], "doc_id long, text string")
    assert [r.lang_pred for r in language.identify(new, made).collect()] == ["fi"]


def test_language_beside_three_rows(spark):
    """Three rows of a rare language change no other language's accuracy by over 0.005."""
    own = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "text", "lang")
    ids = [i for i in range(10**9, 10**9 + 99) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    rare = spark.createDataFrame([(i, f"Tämä on lyhyt suomenkielinen teksti numero {i}, jossa kerrotaan metsästä.", "fi") for i in ids], own.schema)
    some = own.filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).sample(0.4, seed=3)

    def accuracy(made):
        rows = language.identify(some, made).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"))
        return {r.lang: r.a for r in rows.collect()}

    plain, beside = accuracy(language.train(own)), accuracy(language.train(own.unionByName(rare)))
    assert all(abs(plain[k] - beside[k]) <= 0.005 for k in plain) and min(plain.values()) >= 0.97


def test_language_against_plain_calls():
    known = {"aa": b"the quick brown fox jumps over the lazy dog " * 40, "bb": b"der schnelle braune fuchs springt ueber den hund " * 40, "cc": b"le renard brun rapide saute par dessus le chien " * 40}
    plain = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in known.values()]
    for text in ("The dog jumps", "Der Hund springt ueber", "le chien saute", "x", "The fox " * 200, "chien dog Hund"):
        calls = [[zstandard.ZstdCompressor(level=n, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for n in language.LEVELS] for d in plain]
        sizes = [sum(len(c.compress(text.lower().encode())) for c in cs) for cs in calls]
        lang, score, margin = language.judge(text, list(known), tuple(known.values()))
        first, second = sorted(sizes)[:2]
        assert sizes[list(known).index(lang)] == first and margin == pytest.approx((second - first) / second), text
        # of equals the alphabetically first
        assert lang == min(k for k, n in zip(known, sizes, strict=True) if n == first) and 0 <= score <= 1


def test_language_query_against_plain_calls(spark, sf):
    """Every document of sf0.001: its sizes with each trained dictionary by calls of the library, and the least."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = language.train(docs)
    plain = {k: [zstandard.ZstdCompressor(level=n, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for n in language.LEVELS] for k, d in made.items()}
    assert not any(map(any, language.misses(tuple(made.values())))) or len(set(map(len, made.values()))) > 1
    missed = dict(zip(made, language.misses(tuple(made.values())), strict=True))
    texts = dict(docs.select("doc_id", "text").collect())
    for r in queries.op4_language(spark, sf).collect():
        text = texts[r.doc_id] or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        raw = text.lower().encode()
        sizes = {k: sum(len(c.compress(raw)) for c in cs) - np.interp(len(raw), (0, *language.LENGTHS), (0.0, *missed[k])) for k, cs in plain.items()}
        assert sizes[r.lang_pred] == min(sizes.values()) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_query_against_plain_sums(spark, sf):
    """Every document of sf0.001: the weights of its character n-grams, one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    texts, ring = dict(docs.select("doc_id", "text").collect()), (1 << 64) - 1
    for r in queries.op3_toxicity(spark, sf).collect():
        low, found = (texts[r.doc_id] or "").lower(), set()
        for i in range(len(low)):
            h = 0
            for n, c in enumerate(low[i : i + 5], 1):
                h = (h * 0x100000001B3 + ord(c)) & ring
                found.add(((((h ^ h >> 29) * 0x9E3779B97F4A7C15 + n) & ring) * 0x9E3779B97F4A7C15 & ring) >> 46)
        z = model.intercept + sum(float(model.weights[b]) for b in found)
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(60, max(-60, z)))), abs=1e-9) and r.predicted == int(r.score >= 0.5)


def test_empty_tables_of_models(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, toxic int, quality int")
    assert language.train(none) == {} and language.identify(none.drop("lang"), {"aa": b"abc"}).count() == 0
    assert quality.score(none, quality.train(none, none)).count() == 0 and toxicity.score(none, toxicity.train(none, none)).count() == 0


def test_models_lose_no_column(spark):
    own = clashing(spark)
    bad = toxicity.train(own.withColumn("toxic", F.lit(0)), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    for out, gone in ((toxicity.score(own, bad), toxicity.OUT), (quality.score(own, quality.train(own, spark.createDataFrame([(1, 0)], "doc_id long, quality int"))), quality.OUT), (language.identify(own, {"aa": b"abc"}), language.OUT)):
        rows = out.collect()
        assert len(rows) == len(ODD) and all(r[c] == c for r in rows for c in CLASH if c.lower() not in gone)
    kept = toxicity.drop_toxic(own, bad).collect()
    assert len(kept) == len(ODD) and all(r[c] == c for r in kept for c in CLASH)


def test_language_sample_of_repeated_rows(spark):
    """Thousands of rows of one id, or without an id, take no language's place; copies of a text count once."""
    own = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text", "lang")
    plain = language.train(own)
    assert set(plain) == {"de", "en", "es", "fr"}
    for id_ in (1, 2, 5, None):
        many = spark.range(6000).select(F.lit(id_).cast("long").alias("doc_id"), F.concat(F.lit("the same words again "), F.col("id") % 3).alias("text"), F.lit("en").alias("lang"))
        made = language.train(own.unionByName(many))
        assert set(made) == set(plain) and min(map(len, made.values())) > language.DICT_BYTES - 5000
        assert {k: v for k, v in made.items() if k != "en"} == {k: v for k, v in plain.items() if k != "en"}


def test_language_learns_from_whole_texts(spark):
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 != 2][:400]
    # an opening, a middle and an end of their own, beyond what a piece or its cut holds
    rows = [(i, f"{i} " + "opening " * 400 + "middle " * 400 + "ending " * 400, "aa") for i in ids] + [(i, f"{i} " + "start " * 200 + "finish " * 200, "bb") for i in ids]
    made = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(w in made["aa"] for w in (b"opening opening", b"middle middle", b"ending ending"))
    assert all(w in made["bb"] for w in (b"start start", b"finish finish"))
    same = language.train(spark.createDataFrame([(i, "x" + "copied text " * 900, "aa") for i in ids], "doc_id long, text string, lang string"))
    assert len(same["aa"]) <= language.PIECE


def test_models_defined_cases(spark):
    own, none = docs(spark), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    bad = toxicity.train(own, none)
    for out in (toxicity.score(own, bad), quality.score(own, quality.train(own, none))):
        assert out.count() == len(ODD) and out.filter("score > 0.01 or predicted = 1").count() == 0
    assert toxicity.drop_toxic(own, bad).columns == own.columns
    assert toxicity.score(docs(spark, []), bad).count() == 0
    langs = own.withColumn("lang", F.when(F.col("doc_id") > 4, "aa").otherwise("bb"))
    got = language.identify(own, language.train(langs)).collect()
    assert len(got) == len(ODD)
    assert {r.lang_pred for r in got if not (r.text or "").strip()} == {"und"}
    assert {r.lang_pred for r in got if (r.text or "").strip()} <= {"aa", "bb"}
    assert {r.lang_pred for r in language.identify(own, {}).collect()} == {"und"}


def test_extraction_agrees_with_markup(spark):
    pages = spark.read.parquet(f"{BIG}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op1_html_text(spark, BIG).collect()}
    assert len(got) == len(pages)
    for p in pages:
        own = html_text.blocks(p.html or "")
        want = "\n\n".join(t for (_, t, _), y in zip(own, html_text.markup_labels(own), strict=True) if y) if own else ""
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


class Reader(HTMLParser):
    """Main text by the standard library's parser: what stands in an article or main element and in no container of other things there."""

    BLOCK = set("p h1 h2 h3 h4 h5 h6 li ul ol div section article main nav header footer aside form table tr td th blockquote pre title body html head figure figcaption dl dt dd label button".split())
    OTHER = set("nav footer aside form script style noscript title".split())
    NAMES = ("sidebar", "menu", "nav", "ad", "ads", "advert", "banner", "promo", "cookie", "notice", "comment", "comments", "newsletter", "footer", "share", "related", "consent")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts, self.out = [], [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        inside = max((i for i, (t, _) in enumerate(self.stack) if t in ("article", "main")), default=-1)
        if text and inside >= 0 and not any(t in self.OTHER or set(c) & set(self.NAMES) for t, c in self.stack[inside + 1 :]):
            self.out.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        if tag in self.BLOCK:
            self.cut()
            while self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
            if tag == "li" and self.stack and self.stack[-1][0] == "li":
                self.stack.pop()
        self.stack.append((tag, " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower().split()))

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.cut()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if not self.stack or self.stack[-1][0] not in ("script", "style"):
            self.parts.append(data)


def test_extraction_agrees_with_another_parser(spark):
    got = {r.page_id: r.text for r in queries.op1_html_text(spark, BIG).collect()}
    pages = spark.read.parquet(f"{BIG}/pages.parquet").collect()
    differ = []
    for p in pages:
        reader = Reader()
        reader.feed(p.html or "")
        reader.close()
        reader.cut()
        if "\n\n".join(reader.out) != got[p.page_id]:
            differ.append((p.page_id, reader.out, got[p.page_id]))
    assert not differ, differ[:2]


def test_attributes_and_pages_that_take_long():
    """Quotes count where a value begins; open quotes, deep nesting and tags that never end take time and memory in proportion to the page."""
    texts = lambda html: [t for _, t, _ in html_text.blocks(html)]
    assert texts("<article><p><a title=don't>One</a> two</p><p>He's here</p><p>three</p></article>") == ["One two", "He's here", "three"]
    assert texts("""<p a = "x>y" b='>' c=d"e f=>One<p g"h='i'>two</p k=">">three""") == ["One", "two", "three"]
    assert texts("<p>One<p a='no <p>two") == ["One<p a='no", "two"] and texts("a < b<p>c <d") == ["a < b", "c"]
    for page in ("<p '" * 16_384, '<p a="x' * 9_000, "<p a='" * 10_001, "<!" * 30_000, "<p <" * 15_000 + ">", "<x>" * 9_000 + "</y>" * 9_000, "<div>" * 9_000 + "<p>x" * 9_000):
        began = time.time()
        html_text.Labeller().label(html_text.features([html_text.blocks(page)]))
        assert time.time() - began < 10
    tracemalloc.start()
    own = html_text.blocks("<div>" * 4_000 + "<p>x" * 4_000)
    html_text.Labeller().label(html_text.features([own]))
    assert len(own) == 4_000 and len(list(own[-1][0])) == 4_001 and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert html_text.markup_labels(html_text.blocks("<article><div>" * 3_000 + "One<nav>no</nav><article>two")).tolist() == [1, 0, 1]


def test_labeller_against_a_plain_loop():
    """The network step by step for one page, alone and beside others, in stretches of any size; its gradient by differences."""
    rng = np.random.default_rng(3)
    page = lambda n: (html_text.Chains(list(range(-1, n - 1)), [rng.integers(0, html_text.PATHS, 3) for _ in range(n)], rng.permutation(n).tolist()), rng.normal(0, 1, (n, html_text.WORD_DIM + html_text.COUNTS)).astype(np.float32))
    m, pages = html_text.Labeller(), [page(n) for n in (5, 1, 9)]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def slow(paths, rest):
        # each node lies below the one before it
        down = [paths.flat[: 3 * k + 3] for k in paths.at]
        x = [np.concatenate((m.p["path"][at].sum(axis=0) / np.sqrt(len(at)), r)) for at, r in zip(down, rest, strict=True)]
        states = {}
        for d in "fb":
            h = c = np.zeros(html_text.HIDDEN)
            for t in range(len(x)) if d == "f" else reversed(range(len(x))):
                i, f, o, g = np.split(x[t] @ m.p[f"wx{d}"] + h @ m.p[f"wh{d}"] + m.p[f"b{d}"], 4)
                c = sig(f) * c + sig(i) * np.tanh(g)
                h = sig(o) * np.tanh(c)
                states[d, t] = h
        return [float(sig(np.concatenate((states["f", t], states["b", t])) @ m.p["out"] + m.p["bias"][0])) for t in range(len(x))]

    for steps, cells in ((2, 4), (2048, 1 << 14)):
        html_text.STEPS, kept = steps, html_text.STEPS
        for own, want in zip(m.label(pages, cells=cells), pages, strict=True):
            assert own.tolist() == pytest.approx(slow(*want), abs=1e-4)
        html_text.STEPS = kept
    assert m.label([(html_text.Chains([], [], []), np.zeros((0, 1)))])[0].size == 0
    # the gradient of a path's mean by each of its places, by differences
    paths, table = pages[2][0], m.p["path"].astype(float)
    way, grad = rng.normal(0, 1, (9, html_text.PATH_DIM)), np.zeros_like(table)
    paths.spread(way, grad)
    for at in paths.flat[[0, 7, 26]].tolist():
        moved = table.copy()
        moved[at, 2] += 1e-3
        assert ((paths.means(moved) - paths.means(table)) * way).sum() / 1e-3 == pytest.approx(grad[at, 2], abs=1e-6)
    y = [np.array([1, 0, 0, 1, 1.0]), np.array([1.0]), np.zeros(9)]
    loss = lambda: -sum(np.log(np.where(b == 1, p, 1 - p)).sum() for p, b in zip(m.label(pages), y, strict=True))
    before = loss()
    m.fit(pages, y, rounds=30)
    assert loss() < before / 3


def test_a_page_of_many_blocks_stays_small():
    page = "<main>" + "".join(f"<p>para {i} of some words, yes.</p>" for i in range(30_000)) + "</main>"
    own = [html_text.blocks(page), *([html_text.blocks("<p>x")] * 63)]
    tracemalloc.start()
    out = html_text.Labeller().label(html_text.features(own))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out[0]) == 30_000 and len(out[1]) == 1 and peak < 100e6


def test_extraction_of_other_layouts(spark):
    pages = spark.read.parquet(f"{BIG}/pages.parquet")
    model = html_text.train(pages)
    html = (
        "<html><head><title>no</title><script>var x='<p>no</p>'</script></head><body><header>no</header><div class='sidebar'>no</div><main><h1>Yes &amp; yes</h1>"
        "<p>one<br>two &lt;b&gt;<p><b>three</b> <i>3</i>\n\t x<form><label>no</label></form><div class=comments><p>no thanks, never.</p></div></main><!-- no --><footer>no</footer>"
    )
    rows = [(1, html, 7), (2, None, 7), (3, "", 7), (4, "<p", 7), (5, "<<<>>>", 7), (None, html, 7), (6, html * 50, 7)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, TEXT int"), model).collect()
    by = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and by[2] == by[3] == by[4] == ""
    assert by[1] == by[None] == "Yes & yes\n\none two <b>\n\nthree 3 x"
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string"), model).count() == 0


def test_blocks_of_open_heads_and_skipped_elements():
    texts = lambda html: [t for _, t, _ in html_text.blocks(html)]
    for head in ("<html><head><title>T</title>", "<html><head><title>T<meta x>", "<head><title>T</title></head><body>", "<head><title>T<body>", "<title>T", "<head><title>A <p> & B</title><link x>"):
        assert texts(f"{head}<h1>One</h1><p>two<svg><title>no</title></svg><p>three") == ["One", "two", "three"], head
    assert texts("<head><title>T</title>\n Plain text<br>goes <b>on</b>") == ["Plain text goes on"]
    assert texts("<head><title>T</title><a href=x>One</a> two") == ["One two"]
    for odd in ("<svg class=i/>", '<svg class="i" />', "<svg class=i>", "<object data=x>", "<iframe src=x>", "<template>", "<noscript>", "<svg><g></svg>", "<svg>no<svg>no</svg>no</svg>", "<select><option>no</select>", "<script>'<svg>'</script>", "<textarea><p>no</textarea>"):
        assert texts(f"<body><div>menu {odd}</div><p>One</p><p>two</p><svg><text>no</text></svg><object>no</object>three") == ["menu", "One", "two", "three"], odd
    paths = {t: path for path, t, _ in html_text.blocks("<nav>menu<svg class=i></nav><article>One</article>")}
    assert "nav" in paths["menu"] and "nav" not in paths["One"]
    for own in ("template-card", "svg-icon", "object-view", "script-box", "style-guide", "title-bar"):
        assert texts(f"<body><{own} x=1>One</{own}><p>two") == ["One", "two"], own
    assert texts("<p>One<script>no <p>no") == ["One"] and texts("<p>One<style>no") == ["One"]


def test_chat_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    hard = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    want = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        turns, loss, n, form = want.get(conv, ("", "", 0, ""))
        want[conv] = (turns + f"{role}\n{text or ''}\n", loss + (text or "") * (role == "assistant"), n + 1, form + f"<turn {chat.escape(role)}>{chat.escape(text or '')}</turn>\n")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in queries.op7_chat_format(spark, sf).collect()}
    assert got == {k: (n, sha(t), len(x), sha(x), len(f)) for k, (t, x, n, f) in want.items()}
    pieces = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    text = {}
    for r in sorted(pieces, key=lambda r: (r.conv_id, r.seq)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.piece
    assert text == {k: v[3] for k, v in want.items()}


def test_chat_query_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want, got = con.sql(queries.ORACLE["op7_chat_format"]), queries.op7_chat_format(spark, sf)
    assert want.columns == got.columns
    assert sorted(want.fetchall()) == sorted(map(tuple, got.collect()))


def test_chat_defined_cases(spark):
    rows = [(1, None, None, None), (1, 2, "a>s<s", "x"), (1, 2, "a>s<s", "x"), (None, 1, "assistant", ""), (2, 1, "assistant", "é" * 70000)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"\n\n" + b"a>s<s\nx\n" * 2).hexdigest()
    assert got[None].n_turns == 1 and got[2].loss_chars == 70000
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty)).count() == 0


def render(source, **names):
    return "".join(p for p, _ in chat.compile_template(source)(names))


def test_template_language():
    assert render("{{ 'a' + 'b' | upper }}-{{ x.y }}{{ x.z }}", x={"y": 3}) == "aB-3"
    assert chat.fold(chat.parse("a{{ 'b' }}{% if 1 == 1 %}c{{ ' d ' | trim }}{% else %}{{ e }}{% endif %}f")) == [("text", "abcdf")]
    assert render("{% for m in ms %}{% if m == 'u' or m == 'v' %}1{% elif not m %}2{% else %}3{% endif %}{% endfor %}", ms=["u", "", "w", "v"]) == "1231"
    assert list(chat.compile_template("a{% generation %}b{{ c }}{% endgeneration %}")({"c": "d"})) == [("a", False), ("b", True), ("d", True)]
    assert render("{{ x.__class__ }}{{ x.upper }}", x="s") == ""
    for wrong in ("{{ f(x) }}", "{{ x | nope }}", "{% for a %}{% endfor %}", "{% if x %}", "{% endif %}", "{{ }}", "{% import os %}", "{{ 'a' 'b' }}", "{{ x[ }}", "{{ x", "{% set x %}", "{{ x is odd }}", "{# x"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(wrong)
    for s in ("", "\\", "\\l", "<\\<", "a\\\\g>", "</turn>\n"):
        assert chat.unescape(chat.escape(s)) == s and "<" not in chat.escape(s)


def test_template_language_of_chat_templates():
    turns = [{"role": "system", "text": "S"}, {"role": "user", "text": "U"}, {"role": "assistant", "text": "A"}]
    source = (
        "{% if messages[0].role == 'system' %}{% set sys = messages[0]['text'] %}{% set rest = messages[1:] %}{% endif %}[{{ sys }}]"
        "{%- for m in rest -%}\n {{ loop.index }}{{ m.text }}{% if not loop.last %},{% endif %} {%- endfor %}{{ '}}' }}{{ x is defined }}{{ x | default('d') }}{# c }} #}"
    )
    for messages in (turns, iter(turns)):
        assert render(source, messages=messages) == "[S]1U,2A}}Falsed"
    assert render("{{ 1 + 2 - 4 }} {{ 'a' ~ 1 }} {{ 3 > 2 and 'b' in 'abc' }} {{ -1 }} {{ xs[-1] }} {{ xs | join('-') }} {{ xs | length }}", xs=["p", "q"]) == "-1 a1 True -1 q p-q 2"
    assert render("{{ y.z is defined }} {{ y.q is defined }} {{ x is not none }} {{ 'x' is string }} {{ '%}' }}", y={"z": 1}) == "True False False True %}"
    assert render("{% for m in ms %}{% set n = m %}{% if loop.first %}<{% endif %}{{ n }}{% endfor %}{{ n is defined }}", ms=["a", "b"]) == "<abFalse"
    assert render("a {{- ' b ' -}}  c {%- if true -%} d {%- endif %} e") == "a b cd e"
    assert chat.fold(chat.parse("{{ 1 + 1 == 2 }}{% if 'a' in 'b' %}x{% endif %}")) == [("text", "True")]
    twice = chat.compile_template("{% for m in messages %}{{ m.role }}{% endfor %}{% for m in messages %}{{ m.text }}{% endfor %}")
    with pytest.raises(chat.TemplateError, match="one loop"):
        list(twice({"messages": chat.Stream(turns)}))
    with pytest.raises(chat.TemplateError):
        render("{% for m in ms %}{{ ms[0] }}{% endfor %}", ms=iter(["a"]))


def test_chat_ids_of_any_type_and_any_order(spark):
    rows = [("b", 1, "assistant", "x<y"), ("a", 0, "user", "hi"), ("a", 1, "assistant", "there"), (None, 0, "user", "")]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    pieces = chat.format_conversations(table)
    place = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/pieces"
    pieces.repartition(3, "seq").write.parquet(place)
    want = sorted(chat.read_back(pieces, sort=False).collect(), key=str)
    assert sorted(chat.read_back(spark.read.parquet(place)).collect(), key=str) == want and [r.n_turns for r in want] == [2, 1, 1]
    with pytest.raises(Exception, match="out of order"):
        chat.read_back(spark.read.parquet(place).repartition(1).orderBy(F.col("seq").desc()), sort=False).collect()


def test_stages_defined_cases(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names and empty tables, stage by stage."""
    place = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    own = clashing(spark)
    spark.createDataFrame([(1, 0), (6, 0)], "doc_id long, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e"), (2, None)], "item_id string, text string").write.parquet(f"{place}/benchmark.parquet")
    left = {"toxicity": 9, "exact_dedup": 5, "near_dedup": 4, "decontamination": 5, "bpe": 9}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, own, place).collect()
        assert len(rows) == left[name], name
        assert all(r[c] == c for r in rows for c in CLASH), name
        if name != "bpe":
            assert stage(spark, own, place).columns == own.columns
        assert stage(spark, clashing(spark, []), place).count() == 0
    own.write.parquet(f"{place}/documents.parquet")
    out = corpus_pipeline.run(spark, place)
    # one of the equal texts, the empty one and the blank one (of like fingerprint) as one, the long one, the last; the first is contaminated
    assert {r.doc_id for r in out.collect()} == {3, 6, 7} and "text" not in out.columns


def test_run_agrees_with_its_stages(spark):
    place = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for t in ("labels", "benchmark", "documents"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", f"{place}/{t}.parquet")
    docs_ = spark.read.parquet(f"{place}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, place)
    want = sorted(map(str, docs_.drop("text").collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, place).collect())) == want and want


def test_pipeline_stages(spark):
    stage = dict(corpus_pipeline.STAGES)
    first = spark.read.parquet(f"{BIG}/documents.parquet").limit(250).cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    clean = stage["toxicity"](spark, first, BIG).cache()
    assert clean.columns == first.columns
    gone = {r.doc_id for r in first.collect()} - {r.doc_id for r in clean.collect()}
    assert sum(labels.get(i) == 0 for i in gone) <= 3
    unique = stage["exact_dedup"](spark, clean, BIG).cache()
    texts = [r.text for r in clean.collect()]
    assert sorted(r.text for r in unique.collect()) == sorted(set(texts))
    near = stage["near_dedup"](spark, unique, BIG).cache()
    rows = sorted(unique.collect(), key=lambda r: r.doc_id)
    cls = slow_classes([slow_print(r.text) for r in rows])
    keepers = {}
    for r, c in zip(rows, cls, strict=True):
        keepers.setdefault(c, r.doc_id)
    assert sorted(r.doc_id for r in near.collect()) == sorted(keepers.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").collect()]
    sound = stage["decontamination"](spark, near, BIG)
    assert sorted(r.doc_id for r in sound.collect()) == sorted(r.doc_id for r in near.collect() if not slow_hits(r.text, items)[4])
    assert stage["bpe"](spark, near, BIG).count() == near.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
