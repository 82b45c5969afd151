"""Quality rules, language ID, licences, pages and language models against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from cases import EDGE_TEXTS, by_id
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.llm import language_id as lid
from siltworks.llm import license_scan as lic
from siltworks.llm.common import WordHashes, held_out
from siltworks.llm.html_extraction import extract_pages, main_text, smoothed
from siltworks.llm.license_texts import LICENSE_TEXTS
from siltworks.llm.lm_scoring import grams_of, log_gamma, score_texts
from siltworks.llm.quality_rules import quality_rules, script_of

WORD = re.compile("[^\x20\x09-\x0d]+")
VOCABULARIES = (P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)


def test_quality_counts(edge_docs, no_docs, documents):
    for docs, texts in ((edge_docs, EDGE_TEXTS), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        found = by_id(quality_rules(docs, *VOCABULARIES))
        for doc_id, text in texts:
            r = found[doc_id]
            counts = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            assert counts == plain_counts(text)
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules(no_docs, *VOCABULARIES).count() == 0


def test_quality_keeps_prose_and_rejects_noise(spark):
    rng = random.Random(1)
    words = ["river", "house", "the", "of", "morning", "light", "and", "walked", "toward", "small", "garden", "where", "children", "played", "until", "evening"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60, 400))), "en") for i in range(300)]
    rows += [(1000 + i, " ".join("".join(rng.choices("#%$&@!x7Q", k=6)) for _ in range(120)), "en") for i in range(10)]
    found = by_id(quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *VOCABULARIES))
    assert sum(found[i]["kept"] for i in range(300)) >= 297
    assert not any(found[1000 + i]["kept"] for i in range(10))


def test_scripts():
    assert [script_of(t) for t in ("12 é", "Ω", "ж", "東", "한", "", "123")] == ["Latin", "Greek", "Cyrillic", "Han", "Hangul", "None", "None"]


def test_language_id(documents, edge_docs, no_docs):
    is_held_out = held_out(F.col("doc_id"), 3, 1)
    model = lid.fit_language_model(documents, ~is_held_out)
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = lid.language_id(documents, model, is_held_out).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    edge = by_id(lid.language_id(edge_docs, model, is_held_out))
    for doc_id, text in EDGE_TEXTS:
        has_letter = any(map(str.isalpha, text or ""))
        assert (edge[doc_id]["lang_pred"] != "und") == has_letter and 0 <= edge[doc_id]["score"] <= 1
        assert has_letter or edge[doc_id]["score"] == 0
    assert lid.language_id(no_docs, model, is_held_out).count() == 0
    kept = lid.keep_accepted(edge_docs, model)
    assert kept.columns == edge_docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in EDGE_TEXTS if edge[i]["accepted"])
    assert lid.fit_language_model(no_docs, F.lit(True)) is None
    assert {r.lang_pred for r in lid.language_id(edge_docs, None, is_held_out).collect()} == {"und"}


def test_language_model_does_not_depend_on_the_order_of_rows(documents):
    """Repeated ids with other texts, missing ids and labels, rows in other partitions; a bound that drops ids before the choice."""
    odd = documents.select("doc_id", F.upper("text").alias("text"), "lang").filter("doc_id % 4 = 0")
    missing = documents.select(F.lit(None).cast("long").alias("doc_id"), F.lit("x y z").alias("text"), "lang")
    rows = documents.select("doc_id", "text", "lang").unionByName(odd).unionByName(missing)
    models = [lid.fit_language_model(r, F.lit(True), per_language=10) for r in (rows.coalesce(1), rows.orderBy(F.desc("text")).repartition(5))]
    words = ["the house by the river".encode(), "das Haus am Fluss".encode()]
    logits = [m.logits([lid.letters_of(w) for w in words]) for m in models]
    assert models[0].languages == models[1].languages and np.array_equal(*logits)
    labelled = {(r.doc_id, r.lang) for r in rows.filter("doc_id is not null and lang is not null and text is not null").collect()}
    assert {lang for _, lang in labelled} == set(models[0].languages)


def test_sliced_scores_equal_whole_ones(monkeypatch):
    rng = np.random.default_rng(5)
    model = lid.LanguageModel(["a", "b"], rng.normal(size=(lid.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    texts = [lid.letters_of(t) for t in (b"one", b"a", ("wörter über " * 200).encode(), b"two three")]
    whole = model.logits(texts)
    for i, text in enumerate(texts):
        buckets, counts = lid.counts_of(text)
        assert np.allclose(whole[i], (counts / counts.sum()) @ model.table[buckets], atol=1e-6)
    monkeypatch.setattr(lid, "SLICE_BYTES", 64)
    assert np.allclose(model.logits(texts), whole, atol=1e-6)


def test_licenses(edge_docs, no_docs):
    found = license_rows = [r.asDict() for r in lic.license_scan(edge_docs, LICENSE_TEXTS).collect()]
    assert [(r["doc_id"], r["license"], r["first_word"], r["n_words"]) for r in found] == [(16, "MIT-notice", 2, 5)] * 2, license_rows
    assert lic.license_scan(no_docs, LICENSE_TEXTS).count() == 0
    assert lic.license_scan(edge_docs, {}).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_license_matches_equal_brute_force(seed):
    """Notices with a few changed words at random places, in texts that share windows with others."""
    rng = random.Random(seed)
    hashes = WordHashes()
    templates = lic.build_templates(LICENSE_TEXTS, 0.8, 0.9999)
    texts, expected = [], set()
    for i in range(120):
        name, notice = rng.choice(sorted(LICENSE_TEXTS.items()))
        words = notice.split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join([f"a{rng.random()}" for _ in range(rng.randrange(90))] + words + ["z"] * rng.randrange(30)).encode())
        own = lic.plain_words(texts[-1])
        shingles = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        wanted = lic.plain_words(notice.encode())
        wanted = {tuple(wanted[k : k + 5]) for k in range(len(wanted) - 4)}
        if len(shingles & wanted) >= 0.8 * len(wanted):
            expected.add((i, name))
    found = {(m[0], m[1]) for m in lic.matches(texts, hashes, templates, 0.8)}
    sizes = {n: (g, t) for g, group in enumerate(templates.groups) for t, n in enumerate(group.names)}
    for i, name in expected:  # or a better match of the same size
        assert (i, name) in found or any(j == i and sizes[other][0] == sizes[name][0] for j, other in found)
    assert len(expected) > 40


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad -->
<div class="ad">Buy now, a very long advert text that goes on and on for many words indeed.</div>
<div class="cookie-notice">We use cookies.</div>
<article><h1>Fish &amp; chips</h1><p>First   paragraph with <b>bold
text</b> and &copy; signs.<p>Second &lt;one&gt;.</p><p>Ok.</p><form><input><p>Subscribe!</p></form>
<div id="comments"><p>Nice post</p></div></article><aside>Related things</aside><footer>&copy; me</footer></body></html>"""


def test_main_text_of_pages():
    expected = "Fish & chips\nFirst paragraph with bold text and © signs.\nSecond <one>.\nOk."
    assert main_text(PAGE) == expected
    assert main_text(PAGE.split("</article>")[0]) == expected
    assert main_text(PAGE.split("<aside>")[0] + "<footer cla") == expected
    body = "<body><div class='menu'>a b c</div><div><h2>Title</h2><p>" + "Words of the text. " * 9 + "</p><p>Short.</p></div><p>tail</p></body>"
    assert main_text(body) == "Title\n" + ("Words of the text. " * 9).strip() + "\nShort."
    assert main_text("") == main_text("<p></p>") == main_text("<nav>only</nav>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert main_text("<p>a<![foo bar]]><p>b") .startswith("a")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<>/!-[]&;ampdivnarticle \"'=\n"), max_size=80))
def test_any_page_gives_a_text(html):
    assert isinstance(main_text(html), str)


def test_smoothing_keeps_constants():
    assert np.allclose(smoothed(np.full(7, 3.0), 1.0), 3)


def test_extracted_pages(spark, sf_dir):
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (3, "u", PAGE, "x"), (3, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    found = by_id(extract_pages(odd), "page_id")
    assert found[1] == {"page_id": 1, "url": None, "text": "", "n_chars": 0} and found[2]["text"] == ""
    assert found[3]["n_chars"] == len(found[3]["text"]) > 50
    assert extract_pages(odd.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r.page_id: r.text for r in extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        if article:
            blocks = re.split(r"</?(?:p|h1)>", article[1])
            import html as h

            plain = [" ".join(re.split(r"[ \t\n\r\f\v]+", h.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)))).strip() for b in blocks]
            assert texts[r.page_id] == "\n".join(p for p in plain if p)


def plain_model(train, depth, texts):
    """log10 probability of spelled texts by a context tree over plain dictionaries."""
    counts, children = {}, {}

    def bits(data):
        for i, byte in enumerate(data):
            for k in range(8):
                node = (1 << k) | (byte >> (8 - k))
                context = bytes(data[max(0, i - depth) : i]).rjust(depth, b"\0")
                yield [(context[depth - d :], node) for d in range(depth + 1)], byte >> (7 - k) & 1

    for data in train:
        for path, bit in bits(data):
            for key in path:
                counts.setdefault(key, [0, 0])[bit] += 1
    for data in texts:
        for path, _ in bits(data):
            for above, below in zip(path, path[1:], strict=False):
                children.setdefault(above, set()).add(below)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted = {}

    def weigh(key):
        if key not in weighted:
            own = kt(*counts.get(key, (0, 0)))
            if len(key[0]) == depth:
                weighted[key] = own, 1.0
            else:
                x, y = own + math.log(0.5), sum(weigh(c)[0] for c in children[key]) + math.log(0.5)
                total = max(x, y) + math.log(math.exp(x - max(x, y)) + math.exp(y - max(x, y)))
                weighted[key] = total, math.exp(x - total)
        return weighted[key]

    out = {}
    for data in texts:
        score = 0.0
        for path, bit in bits(data):
            one, total, left = None, 0.0, 1.0
            for key in path:
                a, b = counts.get(key, (0, 0))
                stop, estimate = weigh(key)[1], (b + 0.5) / (a + b + 1)
                if one is None or a + b:
                    one = total + left * estimate
                    total, left = total + left * stop * estimate, left * (1 - stop)
            score += math.log10(one if bit else 1 - one)
        out[data] = score
    return out


@pytest.mark.parametrize(("heads", "depth"), [(0, 3), (4, 5), (1 << 17, 1), (1 << 17, 2), (1 << 17, 7), (30, 7)])
def test_scores_equal_a_plain_tree(spark, heads, depth):
    """Also where the tables of frequent tokens and grams are too small for all, or empty; contexts reach across words."""
    texts = [(1, "The cat sat"), (2, "the CAT ran"), (3, "a dog sat\ton"), (4, None), (5, ""), (6, "the the zebra ran é"), (7, "dog cat"), (8, "a dog sat\ton"), (8, "a dog sat\ton"), (None, "the end ÿþ \u0080x")]
    held = {6, 7}
    docs = spark.createDataFrame([(i, t, 3) for i, t in texts], "doc_id long, text string, row int").repartition(3)
    found = by_id(score_texts(docs, F.col("doc_id").isin(6, 7), depth=depth, head_tokens=heads, head_grams=heads))
    tokens_of = {i: [*(t or "").encode().lower().split(), b"\t"] for i, t in texts}
    train = Counter(w for i, t in texts if i not in held for w in tokens_of[i])
    n, v = sum(train.values()), len(train)
    spelled = {i: b" ".join(own) for i, own in tokens_of.items()}
    tree = plain_model([spelled[i] for i, _ in texts if i not in held], depth, set(spelled.values()))
    for i, own in tokens_of.items():
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(own), sum(w in train for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train.get(w, 0) + 1) / (n + v + 1)) for w in own))
        assert r["score"] == pytest.approx(tree[spelled[i]], rel=1e-9)
        assert r["bits_per_byte"] == pytest.approx(-tree[spelled[i]] * math.log2(10) / len(spelled[i]))


def test_the_tree_beats_the_base(spark):
    """On held-out texts, and more than nothing of it from contexts before the token."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    per_token = {}
    for depth in (3, 7):
        found = score_texts(docs, held_out(F.col("doc_id"), 7, 2), depth=depth).filter("held_out")
        per_token[depth] = found.agg(F.sum("base_score") / F.sum("n_tokens"), F.sum("score") / F.sum("n_tokens")).first()
    base, tree = per_token[7]
    assert tree > base and tree > per_token[3][1]


def test_grams_of_cut_texts():
    texts = [b"abcdefghij klm\t", b"\t", b"xy\t"]
    whole = [np.concatenate(c) for c in zip(*grams_of(texts, 7), strict=True)]
    cut = [np.concatenate(c) for c in zip(*grams_of(texts, 7, 3), strict=True)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    assert whole[1][2] == int.from_bytes(b"abc", "big") and len(whole[0]) == sum(map(len, texts))


def test_scores_of_odd_tables(edge_docs, no_docs):
    assert score_texts(no_docs, F.lit(False)).count() == 0
    untrained = by_id(score_texts(edge_docs, F.lit(True)))
    assert untrained[4]["score"] == pytest.approx(8 * (len("one two three") + 2) * math.log10(0.5)) and untrained[4]["train_tokens"] == 0
    trained = by_id(score_texts(edge_docs, held_out(F.col("doc_id"), 7, 2)))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in trained.values())
    with pytest.raises(ValueError):
        score_texts(no_docs, F.lit(False), depth=8)


def test_log_gamma(spark):
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 3.0, 77.5, 1e6, 3e9)], "x double").select("x", log_gamma(F.col("x")).alias("y"))
    for r in rows.collect():
        assert r.y == pytest.approx(math.lgamma(r.x), rel=1e-9, abs=1e-8)


def test_grams_are_summed_and_sent_in_bounded_memory(monkeypatch):
    """Summing lets go of its parts; what a task sends are small batches."""
    from siltworks.llm import lm_scoring as module

    monkeypatch.setattr(module, "SENT_GRAMS", 3)
    parts = [(np.array([5, 1, 9]), np.array([1, 2, 3]), np.array([1, 1, 1])), (np.array([9, 2]), np.array([4, 5]), np.array([1, 1]))]
    summed = module._summed(parts)
    assert parts == [] and [c.tolist() for c in summed] == [[1, 2, 5, 9], [2, 5, 1, 7], [1, 1, 1, 2]]
    sent = list(module._sent(summed, ["gram", "n", "seen"]))
    assert [len(b) for b in sent] == [3, 1] and [g for b in sent for g in b.column("gram").to_pylist()] == [1, 2, 5, 9]
