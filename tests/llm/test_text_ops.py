"""Classifiers and scanners: held-out accuracy, brute force, and odd input."""

from __future__ import annotations

import hashlib
import html
import os
import re

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn import session
from cairn.llm import htmltext, langid, licenses, media, quality, sptok, textops, toxicity, urls


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- shared kernels


def test_words_equal_a_loop():
    texts = ["Ab cd_ef", None, "", "ab  Äb9", "cd"]
    h, at = textops.words(texts)
    want = [[w for w in re.findall(r"[^\W_]+", (t or "").lower())] for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    assert int(h[0]) == textops.word_hash("ab")


def test_char_grams_equal_a_loop():
    texts = ["a b", None, "Hello, World 12 x", "", "?"]
    for n, (buckets, at) in zip((2, 3), textops.char_grams(texts, (2, 3), 1 << 20, letters=True)):
        for i, t in enumerate(texts):
            s = " " + re.sub(r"[^a-z]+", " ", (t or "").lower()).strip() + " " if t and re.search("[a-z]", t.lower()) else ""
            want = [s[j : j + n] for j in range(len(s) - n + 1)]
            got = buckets[at[i] : at[i + 1]]
            assert len(set(got.tolist())) == len(set(want)), (t, n)


# -- 6 toxicity


def test_toxicity_held_out(spark, docs, labels, sf_dir):
    """Rows with even hashes are labelled; the others are what is judged."""
    larger = os.path.join(os.path.dirname(sf_dir), "sf0.1")  # the smallest table has eleven toxic rows
    if os.path.isdir(larger):
        docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("xxhash64(doc_id) % 2 = 0")
    got = by_id(toxicity.toxicity(docs, known))
    assert len(got) == docs.count()
    rows = labels.join(known, "doc_id", "left_anti").collect()
    caught = [got[r.doc_id].toxic for r in rows if r.toxic == 1]
    clean = [got[r.doc_id].toxic for r in rows if r.toxic == 0]
    assert np.mean(caught) >= 0.85 and np.mean(clean) <= 0.01


def test_votes_and_scores_equal_brute_force(spark, docs, labels):
    """Who votes, and the classifier's probabilities, by plain loops over words."""
    m = toxicity.fit(docs, labels)
    rows = docs.orderBy("doc_id").limit(60).collect() + [docs.where("text rlike '(?i)stupid|trash'").first()]
    entries = {int(h): [int(m["voters"].owner[i]) for i in np.flatnonzero(m["voters"].hashes == h)] for h in m["voters"].hashes}
    got = by_id(docs.select("doc_id", toxicity.scorer(m["weights"])(F.col("text")).alias("p")))
    for r in rows:
        words = re.findall(r"[^\W_]+", r.text.lower())
        found = {textops.word_hash(w) for w in words} | {int(textops.salted(np.array([textops.word_hash(w[:n])], np.uint64), n)[0]) for w in words for n in toxicity.PREFIXES if len(w) > n}
        want = {o for h in found for o in entries.get(h, ())} | {m["voters"].n - len(toxicity.PATTERNS) + k for k in toxicity.Voters.patterns(r.text)}
        hashes, at = textops.word_features([r.text], toxicity.PREFIXES)
        assert set(m["voters"].fired([toxicity.Voters.patterns(r.text)], hashes, at)[1].tolist()) == want
        z = m["weights"][-1] + sum(m["weights"][b] for b in {h % toxicity.DIMS for h in found})
        assert abs(got[r.doc_id].p - 1 / (1 + np.exp(-z))) < 1e-5


def test_shouting_is_linear_and_equals_the_pattern():
    import random
    import time

    pattern = re.compile(r"[A-ZÄÖÜÉÈÊÇÑÁÍÓÚ]{4,}[^\n]{0,40}!{2,}")
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(["A", "B", "STOP", "x", " ", "!", "!!", "\n", "y" * rng.randrange(30)]) for _ in range(rng.randrange(25)))
        assert toxicity.shouts(t) == (pattern.search(t) is not None), t
    began = time.process_time()
    for t in ("A" * 200_000, "A!" * 100_000, "AAAA!" * 50_000, "a!! " * 50_000):
        toxicity.shouts(t)
    assert time.process_time() - began < 3


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    n, prior = 40_000, 0.2
    y = rng.random(n) < prior
    alpha, beta = np.array([0.6, 0.5, 0.4, 0.3, 0.05]), np.array([0.01, 0.02, 0.01, 0.01, 0.05])
    v = (rng.random((n, 5)) < np.where(y[:, None], alpha, beta)).astype(float)
    v = np.concatenate([v, np.where(rng.random((n, 1)) < 0.95, v[:, :1], 0)], 1)  # nearly a copy of the first
    pair = v.T @ v
    m = toxicity.label_model(n, v.sum(0), pair, prior, np.full(6, 0.9))
    assert np.allclose(m["alpha"][1:4], alpha[1:4], atol=0.12)
    assert abs(m["fire"][4]) < 1.0  # fires at random, so it says little
    p = toxicity.posterior(m, v)
    assert ((p > 0.5) == y).mean() > 0.9


def test_toxicity_odd(odd, none, labels, no_labels):
    for some in (labels, no_labels):
        got = toxicity.toxicity(odd, some)
        assert got.count() == odd.count() and got.where("toxic").count() == 0
        assert toxicity.toxicity(none, some).count() == 0
    kept = toxicity.keep_clean(odd, no_labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()


# -- 1 language


def test_language_held_out(docs, sf_dir, spark):
    """Centroids of rows with even hashes, judged on the others."""
    larger = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    docs = spark.read.parquet(f"{larger}/documents.parquet") if os.path.isdir(larger) else docs
    found = langid.scorer(langid.fit(docs.where("xxhash64(doc_id) % 2 = 0")))(F.col("text")).alias("f")
    rows = docs.where("xxhash64(doc_id) % 2 != 0").select("lang", found).collect()
    assert len(rows) > 20 and np.mean([r.f.language == r.lang for r in rows]) > 0.95
    assert np.mean([r.f.rejected for r in rows]) < 0.02


def gram_bucket(gram: str, dims: int) -> int:
    h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
    for c in gram:
        h = (h ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 15
    return h & (dims - 1)


def test_language_equals_brute_force(docs):
    """Frequencies, vectors, distances, ties and limits by loops over the n-grams."""
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()

    def grams(text):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return [gram_bucket(s[i : i + n], langid.DIMS) for n in langid.SIZES for i in range(len(s) - n + 1)] if s.strip() else []

    every = {r.doc_id: grams(r.text or "") for r in rows}
    df = np.zeros(langid.DIMS)
    for g in every.values():
        df[list(set(g))] += 1
    m = langid.fit(docs)
    assert np.allclose(m["idf"], np.log((1 + len(rows)) / (1 + df)) + 1, atol=1e-5)
    got = by_id(langid.identify(docs))
    for r in rows[:60]:
        x = np.log1p(np.bincount(every[r.doc_id], minlength=langid.DIMS)) * m["idf"]
        s = m["centroids"] @ (x / max(np.linalg.norm(x), 1e-12))
        d = 1 - s.max()
        assert abs(got[r.doc_id].distance - d) < 1e-4, r.doc_id
        limit = m["limits"][m["owner"][s.argmax()], np.searchsorted(langid._CLASSES, len(every[r.doc_id]), side="right") - 1]
        if abs(d - limit) > 1e-4:
            assert got[r.doc_id].rejected == (d > limit)
            assert got[r.doc_id].language == ("und" if d > limit else m["names"][m["owner"][s.argmax()]])


def test_language_ties_and_dirty_labels(spark, docs, monkeypatch):
    text = "the same words in both languages " * 5
    rows = [(i, text, "ab"[i % 2]) for i in range(40)] + [(100 + i, f"odd {i}", f"label{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    assert langid.fit(df)["names"] == ["a", "b"]
    assert {r.language for r in langid.identify(df).where("doc_id < 40").collect()} == {"a"}  # equal distances: the first in the alphabet


def test_fits_give_memory_back(docs, labels, monkeypatch):
    """The driver's Python shares its memory with the JVM: what a fit held is released."""
    calls = []
    monkeypatch.setattr(textops, "tidy", lambda: calls.append(1))
    for fit in (lambda: langid.fit(docs), lambda: toxicity.fit(docs, labels)):
        calls.clear()
        fit()
        assert calls


def test_language_rejects_noise(spark, docs):
    noise = spark.createDataFrame([(10**9, "zxq jqv wkz xqj vzk qwx " * 60, None, "s", 1)], docs.schema)
    got = by_id(langid.identify(docs.union(noise)))
    assert got[10**9].rejected and got[10**9].language == "und"


def test_language_odd(odd, none):
    got = langid.identify(odd)
    rows = by_id(got)
    assert got.count() == odd.count() and langid.identify(none).count() == 0
    assert rows[1].language is None and not rows[1].rejected and rows[2].distance == 1.0
    assert langid.keep_identified(odd).columns == odd.columns


# -- 3 quality


def test_quality_held_out(spark, docs, labels, sf_dir):
    """Fitted and calibrated on rows with even hashes, judged on the others."""
    larger = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    if os.path.isdir(larger):
        docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("xxhash64(doc_id) % 2 = 0")
    got = by_id(quality.quality(docs, known))
    rows = labels.join(known, "doc_id", "left_anti").collect()
    p, good = np.array([got[r.doc_id].p_good for r in rows]), np.array([r.quality for r in rows])
    assert ((p > 0.5) == good).mean() > 0.9 and abs(p.mean() - good.mean()) < 0.12  # accurate and calibrated
    verdicts = {v: good[[got[r.doc_id].verdict == v for r in rows]] for v in ("keep", "reject")}
    assert verdicts["keep"].mean() > 0.9 and verdicts["reject"].mean() < 0.1


def test_quality_equals_brute_force(docs, labels):
    """Features and probabilities by loops over words and characters."""
    m = quality.fit(docs, labels)
    (a, b), w = m["sigmoid"], m["weights"].astype(float)
    got = by_id(quality.quality(docs, labels))
    for r in docs.orderBy("doc_id").limit(40).collect():
        text, count = r.text or "", {}

        def add(k):
            count[k] = count.get(k, 0) + 1

        words = [int(textops.words([x], lower=False, kind="space")[0][0]) for x in re.findall(r"[^\W_]+", text)]
        for h in words:
            add(h % quality.WORD_DIMS)
        for x, y in zip(words, words[1:]):
            two = np.array([x], np.uint64) * np.uint64(0x9DDFEA08EB382D69) ^ np.array([y], np.uint64)
            add(int(textops.mix(two)[0]) % quality.WORD_DIMS)
        for k, n in enumerate((3, 4)):
            for i in range(len(text) - n + 1):
                add(gram_bucket(text[i : i + n], quality.CHAR_DIMS) + quality.WORD_DIMS + k * quality.CHAR_DIMS)
        v = {k: np.log1p(c) for k, c in count.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        z = sum(w[k] * x / norm for k, x in v.items()) + w[-1]
        assert abs(got[r.doc_id].p_good - 1 / (1 + np.exp(-(a * z + b)))) < 1e-5, r.doc_id


def test_quality_odd(odd, none, labels, no_labels):
    for some in (labels, no_labels):
        got = quality.quality(odd, some)
        rows = by_id(got)
        assert got.count() == odd.count() and rows[1].p_good is None and rows[2].verdict == "review"
        assert quality.quality(none, some).count() == 0


# -- 4 SentencePiece


def test_parity(docs):
    texts = [r.text for r in docs.select("text").collect()] + ["", " ", "  a  b\t\nc", "☃\U0001f389 日本語", "a▁b", "x" * 5000, "<s> </s> <unk> <0x41>", "﻿é é", "1.0e-7"]
    assert all(sptok.parity(texts))


def test_unigram_models(tmp_path):
    """A unigram model's back end picks the best segmentation; unknown characters fall back to bytes."""
    pieces = [("<unk>", 0.0, 2), *((f"<0x{i:02X}>", -20.0, 6) for i in range(256)), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("▁ab", -2.6, 1)]
    model = {"type": "unigram", "pieces": pieces, "byte_fallback": True, "unk": 0}
    back = sptok.build(model)
    assert [pieces[i][0] for i in back.encode("▁ab▁b").ids] == ["▁ab", "▁", "b"]
    assert [pieces[i][0] for i in back.encode("▁é").ids] == ["▁", "<0xC3>", "<0xA9>"]


def test_sentencepiece_odd(odd, none):
    got = sptok.encode(odd)
    rows = by_id(got)
    assert got.count() == odd.count() and sptok.encode(none).count() == 0
    assert rows[1].ids is None and rows[1].n_tokens is None and rows[2].ids == [] and rows[4].n_tokens > 100_000
    texts = {r.doc_id: r.text for r in odd.collect()}
    back = {r.doc_id: r.t for r in got.select("doc_id", sptok.decode_column()("ids").alias("t")).collect()}
    assert all(back[k] == texts[k] for k in texts if texts[k] is not None) and back[1] is None
    assert all(r.round_trip and r.parity for r in rows.values() if r.ids is not None)


def test_decoding_equals_the_back_end(docs):
    c = sptok.codec(sptok.MODEL)
    texts = [r.text for r in docs.select("text").limit(50).collect()] + ["a  b", "☃\U0001f389", ""]
    ids, ok, same = c.encode(texts)
    assert all(ok) and all(same)
    assert [t.replace(" ", sptok.MARK) for t in c.decode(ids)] == [c.back.decode(i.tolist(), skip_special_tokens=False)[1:] for i in ids]


def test_wrong_ids_are_noticed(docs):
    """A word whose ids are wrong fails the round trip of its rows, one that the library encodes otherwise the parity."""
    c = sptok.Codec()
    c.encode(["one two", "three"])
    c.table[sptok.MARK + "two"] = c.table[sptok.MARK + "three"]
    c.bad.add(sptok.MARK + "three")
    _, ok, same = c.encode(["one two", "three", None])
    assert ok == [False, True, None] and same == [True, False, None]


def test_new_words_go_in_texts_of_many(docs, monkeypatch):
    """Words are learnt many at a time with the ids that each has on its own; where the library differs, one by one, and only the word is bad."""
    c = sptok.Codec()
    words = sorted({w for r in docs.select("text").limit(50).collect() for w in c.split.findall(c.normalise(r.text)) if len(w) > 1 and sptok.MARK not in w[1:]} | {"▁é", "▁日本語", "▁\U0001f389☃", "▁a\tb\nc", "▁\x00", "▁" + "x" * 5000})
    sent, encode = [], c.back.encode_batch_fast

    class Back:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return encode(texts, **kw)

    monkeypatch.setattr(c, "back", Back())
    c._learn([*words, "▁▁two", "▁", "none"])
    alone = {w: np.array(e.ids, np.int32).tobytes() for w, e in zip(words, encode(words, add_special_tokens=False))}
    assert {w: c.table[w] for w in words} == alone and not c.bad and {"▁▁two", "▁", "none"} < set(c.table)
    assert len(sent) < len(words) / 10
    ours, theirs = c._theirs, c._theirs(["two"])[0]

    def differs(texts):
        return [[*t, 5] if "two" in x.split(" ") else t for x, t in zip(texts, ours(texts))]

    monkeypatch.setattr(c, "_theirs", differs)
    c.forget()
    c._learn(["▁two", *[w for w in words if w != "▁two"]])
    assert c.bad == {"▁two"} and {w: c.table[w] for w in words} == alone and c.table["▁two"] == np.array(theirs, np.int32).tobytes()


# -- 2 HTML


def test_html_extracts_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = by_id(htmltext.extract(pages), "page_id")
    right = []
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r.html, re.S)
        want = html.unescape(re.sub(r"<[^>]*>", " ", m[1]))
        right.append("".join(want.split()) == "".join(got[r.page_id].text.split()))
    assert np.mean(right) > 0.97


def test_html_labels_do_not_leak(spark, sf_dir):
    """Pages that the trees haven't seen, with every tag that labels them renamed, give the same text."""
    pages = [r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() if r.html]
    half = len(pages) // 2
    model = htmltext.fit(spark.createDataFrame([(r.page_id, r.html) for r in pages[:half]], "page_id long, html string"))
    right = []
    for r in pages[half:]:
        m = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r.html, re.S)
        want = html.unescape(re.sub(r"<[^>]*>", " ", m[1]))
        page = htmltext.Page(re.sub(r"(</?)(article|main|nav|footer|aside|header|form)\b", r"\1div", r.html))
        got = page.text(page.decode(htmltext.predict(model, page.features())))
        right.append("".join(want.split()) == "".join(got.split()))
    assert np.mean(right) >= 0.9


def test_trees_equal_brute_force():
    """The first split is the best of all, and predictions are the sums of the leaves that a plain walk finds."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(60, 4)), 1)
    y = ((x[:, 2] > 0.3) ^ (rng.random(60) < 0.1)).astype(float)
    m = htmltext.boost(x, y, trees=5, depth=2)
    g, h = y - y.mean(), np.full(60, y.mean() * (1 - y.mean()))

    def gain(j, t):
        a = x[:, j] <= t
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (a, ~a)) - g.sum() ** 2 / (h.sum() + 1)

    best = max((gain(j, t), j, t) for j in range(4) for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, htmltext.BINS + 1)[1:-1])))
    assert abs(gain(m["trees"][0][0][0], m["trees"][0][1][0]) - best[0]) < 1e-9

    def walk(row):
        f = m["base"]
        for feature, threshold, value in m["trees"]:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > threshold[node])
            f += value[node - len(feature)]
        return 1 / (1 + np.exp(-f))

    assert np.allclose(htmltext.predict(m, x), [walk(r) for r in x])
    assert ((htmltext.predict(m, x) > 0.5) == y).mean() > 0.85


def test_parsing_is_linear():
    import time

    for bad in ("<div>" * 16_000, "<div>" * 8_000 + "</p>" * 8_000, '<a x="' * 20_000, '<a">"' * 20_000, "<" * 100_000, "<a " * 50_000, "<ul>" + "<div>" * 8_000 + "<li/>" * 8_000):
        began = time.process_time()
        page = htmltext.Page(bad)
        page.decode(htmltext.predict(None, page.features()))
        assert time.process_time() - began < 5


def test_decoding_equals_brute_force():
    page = htmltext.Page("<div><p>some words</p><p>x<b>yy</b></p></div><ul><li>menu</li></ul>")
    rng, n = np.random.default_rng(3), len(page.tag)
    w = page.weights()

    def best(i, p):
        """(score, kept) of the best choice for a subtree: kept, dropped, or decided by its parts."""
        kids = [j for j in range(1, n) if page.parent[j] == i]
        under = [i] + [d for k in kids for d in below(k)]
        whole = [(sum(w[j] * np.log(p[j] if k else 1 - p[j]) for j in under), {j: k for j in under}) for k in (True, False)]
        own = max((w[i] * np.log(p[i]), True), (w[i] * np.log(1 - p[i]), False))
        parts = [best(k, p) for k in kids]
        return max([*whole, (own[0] - htmltext.MIXED + sum(x for x, _ in parts), {i: own[1]} | {j: v for _, d in parts for j, v in d.items()})], key=lambda t: t[0])

    def below(i):
        return [i] + [d for k in range(1, n) if page.parent[k] == i for d in below(k)]

    for _ in range(50):
        p = rng.uniform(0.05, 0.95, n)
        kept, want = page.decode(p), best(0, p)[1]
        assert all(kept[i] == want[i] for i in range(n) if w[i] > 0)


def test_html_odd(spark):
    rows = [(1, None), (2, ""), (3, "no tags"), (4, "<"), (5, "<div" * 1000), (6, "</p></div>x<p>y<p>z"), (7, "<script>var a='<p>'"), (8, "<p>a &amp; b<br>c</p>" * 3000), (8, "<p>twice</p>"), (None, "<p>z</p>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, html string, text string, n_nodes int")
    got = htmltext.extract(pages)
    assert got.count() == len(rows) and by_id(got, "page_id")[1].text is None and by_id(got, "page_id")[2].text == ""
    assert htmltext.extract(pages.limit(0)).count() == 0
    page = htmltext.Page("<p>a &amp; b<br>c<li>d</p>")
    assert page.text(np.ones(len(page.tag), bool)) == "a & b\nc\nd"


# -- 7 media


def test_chunks_equal_a_loop(monkeypatch):
    rng = np.random.default_rng(5)
    data = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 700, 50_000)] + [b"a" * 70_000]
    whole = media.chunk_ends(data)
    monkeypatch.setattr(media, "BLOCK", 4096)  # long payloads go in blocks
    assert media.chunk_ends(data) == whole
    for p, ends in zip(data, media.chunk_ends(data)):
        want, last, h = [], 0, 0
        hashes = []
        for b in p:
            h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
            hashes.append(h)
        for i in range(len(p)):
            size = i + 1 - last
            if size >= media.LEAST and hashes[i] >> (32 - media.AVERAGE_BITS) == 0 and i + 1 < len(p) or size == media.GREATEST or i + 1 == len(p):
                want.append(i + 1)
                last = i + 1
        assert ends == want


def test_media_store(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, 60_000).astype(np.uint8).tobytes()
    b = a[:20_000] + b"inserted" + a[20_000:]
    rows = [(1, a), (2, a), (3, b), (4, b""), (5, None), (1, a), (6, b"x" * 100_000), (None, b"null id")]
    df = spark.createDataFrame([(i, bytearray(p) if p is not None else None, 1, "v") for i, p in rows], "page_id long, html binary, bytes int, verified string")
    got = {r.id: r for r in media.media_chunks(df, "page_id", "html").collect()}
    assert got[1].new_bytes == len(a) and got[2].new_bytes == 0 and got[3].new_bytes < 30_000 and got[4].chunks == [] and got[5].chunks is None
    assert all(r.verified for r in got.values() if r.bytes is not None)
    store, lists = media.chunk(df, "page_id", "html")
    back = {r.id: (bytes(r.payload), r.verified) for r in media.reconstruct(store, lists).collect()}
    assert back == {i: (p, True) for i, p in rows if p is not None}
    assert media.media_chunks(df.limit(0), "page_id", "html").count() == 0
    lost = {r.id: r.verified for r in media.assembled(store.limit(0), lists).collect()}
    assert not lost[1] and lost[4]
    swapped = lists.withColumn("place", F.expr("if(place in (0, 1), 1 - place, place)"))  # right chunks in the wrong order
    assert not {r.id: r.verified for r in media.assembled(store, swapped).collect()}[1]
    other = store.withColumn("data", F.first("data").over(W.partitionBy(F.lit(1)).orderBy("digest")))  # another chunk's bytes
    assert not {r.id: r.verified for r in media.assembled(other, lists).collect()}[1]


def test_media_equals_brute_force(spark, sf_dir):
    """The whole query against chunking in plain Python, owners included."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = sorted((r.page_id, r.html.encode()) for r in pages.select("page_id", "html").collect() if r.html is not None)
    owner, want = set(), {}
    for i, p in rows:
        new, names, last = 0, [], 0
        for e in media.chunk_ends([p])[0]:
            names.append(hashlib.sha256(p[last:e]).hexdigest())
            if names[-1] not in owner:
                owner.add(names[-1])
                new += e - last
            last = e
        want[i] = (len(p), len(names), new, names, True)
    got = {r.page_id: (r.bytes, r.n_chunks, r.new_bytes, r.chunks, r.verified) for r in media.query(spark, sf_dir).collect() if r.bytes is not None}
    assert got == want


def test_payloads_are_put_together(spark):
    """What is verified is the digest of the payload that the stored chunks give."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, bytearray(rng.integers(0, 256, 9_000 * i).astype(np.uint8).tobytes())) for i in (1, 2, 3)], "page_id long, html binary")
    store, lists = media.chunk(df, "page_id", "html")
    wrong = lists.withColumn("whole", F.expr("if(id = 2, unhex(sha2('another payload', 256)), whole)"))
    assert {r.id: r.verified for r in media.assembled(store, wrong).collect()} == {1: True, 2: False, 3: True}
    assert all(r.verified for r in media.assembled(store, lists).collect())


def test_bytes_cross_once(spark, monkeypatch):
    """Payloads, ids in any order over many tasks, meet their chunks in one shuffle; chunks that occur again come from their owner."""
    rng = np.random.default_rng(9)
    shared = rng.integers(0, 256, 20_000).astype(np.uint8).tobytes()
    rows = {i: rng.integers(0, 256, 60_000).astype(np.uint8).tobytes() + (shared if i % 10 == 0 else b"") for i in range(60, 0, -1)}
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in rows.items()], "page_id long, html binary")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(60_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = shuffled()
    got = {r.id: r for r in media.media_chunks(df, "page_id", "html").collect()}
    assert shuffled() - before < 1.3 * sum(map(len, rows.values()))
    owner, new = set(), dict.fromkeys(rows, 0)
    for i, p in sorted(rows.items()):
        ends = media.chunk_ends([p])[0]
        names = [hashlib.sha256(p[a:b]).hexdigest() for a, b in zip([0, *ends], ends)]
        assert got[i].chunks == names and got[i].verified and got[i].bytes == len(p)
        for name, a, b in zip(names, [0, *ends], ends):
            new[i] += 0 if name in owner else b - a
            owner.add(name)
    assert {i: r.new_bytes for i, r in got.items()} == new and len({new[i] < len(rows[i]) for i in rows}) == 2
    monkeypatch.setattr(session, "BROADCAST_IDS", 0)  # too many chunks that occur again
    assert {r.id: r for r in media.media_chunks(df, "page_id", "html").collect()} == got


def test_fingerprints_join():
    a, b = b"some bytes" * 50, b"and others"
    assert media.fingerprint(a + b) == media.joined(media.fingerprint(a), media.fingerprint(b), len(b)) != media.fingerprint(b + a)


# -- 8 URLs


def test_segmentation_equals_brute_force():
    s = urls.Segmenter({"free": 50, "bets": 20, "be": 10, "freebet": 1, "s": 5})

    def cost(parts):
        return sum(s.cost[p] if p in s.cost else urls.UNKNOWN + urls.LETTER * len(p) for p in parts)

    def splits(w):
        return [[w]] + [[w[:i], *r] for i in range(1, len(w)) for r in splits(w[i:])] if w else [[]]

    for w in ("freebets", "freebet", "besbe", "xyfree", "freexbe"):
        # neighbouring unknown stretches are one stretch
        assert abs(cost(s.split(w)) - min(cost(p) for p in splits(w))) < 1e-9, (w, s.split(w))


def test_url_filter(spark):
    rows = ["http://www.freebetscasino.com/win", "https://user@Cheap-Pills.example.org:80/x?y#z", "http://news.example.org/science/water", None, "", "not a url", "//casino.example.com", "http://[::1]/a", "HTTP://adultcams.example.net."]
    df = spark.createDataFrame([(i, u, "h", "w") for i, u in enumerate(rows)], "page_id long, url string, host string, words string")
    got = by_id(urls.filter_urls(df), "page_id")
    assert got[0].words == ["free", "bets", "casino"] and got[1].host == "cheap-pills.example.org"
    assert [got[i].blocked for i in range(9)] == [True, True, False, False, False, False, True, False, True]
    assert got[3].host is None and got[5].score is None
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_bayes_equals_brute_force(spark):
    """The distributed fit against the same rounds in plain Python; and path words are learnt from rows."""
    rng = np.random.default_rng(4)
    hosts = ["casinobonus", "newslibrary", "plainhost", "freebets", "museumweather"]
    rows = []
    for i in range(400):
        h = hosts[rng.integers(5)]
        path = "/".join(rng.choice(["spinarama", "jackpotville"] if "casino" in h or "bets" in h else ["exhibits", "catalogue"], 2))
        rows.append((i, f"http://{h}.example.org/{path}/common"))
    rows += [(1000, "http://plainhost.example.org/spinarama/jackpotville"), (1001, "http://plainhost.example.org/exhibits")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = by_id(urls.filter_urls(df), "page_id")
    tokens = {i: list(got[i].words) + urls.path_tokens(u.split(".org", 1)[1]) for i, u in rows}
    bad, good = urls.seeds()
    words = set(bad) | set(good)
    mass, extra = (sum(bad.values()), sum(good.values())), ({}, {})

    def model(extra):
        total = [sum(x.values()) for x in extra]
        share = min(1.0, sum(total) / sum(mass))
        scaled = [{t: c * share * m / max(n, 1e-9) for t, c in x.items()} for x, m, n in zip(extra, mass, total)]
        n = len(words) + len(set(scaled[0]) | set(scaled[1])) + 1
        sums = [m + sum(x.values()) + urls.SMOOTH * n for m, x in zip(mass, scaled)]

        def score(ts):
            z = np.log(urls.PRIOR / (1 - urls.PRIOR))
            for t in ts:
                if t in words or t in scaled[0] or t in scaled[1]:
                    z += np.log((bad[t] + scaled[0].get(t, 0) + urls.SMOOTH) / sums[0]) - np.log((good[t] + scaled[1].get(t, 0) + urls.SMOOTH) / sums[1])
            return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

        return score

    score = model(extra)
    for _ in range(urls.ROUNDS):
        new = ({}, {})
        for ts in tokens.values():
            p = score(ts)
            for t in ts:
                if t not in words:
                    new[0][t] = new[0].get(t, 0) + p
                    new[1][t] = new[1].get(t, 0) + 1 - p
        score = model(new)
    for i, ts in tokens.items():
        assert abs(got[i].score - score(ts)) < 1e-5
    assert got[1000].score > 0.5 > 0.1 > got[1001].score


def test_every_counted_label_is_a_word(spark):
    """Labels behind the 50,000 most frequent ones, and long labels of one host, stay whole."""
    many = spark.range(50_010).selectExpr("id", "concat('http://', translate(cast(id + 100000 as string), '0123456789', 'abcdefghij'), '.example.org/') as url")
    few = spark.createDataFrame([(10**6, "http://sussexpills.example.org/"), (10**6 + 1, "http://sussexpillsbury.example.org/")], "id long, url string")
    got = {r.id: r for r in urls.filter_urls(many.union(few), "id").collect()}
    assert len(got) == 50_012
    for i, label in ((10**6, "sussexpills"), (10**6 + 1, "sussexpillsbury")):
        assert got[i].words[0] == label and not got[i].blocked


# -- 9 licences


def test_statistics_equal_brute_force():
    rng = np.random.default_rng(7)
    templates = [rng.integers(0, 4, n).tolist() for n in (12, 9, 20, 9)]
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    a = licenses.Automaton(templates)
    for _ in range(30):
        text = rng.integers(0, 5, 40).tolist()
        for i, (n, s) in enumerate(a.statistics(text)):
            want = max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in runs))
            assert n == want
            if n:
                places = {(t, e) for t, x in enumerate(templates) for e in range(n, len(x) + 1) if x[e - n : e] == text[i + 1 - n : i + 1]}
                assert set(a.ends[s]) == places


def test_matches_equal_brute_force():
    """Every place where a run stands that its template can't extend, also if a longer run of another template ends there."""
    rng = np.random.default_rng(8)
    for least in (1, 2, 3):
        texts = [" ".join(rng.choice(list("abcd"), n)) for n in (12, 9, 20, 9)]
        s = licenses.Scanner({str(i): t for i, t in enumerate(texts)}, least)
        for _ in range(30):
            text = rng.integers(-1, len(s.vocabulary), 40).tolist()
            want = set()
            for t, x in enumerate(s.tokens):
                for i in range(len(text)):
                    for j in range(len(x)):
                        if text[i] != x[j] or (i and j and text[i - 1] == x[j - 1]):
                            continue
                        n = 1
                        while i + n < len(text) and j + n < len(x) and text[i + n] == x[j + n]:
                            n += 1
                        if n >= least:
                            want.add((t, i, j, n))
            got = s.matches(text)
            assert len(got) == len(set(got)) and set(got) == want


def test_chains_equal_brute_force():
    """The best chain through a template's matches, against all increasing sequences of them."""
    rng = np.random.default_rng(10)
    text = "a b c d e f g h"
    for _ in range(60):
        s = licenses.Scanner({"t": text}, 1, 2, 0.0)
        m = sorted({(int(x), int(y), int(n)) for x, y, n in zip(rng.integers(0, 14, 6), rng.integers(0, 7, 6), rng.integers(1, 4, 6)) if y + n <= 8})

        def best(j):
            x, y, n = m[j]
            top = n
            for i in range(j):
                px, py, pn = m[i]
                cut = max(0, px + pn - x, py + pn - y)
                if px < x and py < y and cut < n and x + cut - px - pn <= 2 and y + cut - py - pn <= 2:
                    top = max(top, best(i) + n - cut)
            return top

        found = s._chains(0, m)
        want = max((best(j) for j in range(len(m))), default=0)
        assert (max((c for *_, c in found), default=0) == want) or want < s.least
        spans = sorted((b, e) for _, b, e, _ in found)
        assert all(e <= b2 for (_, e), (b2, _) in zip(spans, spans[1:]))


def test_scan_repeats_and_ties(spark):
    notice = licenses.TEMPLATES["MIT-notice"]
    rows = [(1, f"{notice} x {notice}", "l"), (1, f"{notice} x {notice}", "l"), (2, licenses.TEMPLATES["MIT"], "l"), (3, "All rights reserved. " * 2, "l")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert sorted((r.doc_id, r.license, r.first_token) for r in got) == [(1, "MIT-notice", 0), (1, "MIT-notice", 0), (1, "MIT-notice", 6), (1, "MIT-notice", 6), (2, "MIT", 0), (3, "all-rights-reserved", 0), (3, "all-rights-reserved", 3)]


def test_scan_finds_edited_notices(spark):
    rows = [(1, "This work is licensed under the terms of Apache License, Version 2.0", "l"), (2, "This work is licensed under the permissive BSD 3-Clause License", "l")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "Apache-2.0-notice"), (2, "BSD-notice")]


def test_scan_finds_all_notices(spark, docs):
    phrases = {"GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3", "MIT-notice": "Released under the MIT License", "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0", "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0"}
    got = licenses.scan(docs).collect()
    for name, p in phrases.items():
        want = sorted(r.doc_id for r in docs.collect() for _ in range(r.text.count(p)))
        assert sorted(r.doc_id for r in got if r.license == name) == want


def test_scan_covers_changed_text(spark, odd, none):
    words = licenses.TEMPLATES["BSD-3-Clause"].split()
    changed = " ".join(w for i, w in enumerate(words) if i % 17 != 5)
    df = spark.createDataFrame([(1, "before " + changed + " after", "l"), (2, " ".join(words), "l"), (3, "the license of the software", "l")], "doc_id long, text string, license string")
    got = licenses.scan(df).collect()
    assert [(r.doc_id, r.license) for r in sorted(got)] == [(1, "BSD-3-Clause"), (2, "BSD-3-Clause")]
    assert {r.doc_id: r.coverage for r in got}[2] == 1.0 and 0.75 <= {r.doc_id: r.coverage for r in got}[1] < 1
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
