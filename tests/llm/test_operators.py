"""Each operator against a brute-force version, and on nulls, empty texts, repeats and odd columns."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import _kernels as k
from eventloom.llm import bpe, chat, decontam, html_extract, line_dedup, near_dedup, quality_rules, queries, substring_dedup, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def docs(spark, texts, ids=None, extra=False):
    rows = [(i, t) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("n_words", F.lit("x")).withColumn("words", F.lit(1)) if extra else df


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_span_hashes_do_not_depend_on_place_or_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    cuts = np.unique(rng.integers(0, 5000, 300))
    starts, ends = cuts[:-1], cuts[1:]
    whole = k.spans_hash(data, starts, ends)
    assert all(k.spans_hash(data[a:b], np.array([0]), np.array([b - a]))[0] == h for a, b, h in zip(starts, ends, whole, strict=True)) and len(set(whole)) == len({data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)})
    monkeypatch.setattr(k, "BLOCK", 7)
    monkeypatch.setattr(k, "_powers", {})
    assert list(k.spans_hash(data, starts, ends)) == list(whole) and not len(k.spans_hash(data, starts[:0], ends[:0]))


def test_parted_by_a_filter(spark, monkeypatch):
    from eventloom.llm import _shared

    df = spark.range(2000).withColumn("_at", F.lit("clash"))
    keys = spark.range(0, 4000, 7).withColumnRenamed("id", "k")
    for bits in (1 << 26, 1 << 15):
        monkeypatch.setattr(_shared, "FILTER_BITS", bits)
        maybe, others = (({r.id for r in x.collect()}, x.columns) for x in _shared.parted(df, F.xxhash64("id"), keys, F.xxhash64("k")))
        assert maybe[0] | others[0] == set(range(2000)) and not maybe[0] & others[0] and maybe[1] == others[1] == ["id", "_at"]
        assert set(range(0, 2000, 7)) <= maybe[0] and len(maybe[0]) < 400
    maybe, others = _shared.parted(df, F.xxhash64("id"), keys.limit(0), F.xxhash64("k"))
    assert maybe.count() == 0 and others.count() == 2000


# --- 1 -------------------------------------------------------------------------------------------


def removed_by_brute_force(texts, size):
    words = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("most", "shard"), [(64, 50_000), (0, 50_000), (1, 50_000), (64, 60)])
def test_substring_dedup(spark, monkeypatch, most, shard):
    monkeypatch.setattr(substring_dedup, "TEXTS", most)
    monkeypatch.setattr(substring_dedup, "MOST_BROADCAST", most * 10_000)
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    rng = random.Random(11)
    shared = prose(rng, 60)
    texts = [None, "", " \n", "one two", " ".join(["same"] * 80), " ".join(prose(rng, 5, 2) * 30)]
    for _ in range(30):
        own = prose(rng, rng.randrange(10, 120))
        at, a = rng.randrange(len(own)), rng.randrange(20)
        texts.append("  ".join(own[:at] + shared[a : a + rng.randrange(20, 60)] + own[at:]))
    texts += [texts[-1], texts[-1], " ".join(shared), "\t".join(shared[:35]), " ".join(shared[:34])]
    df = docs(spark, texts, extra=True).withColumn("start", F.lit("clash")).withColumn("anchor", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup(df).collect()}
    want = removed_by_brute_force(texts, 35)
    assert [got[i] for i in range(len(texts))] == want


def test_substring_dedup_of_repeated_rows_and_nothing(spark):
    text = " ".join(f"a{i}" for i in range(50))
    got = substring_dedup.dedup(docs(spark, [text, text, text + " x", "y"], ids=[1, 1, None, None])).collect()
    assert sorted((r.n_words, r.n_removed, r.text) for r in got) == [(1, 0, "y"), (50, 50, ""), (50, 50, ""), (51, 50, "x")]
    assert substring_dedup.dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("most", [64, 0])
def test_colliding_digests_remove_nothing(spark, monkeypatch, most):
    """Texts of one anchor whose digests agree though their words differ aren't repeated."""
    monkeypatch.setattr(substring_dedup, "TEXTS", most)
    rng = random.Random(2)
    anchor = [f"w{i}" for i in range(8)]
    texts = [" ".join(prose(rng, 27) + anchor + prose(rng, 27)) for _ in range(6)]
    twice = " ".join(prose(rng, 50))
    assert all(r.n_removed == 0 for r in substring_dedup.dedup(docs(spark, texts)).collect())
    monkeypatch.setattr(substring_dedup, "text_digest", lambda words: (0, 0))
    assert all(r.n_removed == 0 for r in substring_dedup.dedup(docs(spark, [*texts, twice, twice + " x"])).collect() if r.doc_id < 6)
    monkeypatch.setattr(k, "mixed", lambda x: x & np.uint64(3))  # every gram collides: nearly one anchor
    assert [r.n_removed for r in substring_dedup.dedup(docs(spark, texts)).collect()] == [0] * 6


def test_automaton_counts_and_matches():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.choice("ab") for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        automaton = substring_dedup.SuffixAutomaton()
        for t in texts:
            automaton.add(t, 2)
        automaton.seal()
        for size in (1, 2, 3):
            count = collections.Counter(tuple(t[i : i + size]) for t in texts for i in range(len(t) - size + 1))
            for t in texts:
                assert list(automaton.repeated(t, size, 4)) == [2 * count[tuple(t[i : i + size])] >= 4 for i in range(len(t) - size + 1)]
        probe = [rng.choice("abc") for _ in range(10)]
        for i, (n, _) in enumerate(automaton.statistics(probe)):
            held = lambda m, i=i: any(probe[i + 1 - m : i + 1] == t[j : j + m] for t in texts for j in range(len(t) - m + 1))
            assert n == max(m for m in range(i + 2) if m == 0 or held(m))


def test_outside_reference(spark):
    ref = [f"r{i}" for i in range(40)]
    df = docs(spark, [" ".join(["a", *ref, "b"]), " ".join(ref[:34]), None])
    assert [r.text for r in substring_dedup.remove_reference(df, [" ".join(ref), None]).orderBy("doc_id").collect()] == ["a b", " ".join(ref[:34]), ""]


# --- 2 -----------------------------------------------------------------------------------------------


def test_token_ledger(spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("a", "en", "x y"), ("a", "en", "z"), (None, "fr", None), ("a", "en", "x y")], "source string, lang string, text string").withColumn("tokens", F.lit("clash"))
    tokenizers = {"t": r"[^\x20\x09-\x0D]+"}
    assert ledger.totals().count() == 0
    assert ledger.commit(1, token_counts.changes(rows, "insert", tokenizers)) and not ledger.commit(1, token_counts.changes(rows, "insert", tokenizers))
    want = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    assert want() == {("a", "en"): (3, 5), (None, "fr"): (1, 0)}
    ledger.commit(2, token_counts.changes(rows.where("text = 'z'"), "delete", tokenizers))
    ledger.commit(3, token_counts.changes(rows.where("text IS NULL"), "revise", tokenizers, F.lit("p q r"), F.col("text")))
    ledger.commit(4, token_counts.changes(rows.limit(0), "insert", tokenizers))
    assert want() == {("a", "en"): (2, 4), (None, "fr"): (1, 3)} and ledger.committed() == [1, 2, 3, 4]
    spark.createDataFrame([("junk",)], "x string").write.parquet(str(tmp_path / "ledger/deltas/9"))  # an attempt that never committed
    assert want() == {("a", "en"): (2, 4), (None, "fr"): (1, 3)}
    with pytest.raises(Exception, match="no such operation"):
        ledger.commit(5, token_counts.changes(rows, "upsert", tokenizers))


def test_token_ledger_of_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("a", "en", "x y")], "source string, lang string, text string")
    slow, fast = token_counts.Ledger(spark, path), token_counts.Ledger(spark, path)
    add = lambda: token_counts.changes(rows, "insert", {"t": r"\S+"})
    plain, done = token_counts.signed, []

    def late(changes):  # the other writer commits while this one writes its rows
        if not done:
            done.append(True)
            assert fast.commit(1, add())
        return plain(changes)

    monkeypatch.setattr(token_counts, "signed", late)
    assert slow.commit(1, add()) is False
    assert [(r.n_docs, r.n_tokens) for r in slow.totals().collect()] == [(1, 2)]
    (tmp_path / "ledger/committed/2").write_text("")  # a writer died before it named its attempt
    with pytest.raises(RuntimeError, match="recover"):
        slow.commit(2, add())
    assert slow.committed() == [1]
    slow.recover(2)
    slow.recover(1)
    assert slow.commit(2, add()) and slow.committed() == [1, 2]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_token_counts_query(spark):
    tokens = pytest.importorskip("public_tokenizers")
    import duckdb

    enc = bpe.encoding(tokens.path("byte_bpe_multi_50k.tiktoken"), tokens.PATTERN)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in queries.op2_token_counts(spark, FOLDER).collect()}
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet").groupby("doc_id").agg({"toxic": "max", "quality": "min"})
    want = collections.defaultdict(lambda: [0, 0])
    for d in pd.read_parquet(f"{FOLDER}/documents.parquet").itertuples():
        known = labels.loc[d.doc_id] if d.doc_id in labels.index else None
        if known is None or known.toxic != 1:
            text = re.sub(r"[#*$%&|<>]", "", d.text) if known is not None and known.quality == 0 else d.text
            total = want[d.source, d.lang, "byte_bpe_multi_50k"]
            total[0] += 1
            total[1] += len(enc.encode_ordinary(text))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    words = {tuple(r[:3]): tuple(r[3:]) for r in con.execute(queries.WORD_COUNTS).fetchall()}
    assert got == {k: tuple(v) for k, v in want.items()} | words and words


# --- 3 -------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav><ul><li><a href='/x'>Menu one</a></ul></nav><article><h1>Title &amp; more</h1><p>First  paragraph,\n with text.<p>Short.</article><footer>&copy; x</footer>", "Title & more\nFirst paragraph, with text.\nShort."),
    ("<body><div id=top><a href=/>Home</a> <a href=/b>News</a></div><div class='content'><p>" + "Long text, here. " * 20 + "</p><p>End.</p></div><div class='sidebar'>Buy, now, this, thing. " * 1 + "</div><div class='comments'><p>" + "I think, so. " * 30 + "</p></div>", ("Long text, here. " * 20).strip() + "\nEnd."),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>a<!-- b > c -->d<br>e &lt;f&gt;</p>", "ad e <f>"),
    ("<article><form><p>Name</p></form><p>Kept &#233; text<p class=\"ad\">Advert</p><aside>Side</aside></article>", "Kept é text"),
    ("plain text only", "plain text only"), ("", ""), (None, ""), ("<nav>x</nav>", ""), ("<p>unclosed <b>bold", "unclosed bold"), ("<div title=\"a > b\"><p>q</p></div>", "q"), ("< 3 & <", "< 3 & <"),
]


def test_html_extraction(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df).orderBy("page_id").collect()
    assert [r.text for r in got] == [w for _, w in PAGES] and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div class=post><h1>Title</h1><p>{lead}</p><div class=body><p>{body}</p><p>{body}</p></div></div>",
        "<div><a href=/>Home</a></div><div class=post><h1>Title</h1><div class=lead><p>{lead}</p></div><div class=text><div><p>{body}</p><p>{body}</p></div></div></div>",
        "<div><h1>Title</h1><p>{lead}</p><table><tr><td>{body}<tr><td>{body}</table></div>",
    ],
)
def test_html_without_article_keeps_siblings(page):
    lead, body = "Lead words, here and there. " * 8, "Body words, on and on, again. " * 30
    assert html_extract.main_text(page.format(lead=lead, body=body)).split("\n") == ["Title", lead.strip(), body.strip(), body.strip()]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>Name</title><meta charset=utf-8><body><p>Kept text.</p>", "Kept text."),
        ("<head><title>Name<p>Kept text.</p>", "Kept text."), ("<head><title>Using <b> tags</title></head><p>Kept.</p>", "Kept."), ("<head><title>Name</title>Plain text", "Plain text"),
        ("<head><template><div>No</div></template><title>Name</title></head><p>Kept.</p>", "Kept."), ("<html><head><head><title>A<title>B<p>Kept.</p>", "Kept."),
        ("<body><svg viewBox='0 0 1 1'/><article><p>One.</p><p>Two.</p></article><svg><text>No</text></svg>", "One.\nTwo."),
        ("<article><p>One.</p><object data=x /><p>Two.</p></article>", "One.\nTwo."), ("<article><p>One.</p><svg><path d=x><p>Two.</p></article>", "One.\nTwo."),
        ("<body><object data=x><article><p>One.</p></article><object data=y>No</object>", "One."), ("<p>One <svg><g><text>no</text></g></svg> line.</p>", "One line."),
        ("<p>One <select><option>no</option><option>none</select> line.</p>", "One line."), ("<article><svg><foreignObject><div>No</div></foreignObject></svg><p>One.</p></article>", "One."),
        ("<article><head-line>Big news.</head-line><p>One.</p><select-x>Two.</select-x></article>", "Big news.\nOne.\nTwo."), ("<p>a<script >no</script x>b</p>", "ab"),
        ("<p>a<template><p>no</p></template>b</p>", "ab"), ("<article><template><p>One.</p></article>", "One."), ("<ul><li>a<template><li>no</template>b</ul>", "ab"),
    ],
)
def test_html_head_and_embedded_elements(page, text):
    assert html_extract.main_text(page) == text


WRAPPED = "<div class='top'><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div>{0}<div class='cookie-banner'><p>We use cookies, as all do, to do this, that, and more of it.</p></div>"


@pytest.mark.parametrize("around", ["<div class='content with-sidebar'>{}</div>", "<div class='layout sidebar-right'>{}</div>", "<div id='search-results'>{}</div>", "<div data-id='share'>{}</div>", "<div data-class=social title='class=menu'>{}</div>", "<div class=related><div>{}</div></div>"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_names_count_only_as_words_of_what_wraps_no_article(around, tag):
    body = "Body words, on and on, again. " * 20
    inner = f"<{tag}><h1>Title</h1><p>{body}</p><section class='related-work'><p>Others, before us, did less.</p></section><p class=notice-period>A month.</p><div class='share-buttons'><p>Share it, now, with all.</p></div><ul class='links'><li><a href=/a>One more</a><li><a href=/b>Another</a></ul><ul><li>Kept item<li>and <a href=/c>one</a></ul><div id=comments><article class=comment><p>{body}</p></article></div></{tag}>"
    assert html_extract.main_text(WRAPPED.format(around.format(inner))).split("\n") == ["Title", body.strip(), "Others, before us, did less.", "A month.", "Kept item", "and one"]


def test_html_path_scores_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 30)
        paths = [rng.randrange(6) for _ in range(n)]
        of = np.unique(paths, return_inverse=True)[1]
        rows = [(int(p), rng.randrange(1, 300), rng.randrange(9), rng.random() < 0.2, p == 1 and rng.random() < 0.5) for p in of]
        groups = {p: [r for r in rows if r[0] == p] for p in {r[0] for r in rows}}

        def smooth(column, rows=rows, groups=groups, n=n):
            ratio = [sum(r[column] for r in groups[p]) / len(groups[p]) for p, *_ in rows]
            bell = [sum(w * ratio[min(n - 1, max(0, i + d))] for d, w in ((-2, 0.05), (-1, 0.25), (0, 0.4), (1, 0.25), (2, 0.05))) for i in range(n)]
            return {p: sum(v for r, v in zip(rows, bell, strict=True) if r[0] == p) / len(groups[p]) for p in groups}

        length, marks = smooth(1), smooth(2)
        want = [0 if any(r[4] for r in g) else length[p] ** 0.5 * (0.05 + marks[p]) * sum(r[1] for r in g if not r[3]) / sum(r[1] for r in g) for p, g in sorted(groups.items())]
        columns = [np.array(c) for c in zip(*rows, strict=True)]
        got = html_extract.path_scores(of, columns[1].astype(float), columns[2].astype(float), columns[3].astype(bool), columns[4].astype(bool))
        assert got == pytest.approx(want)
        deviation = (sum((x - sum(want) / len(want)) ** 2 for x in want) / len(want)) ** 0.5
        assert list(html_extract.content_paths(np.array(want))) == [x > 0 and x >= 0.5 * deviation for x in want]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_html_gives_the_article_of_every_page():
    pages = pd.read_parquet(f"{FOLDER}/pages.parquet").html
    texts = [html_extract.main_text(p) for p in pages]
    whole = [html_extract.main_text(re.search("<article>.*</article>", p, re.S)[0]) for p in pages]
    assert texts == whole


@pytest.mark.parametrize("page", ["<a " * 350_000, "</b>" * 250_000, "<div>" * 30_000 + "</foo>" * 30_000, "<b><div>" + "<i>" * 30_000 + "</b>" * 60_000, '<a "' * 250_000, "<script>" + "</script " * 100_000, "<b>" * 50_000 + "<div></div>" * 50_000, "<p class='" * 100_000, "<table>" + "<tr><td>x" * 50_000])
def test_html_of_broken_pages_in_linear_time(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 4


# --- 4 -------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    item = [f"b{i}" for i in range(14)]
    items = spark.createDataFrame([(1, " ".join(item)), (10, "Short Item"), (2, None), (3, "..."), (4, " ".join(item[2:13]))], "item_id long, text string")
    texts = [None, "", "?!", "x " + ", ".join(w.upper() for w in item[:11]) + " y", " ".join(item[:9]), "short-item; SHORT item", "é short item", "shortitem", " ".join(item) * 1 + " z " + " ".join(item)]
    low = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = collections.defaultdict(set)
    for i, t in ((1, " ".join(item)), (10, "Short Item"), (4, " ".join(item[2:13]))):
        w = low(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1):
            windows[tuple(w[a : a + n])].add(str(i))
    want = []
    for t in texts:
        w, hit, ids = low(t), set(), set()
        for win, own in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    ids |= own
        want.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    got = decontam.report(docs(spark, texts), items).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == want
    clean = {i for i, w in enumerate(want) if not w[4]}
    odd = docs(spark, texts).withColumn("_x", F.lit(1)).withColumn("n_hit", F.lit("clash"))
    assert {r.doc_id for r in decontam.drop_contaminated(odd, items).collect()} == clean
    spans = {r.doc_id: r.text for r in decontam.remove_spans(odd, items).collect()}
    assert spans[3] == "x y" and spans[4] == texts[4] and spans[6] == "é" and spans[8] == "z"
    none = items.limit(0)
    assert decontam.report(docs(spark, texts), none).where("contaminated").count() == 0 and decontam.report(docs(spark, []), items).count() == 0
    twice = decontam.report(docs(spark, [texts[3], texts[3], "q"], ids=[1, 1, 1]), items).collect()
    assert sorted(r.n_hit for r in twice) == [0, 11, 11]


def test_many_windows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_LEADS", 3)
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    item = [f"b{i}" for i in range(14)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "one"), (3, "two words")], "item_id long, text string")
    texts = [" ".join(item), "x", "one", "a two  WORDS b one"]
    assert [(r.n_hit, r.n_items) for r in decontam.report(docs(spark, texts), items).orderBy("doc_id").collect()] == [(14, 1), (0, 0), (1, 1), (3, 2)]


def test_a_hundred_thousand_windows_move_hits_only(spark):
    rng = random.Random(8)
    items = spark.createDataFrame([(i, " ".join(prose(rng, 59, 10**6))) for i in range(2000)], "item_id long, text string")
    first = items.first().text.split()
    texts = [" ".join(prose(rng, 300, 10**6)) for _ in range(300)] + [" ".join(prose(rng, 20) + first[5:25])]
    windows = decontam.benchmark_windows(items, 10)
    assert windows.count() == 100_000
    df = docs(spark, texts)
    assert decontam.places(df, windows, "doc_id", "text").count() == 11  # all that leaves the scan
    assert [(r.doc_id, r.n_hit) for r in decontam.report(df, items).where("contaminated").collect()] == [(300, 20)]
    plan = decontam.places(df, windows, "doc_id", "text")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_many_hit_positions_are_removed_in_linear_time(spark):
    items = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(10)))], "item_id long, text string")
    text = " ".join([*(f"b{i}" for i in range(10))] * 4000 + ["left"])
    assert [r.text for r in decontam.remove_spans(docs(spark, [text]), items).collect()] == ["left"]


# --- 5 -------------------------------------------------------------------------------------------------


def test_warc(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FLUSH", 40)
    bodies = ["same", "x" * 1000, "same", None, "", "é" * 33, "\r\n\r\n", "same\n", "\r\n\r\n" * 8]
    df = spark.createDataFrame([(i + 5, f"u{i}" if i else None, b) for i, b in enumerate(bodies)], "page_id long, url string, html string").withColumn("data", F.lit("clash"))
    chunks = warc.write_chunks(df, archives=3, chunk=16)
    assert chunks.agg(F.max(F.length("data"))).first()[0] < 900
    read = warc.read_records(chunks).collect()
    assert [r.record_type for r in read if r.record_id is None] == ["warcinfo"] * 3 and all(r.intact for r in read)
    got = {int(r.record_id): r for r in read if r.record_id is not None}
    first = {}
    for i, b in enumerate(bodies):
        body = (b or "").encode()
        r = got[i + 5]
        assert r.intact and r.payload_bytes == len(body) and r.payload_digest == warc.base32_sha1(hashlib.sha1(body).digest())
        same = first.setdefault(body, i + 5)
        assert (r.record_type, r.refers_to) == (("response", None) if same == i + 5 else ("revisit", str(same)))
    sizes = warc.export_files(chunks, str(tmp_path)).collect()
    whole = b"".join((tmp_path / f"archive-{r.archive:05d}.warc").read_bytes() for r in sizes)
    assert whole.count(b"WARC/1.1\r\n") == len(bodies) + 3 and sum(r.bytes for r in sizes) == len(whole)
    records, at = [], 0
    while at < len(whole):  # as any reader of the format does
        head, _, rest = whole[at:].partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        records.append((fields, rest[:n]))
        assert rest[n : n + 4] == b"\r\n\r\n" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        at += len(head) + 4 + n + 4
    ids = [f["WARC-Record-ID"] for f, _ in records]
    assert len(set(ids)) == len(ids) == len(bodies) + 3 and records[0][0]["WARC-Type"] == "warcinfo"
    assert all(f["WARC-Refers-To"] in ids for f, _ in records if f["WARC-Type"] == "revisit")
    payloads = {int(f["X-Page-ID"]): block.partition(b"\r\n\r\n")[2] for f, block in records if f["WARC-Type"] == "response"}
    assert payloads == {i: b for b, i in first.items()} and all(block.startswith(b"HTTP/1.1 200 OK\r\n") for f, block in records if f["WARC-Type"] != "warcinfo")
    broken = chunks.withColumn("data", F.when(F.col("chunk_no") == 2, F.lit(b"0123456789abcdef")).otherwise(F.col("data")))
    longer = {str(i + 5) for i, b in enumerate(bodies) if b and first[b.encode()] == i + 5}
    bad = warc.read_records(broken)
    assert {r.record_id for r in bad.collect() if not r.intact} == longer and bad.count() == len(bodies) + 3
    assert [r.record_type for r in warc.read_records(warc.write_chunks(df.limit(0))).collect()] == ["warcinfo"]
    again = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (1, "u", "y"), (2, "u", "x")], "page_id long, url string, html string")
    rows = warc.read_records(warc.write_chunks(again)).where("record_id IS NOT NULL").collect()
    assert sorted((r.record_id, r.record_type, str(r.refers_to), r.payload_bytes) for r in rows) == [("1", "response", "None", 1)] * 3 + [("2", "revisit", "1", 1)]
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    monkeypatch.setattr(warc, "ARCHIVE", 100)
    assert warc.write_chunks(df).select("archive").distinct().count() == 12
    assert warc.read_records(warc.write_chunks(df, least=5)).where("record_type = 'revisit'").count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_a_damaged_record_ends_the_warc_query(spark, monkeypatch):
    plain = warc.write_chunks
    monkeypatch.setattr(warc, "write_chunks", lambda *a, **k: plain(*a, **k).withColumn("data", F.when(F.col("chunk_no") == 1, F.lit(b"other")).otherwise(F.col("data"))))
    with pytest.raises(Exception, match="damaged record"):
        queries.op5_warc(spark, FOLDER).collect()


# --- 6 -------------------------------------------------------------------------------------------------


def test_bpe(spark, monkeypatch):
    tokens = pytest.importorskip("public_tokenizers")
    path, pattern = tokens.path("byte_bpe_multi_50k.tiktoken"), tokens.PATTERN
    enc = bpe.encoding(path, pattern)
    rng = random.Random(2)
    bits = ["a", "ab ", "  ", "é", "日本", "\n", "'s", "9 ", " 12", "!?", "x y", " ", "\t", "don't ", "🙂"]
    texts = [None, "", " ", "a" * 5000, "ab " * 3000, "<|endoftext|>"] + ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert list(bpe.encode(enc, t, 5)) == enc.encode_ordinary(t or "") and "".join(bpe.pieces(t or "", 5)) == (t or "")
    got = bpe.round_trip(docs(spark, texts), path, pattern).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        ids = enc.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t or ""))
    assert max(map(len, bpe.pieces("日本語、" * 5000, 1000))) < 1100
    odd = docs(spark, ["a b", "a b", None], ids=[1, 1, None], extra=True).withColumn("ids", F.lit("clash")).withColumn("_text", F.lit(1))
    rows = bpe.encode_rows(odd, path, pattern, carried=("words",), proven=True).collect()
    assert sorted((str(r.doc_id), r.words, r.n_tokens, r.decoded_sha256) for r in rows) == [("1", 1, 2, sha("a b"))] * 2 + [("None", 1, 0, sha(""))]
    assert bpe.round_trip(odd, path, pattern).count() == 3 and bpe.encode_rows(odd.limit(0), path, pattern).count() == 0 == bpe.round_trip(odd.limit(0), path, pattern).count()
    back = bpe.decode_rows(bpe.encode_rows(docs(spark, texts), path, pattern), path, pattern)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


# --- 7 -------------------------------------------------------------------------------------------------


def measures(t):
    t = t or ""
    words, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
        seen.add(line)
    count = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if count[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def stays_by_brute_force(t):
    """The verdict of the quality rules with their usual thresholds."""
    words, text = WORD.findall(t or ""), t or ""
    chars, (n, _, symbols, _, repeated) = max(1, sum(map(len, words))), measures(t)
    if n < 10 or 100 * repeated > 20 * n or symbols > 0.3 * n:
        return False
    seen, again = set(), 0
    for line in text.split("\n"):
        again += len(line) if WORD.search(line) and line in seen else 0
        seen.add(line)
    if again / max(1, len(text)) > 0.3:
        return False
    for size, most in ((5, 0.25), (7, 0.24), (10, 0.22), (13, 0.20)):
        count = collections.Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        inside = {j for i in range(n - size + 1) if count[tuple(words[i : i + size])] > 1 for j in range(i, i + size)}
        if sum(len(words[j]) for j in inside) / chars > most:
            return False
    return True


def test_quality_rules(spark):
    rng = random.Random(4)
    bits = ["a", "b\n", "é", "ñ x", " ", "\n", "\t", "\x0b", "\x85", "#", "a b c d e ", "日"]
    texts = [None, "", "\n", "a\n", "\n\na", "a b\na b\n"] + ["".join(rng.choices(bits, k=rng.randrange(80))) for _ in range(800)]
    got = quality_rules.measure(docs(spark, texts, extra=True)).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        m = measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and r.kept == stays_by_brute_force(t)
    for most in (1, 30):  # blocks of one text and of a few
        parts = [quality_rules.measure_block(p, quality_rules.Rules())["n_repeat_words"] for _, p in k.blocks(pa.array(texts), most)]
        assert list(np.concatenate(parts)) == [r.n_repeat_words for r in got]
    kept = quality_rules.filter_rows(docs(spark, texts))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept} and kept.columns == ["doc_id", "text"]
    lines = "\n".join(["a line of ten different words that comes again and again"] * 5 + [" ".join(prose(rng, 60))])
    clean, again = quality_rules.measure(docs(spark, [" ".join(prose(rng, 200, 10_000)), lines])).orderBy("doc_id").collect()
    assert clean.kept and not again.kept
    assert quality_rules.measure(docs(spark, [])).count() == 0


# --- 8 -------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark, monkeypatch):
    rng = random.Random(1)
    bits = ["\\", "#", "###", "</turn>", "<", ":", "a", "\n", "### user: ", "</", "turn>", "\\###", "é"]
    for _ in range(5000):
        messages = [("".join(rng.choices(bits, k=rng.randrange(3))) if rng.random() < 0.3 else rng.choice(["user", "assistant"]), "".join(rng.choices(bits, k=rng.randrange(7)))) for _ in range(rng.randrange(4))]
        text, spans = chat.render(messages)
        assert chat.parse(text) == messages and [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant"]
    log = [
        (1, 1, "message", None, "user", "hi"), (1, 2, "message", None, "assistant", "he"), (1, 3, "delta", None, "assistant", "llo"), (1, 4, "regenerate", 1, None, None), (1, 5, "message", None, "assistant", "hey"), (1, 6, "edit", 0, "user", "hi!"),
        (1, 7, "edit", 9, "user", "no"), (3, 1, "edit", -1, "user", "no"), (3, 2, "message", None, "user", "a"), (3, 3, "edit", -1, "user", "b"), (3, 4, "edit", -2, "user", "no"), (2, 1, "delta", None, "x", "lost"), (2, 2, "message", None, None, None), (None, 1, "message", None, "user", "q"), (1, 8, "odd", None, "user", "no"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq int, event string, target int, role string, text string").withColumn("part", F.lit(1))
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(df).collect()}
    assert got == {1: [("user", "hi!"), ("assistant", "hey")], 2: [("", "")], 3: [("user", "b")], None: [("user", "q")]}
    monkeypatch.setattr(chat, "FLUSH", 1)
    assert {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(df).collect()} == got
    turns = spark.createDataFrame([(1, 1, "assistant", "b#"), (1, 0, "user", "a\\"), (1, 1, "assistant", None), (1, 1, "assistant", "b#")], "conv_id long, turn long, role string, text string")
    kinds = {r.event: r["count"] for r in chat.events_of(turns).groupBy("event").count().collect()}
    assert kinds == {"message": 7, "delta": 9, "regenerate": 3, "edit": 1}
    r = chat.read_back(chat.format_conversations(chat.events_of(turns))).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (4, 4, sha("b#b#"))
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_parses_long_texts_in_little_memory():
    text = "### assistant: </turn> a\\b " * 200_000
    made, _ = chat.render([("user", text), ("assistant", "ok")])
    tracemalloc.start()
    assert chat.parse(made) == [("user", text), ("assistant", "ok")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(text)
    for broken in ("junk", "### user: no end", made[:-3][:-10]):
        with pytest.raises(ValueError):
            chat.parse(broken)


# --- 9 -------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    long = "This line is long enough to count"
    texts = [None, "", f"a\n{long}\nb", f"  {long.upper()}\t\n{long}", f"{long}", "short\nx", "short", "short", f"{long}é\n", f"{long}é", "\n"]
    want = []
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        left = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        want.append((len(lines), len(lines) - len(left), "\n".join(left)))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs(spark, texts).withColumn("pos", F.lit(1)).withColumn("n_dropped", F.lit("clash"))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    rows = line_dedup.dedup_lines(docs(spark, [long, long, long + "\nx", long, "y"], ids=[1, 1, 2, None, None])).collect()
    assert sorted((str(r.doc_id), r.n_dropped) for r in rows) == [("1", 1), ("1", 1), ("2", 0), ("None", 0), ("None", 1)]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_of_long_texts_and_many_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)  # common lines are joined by a shuffle
    lines = "\n".join(f"line number {i} of a very long document" for i in range(40_000))
    rows = line_dedup.dedup_lines(docs(spark, [lines, lines, lines, "own line, which is long enough to count"])).orderBy("doc_id").collect()  # quadratic work would take minutes
    assert [(r.n_lines, r.n_dropped, len(r.text)) for r in rows] == [(40_000, 40_000, 0), (40_000, 40_000, 0), (40_000, 0, len(lines)), (1, 0, 39)]


# --- 10 ------------------------------------------------------------------------------------------------


def linked_by_brute_force(texts, ids):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return [(len(s), find(i), find(i) == i) for s, i in zip(sets, ids, strict=True)]


@pytest.mark.parametrize("block", [400, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(9)
    texts = [None, "", " ", "a b", "A b", "a b c d e", "a b c d e f"]
    for _ in range(6):
        base = prose(rng, rng.randrange(60, 200), 5000)
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
        texts.append(" ".join(base[: len(base) // 2] + prose(rng, 80, 5000)))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    df = docs(spark, texts, ids).withColumn("key", F.lit("clash")).withColumn("_k", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    want = linked_by_brute_force(texts, ids)
    assert [got[i] for i in ids] == want
    assert {r.doc_id for r in near_dedup.keep_one(df).collect()} == {i for i, w in zip(ids, want, strict=True) if w[2]}


def test_near_duplicates_send_sets_of_near_members_only(spark, monkeypatch):
    """Of 300 texts that share a bucket but no near partner, no full set goes through the blocks."""
    sent = []
    plain = near_dedup._by_block

    def counting(blocks, columns, work, schema):
        if "_set" in columns:
            sent.append(blocks.count())
        return plain(blocks, columns, work, schema)

    monkeypatch.setattr(near_dedup, "_by_block", counting)
    monkeypatch.setattr(near_dedup, "PICKS", [[0]])  # one value is a key: buckets of texts that have nothing to do with each other
    rng = random.Random(4)
    texts = [" ".join(prose(rng, 60, 10**6)) for _ in range(300)]
    base = prose(rng, 80, 10**6)
    texts += [" ".join(base), " ".join([*base[:40], "x", *base[41:]])]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got == {**{i: i for i in range(301)}, 301: 300} and sent and sent[0] <= 60


def test_recall_of_the_index_by_similarity():
    """Pairs of random sets of a given similarity that share a key and lie within the distance."""
    rng = np.random.default_rng(0)
    for percent, least in ((85, 0.999), (90, 0.999), (95, 1.0)):
        found = 0
        for _ in range(2000):
            n = 200
            both = round(2 * n * percent / (100 + percent))
            pool = rng.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64)
            a, b = (near_dedup.signature(np.unique(x)) for x in (pool[:n], np.concatenate([pool[:both], pool[n:]])))
            differ = a != b
            found += bool((differ.reshape(near_dedup.CHUNKS, near_dedup.ROWS).sum(axis=1) <= near_dedup.ERRORS).any() and differ.sum() <= near_dedup.FARTHEST)
        assert found >= least * 2000, (percent, found)


def test_near_duplicates_of_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = near_dedup.near_duplicates(docs(spark, [t, t, t, "x y", None, t], ids=[3, 3, 2, 2, None, None])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in rows) == [("2", 1, "2", True), ("2", 26, "2", True), ("3", 26, "2", False), ("3", 26, "2", False), ("None", 0, "None", True), ("None", 26, "None", True)]
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    n = 40
    nodes = spark.range(n + 1).withColumnRenamed("id", "_k")
    order = list(range(n))
    random.Random(0).shuffle(order)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)], "a long, b long")
    assert {r._k: r._c for r in near_dedup.components(nodes, links).collect()} == {**dict.fromkeys(range(n), 0), n: n}


# --- pipeline --------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    tokens = pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(6)
    item = prose(rng, 20, 3000)
    common = "a footer line that very many documents share"
    clean = [" ".join(prose(rng, 80, 5000)) for _ in range(6)]
    texts = [f"{c}\n{common}" for c in clean[:4]] + [clean[4], clean[4] + " z", " ".join(prose(rng, 60, 5000) + item[:12]), "junk " * 50, "few words", None, clean[5]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert tokens and got == {**{i: sha(clean[i]) for i in range(3)}, 3: sha(texts[3]), 4: sha(clean[4]), 10: sha(clean[5])}


def test_pipeline_of_nothing_and_odd_columns(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    text = " ".join(prose(random.Random(3), 60, 5000))
    odd = docs(spark, [text, text, None, ""], ids=[1, 1, None, 4], extra=True).selectExpr("*", "'en' AS lang", "NULL AS source", "1L AS n_chars", "2 AS _k", "3 AS _ld_k", "4 AS _dc_hash", "5 AS _sig")
    empty = spark.createDataFrame([], "item_id long, text string")
    for name, table in (("odd", odd.withColumn("source", F.col("source").cast("string"))), ("none", odd.limit(0).withColumn("source", F.lit("s")))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        empty.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert [(r.doc_id, r.lang, r.source, r.decoded_sha256) for r in rows] == [(1, "en", None, sha(text))] * 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_against_brute_force(spark):
    """All five stages in plain Python over the smallest tables."""
    tokens = pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    enc = bpe.encoding(tokens.path("byte_bpe_multi_50k.tiktoken"), tokens.PATTERN)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    table = {d.doc_id: d for d in pd.read_parquet(f"{FOLDER}/documents.parquet").itertuples()}
    left = {i: d.text for i, d in table.items() if stays_by_brute_force(d.text)}
    assert len(left) < len(table)

    holders = collections.defaultdict(set)
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in left.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    left = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i) for i, t in left.items()}

    ids = list(left)
    stays = [w[2] for w in linked_by_brute_force([left[i] for i in ids], ids)]
    left = {i: left[i] for i, s in zip(ids, stays, strict=True) if s}
    assert not all(stays)

    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if w]
    windows = set()
    for t in pd.read_parquet(f"{FOLDER}/benchmark.parquet").text:
        w = words(t)
        windows |= {tuple(w[a : a + min(10, len(w))]) for a in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(w) for w in windows}
    found = {i for i, t in left.items() for w in [words(t)] for n in sizes if any(tuple(w[a : a + n]) in windows for a in range(len(w) - n + 1))}
    want = {i: (table[i].lang, table[i].source, enc.encode_ordinary(t), sha(t)) for i, t in left.items() if i not in found}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert found and len(rows) == len(want) and {r.doc_id: (r.lang, r.source, r.ids, r.decoded_sha256) for r in rows} == want
