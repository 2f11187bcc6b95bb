"""Chat round trips, page texts and exact search against brute force."""

from __future__ import annotations

import hashlib
import html
import random
import re
import time
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from claimlens.llm import chat, html_text, queries, topk


def brute_chat(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in convs.items():
        own.sort()
        loss = "".join(t for *_, r, t in own if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for *_, r, t in own)
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_op5_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r[0]: tuple(r)[1:5] for r in queries.op5(spark, sf_dir).collect()} == brute_chat(rows)


def test_op5_odd_conversations(spark):
    rng = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", " ", "<", "s>", "é", "🙂", "\\s", "[\\INST]"]
    draw = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "</s>"]), draw())
            for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "assistant", None), (None, None, None, None), (50, 1, "assistant", "tie"),
             (50, 1, "assistant", "tie"), (50, 1, "user", "tie"), (51, 0, "user", "no reply")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    examples = chat.expand(turns.withColumns({"head": F.lit(1), "conv": F.lit(2), "example": F.lit(3)}))
    assert {r[0]: tuple(r)[1:5] for r in chat.read_back(examples).collect()} == brute_chat(rows)
    by_conv = defaultdict(list)
    for r in examples.orderBy("conv_id", "example").collect():
        by_conv[r.conv_id].append(r)
    for own in by_conv.values():
        assert [r.is_last for r in own] == [False] * (len(own) - 1) + [True]
        for a, b in zip(own[:-1], own[1:], strict=True):
            assert b.formatted.startswith(a.formatted) and a.formatted.endswith(chat.CLOSE + "\n")
    n = sum(r[2] == "assistant" for r in rows)
    assert sum(r.mask_end > r.mask_start or chat.parse(r.formatted)[-1] == ("assistant", "")
               for own in by_conv.values() for r in own) == n
    assert chat.expand(turns.limit(0)).count() == 0


def test_op6_query(spark, sf_dir):
    got = {r.page_id: r for r in queries.op6(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        found = re.search(r"<article>(.*?)</article>", p.html or "", re.DOTALL)
        parts = re.split(r"</?p>|</?h1>|<br>", found[1]) if found else []
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        want = "\n\n".join(x for x in parts if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><nav><ul><li>Home<li>News</ul></nav>{}
<div id="comments"><p>reader says</p></div><aside>side</aside><footer>foot</footer></body></html>"""


def test_op6_markup(spark):
    article = ("<article><h1>A &amp; B</h1><p>one\n two<b>bold</b> <!-- x --><p>three&nbsp;four &lt;i&gt;"
               "<form><input>send</form><ul><li>x<li>y</ul><div class='ad'>buy</div></article>")
    menu = " ".join(f"menu{i}" for i in range(12))
    pages = [(1, "http://h.example/1", PAGE.format(article)), (2, "http://h.example/2", PAGE.format(article)),
             (3, None, None), (4, "http://h.example/4", ""), (5, "x", "plain < text"),
             (6, "http://q.example/6", f"<div>{menu}</div><p>first page only</p>"),
             (7, "http://q.example/7", f"<div>{menu}</div><p>second page only</p>"),
             (7, "http://q.example/7", f"<div>{menu}</div><p>second page only</p>"),
             (8, "http://r.example/8", f"<div>{menu}</div>"), (9, "http://h.example/9", "<main>left open"),
             (10, "http://h.example/10", "<nav>never closed<article>text</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns(
        {c: F.lit("clash") for c in ("id", "key", "host", "rest", "body", "text")})
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    main = "A & B\n\none twobold\n\nthree four <i>\n\nx\n\ny"
    assert got == {1: main, 2: main, 3: "", 4: "", 5: "plain < text", 6: "first page only", 7: "second page only",
                   8: menu, 9: "left open", 10: "text"}
    assert html_text.extract(df).count() == len(pages)
    assert html_text.extract(df.limit(0)).count() == 0


def test_op6_runs_across_tasks(spark):
    same = " ".join(f"s{i}" for i in range(20))
    pages = [(i, f"http://h.example/{i}", f"<div>u{i} {same} v{i}</div>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(10)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {i: f"u{i} v{i}" for i in range(30)}


def test_op6_runs_judge_outside_of_articles(spark):
    menu = " ".join(f"menu{i}" for i in range(12))
    page = "<div>{1}</div><div>lead{0}</div><article><p>same article</p><p>of all</p></article><div>{1} note{0}</div>"
    pages = [(i, f"http://h.example/{i}", page.format(i, menu)) for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {
        i: f"lead{i}\n\nsame article\n\nof all\n\nnote{i}" for i in range(3)}


def test_op6_raw_elements_end_where_they_end():
    def texts(page):
        return [t for t, _, aside in html_text.blocks(page) if not aside]

    for odd in ("<svg/>", "<math />", '<svg a="x>y" viewBox="0 0 1 1"/>', "<SVG/>", "<svg><path d='m'/></svg>",
                "<script>a<b</script >", "<svg><title>x</title></svg>", "<style a=1>p{}</style x>",
                "<video-player></video-player>", "<object-view></object-view>", "<audio-player src=x></audio-player>",
                "<script-note></script-note>", "<svg-icon/>"):
        assert texts(f"<p>one</p>{odd}<p>two</p>") == ["one", "two"], odd
    assert texts("<video-player><p>one</p></video-player><p>two</p>") == ["one", "two"]
    assert texts("<p>one</p><div><video src='x'/><p>plays not</p></div><p>two</p>") == ["one", "two"]
    assert texts("<p>one</p><video><p>no video here</p></video><p>two</p>") == ["one", "two"]
    assert texts("<p>one</p><script/>no text<p>two</p>") == ["one"]


def test_op6_furniture_by_whole_names():
    def texts(page):
        return [t for t, article, aside in html_text.blocks(f"<article>{page}</article>") if article and not aside]

    for text in ('<section id="related-work">', '<h2 id="social-contract">', '<div class="share-price">', "<h2 id=menu>",
                 '<div class="entry-content no-sidebar">', '<section id="notice-2024">', '<div data-id="menu">',
                 '<div title="hidden id">', '<div style="x:hidden">', '<div class="ad-hoc">', '<p class="social">'):
        closing = f"</{text[1:].split()[0]}>"
        want = ["one", "two"] if "<p" not in text else ["two"]
        assert texts(f"{text}one{closing}<div>two</div>") == want, text
    for text in ('<div class="box ad">', '<div class="ad-2">', '<div id="comment_17">', '<div class="Cookie-Notice">',
                 '<section class="related_posts">', "<div class=sidebar>", '<div hidden>', '<section id="comments">'):
        assert texts(f"{text}one</{text[1:].split()[0].rstrip('>')}><div>two</div>") == ["two"], text
    assert [a for _, a, _ in html_text.blocks('<article class="post comment-open">x</article>')] == [True]
    assert [a for _, a, _ in html_text.blocks('<article class="comment">x</article>')] == [False]


def brute_topk(rows, k, every):
    fine = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in fine if j != i)
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_op7_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op7(spark, sf_dir).collect())) == brute_topk(rows, 20, 20)


def test_op7_shards_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8),
             (2004, []), (2005, [1.0, 2.0]), (2010, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in ("id", "v", "asks", "shard", "block", "score", "rank")})
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, shard_rows=100, query_rows=7)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 5, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_op7_index_stops_on_proof_only():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-40, 40, (3000, 16))
    index = topk.Index(np.arange(3000), vectors)
    asked = np.arange(0, 3000, 300)
    for i, (rows, scores) in zip(asked, index.search(vectors[asked], asked, 10), strict=True):
        all_scores = vectors @ vectors[i]
        want = sorted(((-int(s), j) for j, s in enumerate(all_scores) if j != i))[:10]
        assert sorted((-int(s), int(j)) for s, j in zip(scores, index.ids[rows], strict=True)) == want


def test_op6_scans_forward_once():
    long = 300_000
    for unit, end in (("<svg x", ""), ("<a '", ""), ("<a '", '">'), ('<a "', "'>"), ("<script ", ""), ("<a<b", ""),
                      ("<a<b", "\"'>"), ("<!x", ""), ("</p ", ""), ("<script></script ", ""), ("<svg '></svg>", "")):
        begin = time.process_time()
        html_text.blocks(unit * (long // len(unit)) + end)
        assert time.process_time() - begin < 5, unit
    texts = lambda page: [t for t, *_ in html_text.blocks(page)]
    assert texts("<p>one</p><a 'two") == ["one", "<a 'two"]
    assert texts("a < b<p title='x>y'>c</p><!-- <p> --><!doctype x>d <1>") == ["a < b", "c", "d <1>"]
    assert texts(f"<{'n' * 5000}>one</{'n' * 5000}>two") == ["one", "two"]
