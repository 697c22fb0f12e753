import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framestride.llm import html, licenses, rollups
from framestride.llm.bpe import Encoder, tokenizer_path
from tests.llm.test_text_tokens import plain_words

SF = "/root/testdata/sf0.01"


def article(source):
    """The article of a generated page, cut out by its known marks."""
    import html as markup
    import re

    start, stop = source.index("<article>"), source.find("</article>")
    inner = source[start : stop if stop >= 0 else len(source)]
    inner = re.sub(r"</?(?:p|h1|article)>", "\x01", inner).replace("<br>", " ")
    parts = (" ".join(markup.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in inner.split("\x01"))
    return "\n\n".join(p for p in parts if p)


def test_articles_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


P = "A paragraph of the story that is long enough to look like prose, with &eacute; and &lt;b&gt;."
Q = "A paragraph of the story that is long enough to look like prose, with é and <b>."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div id=wrap><div class='side-bar sidebar'><p>{P}</p></div><div><h2>T</h2><section><p>{P}<p>{P}</section><section><p>{P}</p></section></div></div>", ["T", Q, Q, Q]),
        (f"<header><h1>Site</h1><p>Tagline</p></header><article><header><h1>Title</h1></header><p>{P}</p></article><div class=comments><p>{P}</p><p>{P}</p></div>", ["Title", Q]),
        (f"<div class='cookie-notice'><p>{P}</p></div><main><p>{P}</p><ul><li>one<li>two</ul><form><p>{P}</p></form></main><footer><p>{P}</p></footer>", [Q, "one", "two"]),
        (f"<p>{P}</p><script>var a = '<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>{P}", [Q, Q]),
        (f"<body><div><a href=a>one link</a> <a href=b>two link</a> <a href=c>three link</a></div><div><p>{P}</p><p>{P}</p></div></body>", [Q, Q]),
        ("<p>a\n  b<br>c&nbsp;d</p>e", ["a b c d", "e"]),
        ("no markup &amp; all", ["no markup & all"]),
        ("<p><b>open <i>never closed", ["open never closed"]),
        ("<div a='>'>x</div>", ["x"]),
        (None, []),
        ("", []),
        ("<html><body><nav>menu</nav></body></html>", []),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><h1>T</h1><p>{P}</p><h2 id='related-work'>Related work</h2><p>{P}</p><h2 id=login-flow class=search>Login</h2><p>{P}</p></article>", ["T", Q, "Related work", Q, "Login", Q]),
        (f"<article><p>{P}</p><p>{P}</p><section id='search-and-navigation'><h2>S</h2><p>{P}</p></section></article>", [Q, Q, "S", Q]),
        (f"<main><p>{P}</p><p class='promotion-rules'>{P}</p><div id=terms><p>{P}</p></div></main>", [Q, Q, Q]),
        (f"<div><h1>T</h1><p>{P}</p><section id=related-work><h2 id=social-login>Work</h2><p>{P}</p></section></div>", ["T", Q, "Work", Q]),
        (f"<article><p>{P}</p><div class='related-posts'><a href=a>one</a> <a href=b>two</a></div><div id=share><b>Share</b> <i>this</i></div><p>{P}</p></article>", [Q, Q]),
        (f"<article><p>{P}</p><p hidden>{P}</p><p>{P}</p></article>", [Q, Q]),
    ],
)
def test_slugs_inside_the_article_are_kept(page, want):
    assert html.main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><h1>T</h1><form action=x><input name=q><div><p>{P}</p><p>{P}</p><select><option>no</select></div></form></body>", [Q, Q]),
        (f"<body><form id=search><nav>menu</nav><article><p>{P}</p><p>{P}</p><button>no</button></article></form><aside><p>{P}</p></aside></body>", [Q, Q]),
        (f"<dialog open><article><p>{P}</p></article></dialog><p>Short line.</p>", [Q]),
        (f"<body><object data=x><p>{P}</p><p>{P}</p></object></body>", [Q, Q]),
        (f"<header><h1>Site</h1></header><div class='content has-sidebar'><p>{P}</p><p>{P}</p></div>", [Q, Q]),
        (f"<div class=masthead><h1>Site</h1></div><div class='content has-sidebar'><p>{P}</p><p>{P}</p></div>", [Q, Q]),
        (f"<header><h1>T</h1><p>{P}</p><p>{P}</p></header><footer><p>{P}</p></footer>", ["T", Q, Q]),
        (f"<article><p>{P}</p><aside><p>{P}</p></aside><form><p>{P}</p></form><p>{P}</p></article>", [Q, Q]),
        (f"<article><p>{P}</p></article><aside><p>{P}</p><p>{P}</p></aside>", [Q]),
    ],
)
def test_wrappers_of_the_page_are_kept(page, want):
    assert html.main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize(
    "page",
    [
        f"<head><script>for(i=0;i<n;i++){{}} // don't</script></head><body><article><p>{P}</p><p>We're here. {P}</p></article></body>",
        f"<body><script>for(i=0;i<n;i++){{}} // don't</script><article><p>{P}</p><p>We're here. {P}</p></article></body>",
        f"<body><script><!-- x; </script><article><p>{P}</p><p>We're here. {P}</p></article></body>",
        f"<body><script>a = \"<!--\"; b = '<p ';</script><style>a > b::after{{content:\"'\"}}</style><article><p>{P}</p><p>We're here. {P}</p></article></body>",
        f"<body><article><p>{P}</p><p title=it's>We're here. {P}</p></article></body>",
        f"<article><p>{P}</p><p>We're here. {P}</p><div class='comments'><p>{P}</p><p>{P}</p></div></article>",
        f"<article><p>{P}</p><p>We're here. {P}</p><section id='comments'><h3>Comments</h3><p>{P}</p></section></article>",
        f"<main><p>{P}</p><p>We're here. {P}</p><ol class='comment-list'><li><article class=c><p>{P}</p><p>{P}</p><p>{P}</p></article></ol></main>",
        f"<div><h1>T</h1></div><div><article><p>{P}</p><p>We're here. {P}</p><div id=disqus_thread>{P}{P}{P}</div></article></div>",
    ],
)
def test_scripts_and_reader_comments_leave_the_article_alone(page):
    assert html.main_text(page) == f"{Q}\n\nWe're here. {Q}"


@pytest.mark.parametrize(
    "page",
    ["<div>" * 200_000 + "deep", "<p><button>" + "<div>" * 200_000 + "deep", "<a " * 350_000, '<a x=">" ' * 120_000, "<b><div></b>" * 60_000, "<i>" * 200_000 + "</p>" * 200_000, "<a '>" * 100_000, "<" * 1_000_000],
)
def test_time_grows_with_the_page(page):
    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 8


def test_deep_and_broken_markup_ends():
    assert "deep" in html.main_text("<div>" * 3000 + "deep")
    assert html.main_text("<" * 5000) == "<" * 5000
    assert html.main_text("</p></div><p>x</p></span>") == "x"


def test_pages_defined_results(spark):
    rows = [(1, None, None), (None, "u", "<p>x</p>"), (2, "u", ""), (2, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = sorted((tuple(r) for r in html.extract(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "x", 1), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert html.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT", (["mit"], True)),
        ("MIT OR GPL-2.0-only", (["mit", "gpl-2.0-only"], True)),
        ("MIT AND GPL-2.0-only", (["mit", "gpl-2.0-only"], False)),
        ("GPL-2.0 OR MIT AND GPL-3.0", (["gpl-2.0", "mit", "gpl-3.0"], False)),
        ("(GPL-2.0 OR MIT) AND ISC", (["gpl-2.0", "mit", "isc"], True)),
        ("GPL-2.0+ WITH Classpath-exception-2.0 OR Apache-2.0", (["gpl-2.0+", "classpath-exception-2.0", "apache-2.0"], True)),
        ("GPL-2.0 WITH x AND MIT", (["gpl-2.0", "x", "mit"], False)),
        ("MIT */ and more", (["mit"], True)),
        ("((MIT) OR (ISC))", (["mit", "isc"], True)),
        ("MIT OR", (["mit"], True)),
        ("MIT)", (["mit"], True)),
        ("(MIT", None),
        ("AND MIT", None),
        ("see below", None),
        ("MIT and see below", (["mit"], True)),
        ("MIT OR LicenseRef-mine", (["mit", "licenseref-mine"], True)),
        ("GPL-3.0+.", (["gpl-3.0+"], False)),
        ("CC-BY-NC-SA-4.0 OR MPL-2.0", (["cc-by-nc-sa-4.0", "mpl-2.0"], False)),
        ("", None),
    ],
)
def test_expressions(text, want):
    assert licenses.parse(text) == want


def test_scan_equals_plain_search(spark, odd, odd_rows):
    texts = [
        "Licensed under the MIT License. LICENSED UNDER THE\nMIT-LICENSE", "submit license under the mit license2", "the Apache License, Version 2.0", "cc-by-nc cc by nc by nc",
        "// SPDX-License-Identifier: GPL-3.0-only OR MIT\nx", "SPDX-License-Identifier: ???", "GNU General Public License, version 3.", *(r[1] for r in odd_rows),
    ]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash")).withColumn("n_words", F.lit("x"))
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for k, text in rows:
        w = plain_words(text)
        found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[k]
        at = [i for i, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(found), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[4]["labels"] == "gpl-3.0-only,mit" and got[4]["permissive"] is True and got[4]["score"] == 1.0
    assert got[5]["score"] == 0.3 and got[6]["labels"] == "gpl-3"
    assert licenses.scan(odd).count() == len(odd_rows)
    assert licenses.scan(df.limit(0)).collect() == []


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def test_rollup_batches(spark, tmp_path):
    rollup = rollups.TokenRollup(spark, str(tmp_path / "r"))
    assert totals(rollup) == {}
    rows = spark.createDataFrame([("a", "en", 5, 7), ("a", "en", 3, 3), (None, None, None, 2), ("b", "de", 4, 0)], "source string, lang string, old long, new long")
    rows = rows.withColumn("n_docs", F.lit("clash"))
    first = rollups.change("insert", rows, new="v1", new_tokens="old")
    assert rollup.commit("1", first) and not rollup.commit("1", first)
    assert totals(rollup) == {("a", "en", "v1"): (2, 8), (None, None, "v1"): (1, 0), ("b", "de", "v1"): (1, 4)}
    assert rollup.commit("2", rollups.change("revise", rows.where("source = 'a'"), "v1", "v2"))
    rollup.snapshot()
    assert totals(rollup) == {("a", "en", "v2"): (2, 10), (None, None, "v1"): (1, 0), ("b", "de", "v1"): (1, 4)}
    assert rollup.commit("3", rollups.change("delete", rows.where("source = 'b'"), "v1", old_tokens="old"))
    assert rollup.commit("4", rollups.change("delete", rows.limit(0), "v1"))
    assert not rollup.commit("2", first)
    again = rollups.TokenRollup(spark, str(tmp_path / "r"))
    assert totals(again) == {("a", "en", "v2"): (2, 10), (None, None, "v1"): (1, 0)}
    again.snapshot()
    assert totals(again) == totals(rollup) and again.batches() == ["1", "2", "3", "4"]


def test_unknown_change_is_an_error(spark):
    rows = spark.createDataFrame([("a", "en", 1, 1)], "source string, lang string, old long, new long")
    with pytest.raises(Exception, match="unknown kind"):
        rollups.deltas(rollups.change("replace", rows, "v", "v")).collect()


def test_rollup_of_a_corpus(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (3, None, 0), (None, 0, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"], r["version"]) for r in rollups.corpus_rollup(odd, labels).collect()}
    library = Encoder(tokenizer_path()).library
    docs, tokens = Counter(), Counter()
    for doc, text, lang, source, _ in odd_rows:
        if doc == 1:
            continue
        docs[source, lang] += 1
        tokens[source, lang] += 0 if doc == 3 else len(library.encode(text or "", add_special_tokens=False).ids)
    assert got == {k: (docs[k], tokens[k], rollups.BPE) for k in docs}
    assert rollups.corpus_rollup(nothing, labels.limit(0)).collect() == []
