"""HTML extraction, toxicity, mixing and the pipeline on small inputs."""

import hashlib
import random
import zlib

import duckdb
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brookmart.llm import byte_bpe, html_text, minhash_dedup, mixing, queries, toxicity, transducers

SF = "/root/testdata/sf0.001"

PAGES = [
    (None, ""),
    ("", ""),
    ("plain &amp; text", "plain & text"),
    ("<p>only one</p>", "only one"),
    ("<body><header><a href=x>Home</a></header><div id=content><h1>T</h1><p>One, two.<p>Three<ul><li>a<li>b</ul></div><div class='comments'><p>hi there, you</p></div><aside>side</aside></body>", "T\nOne, two.\nThree\na\nb"),
    ("<html><body><nav><ul><li><a href=1>a</a></ul></nav><article><h1>Title &lt;x&gt;</h1><p>A <b>bold<br>word</b>,\n  and&nbsp;more.</p><form>no</form><p>End</p></article><footer>&copy; me</footer>", "Title <x>\nA bold word, and more.\nEnd"),
    ("<article><p>x <a href=1>link</a> y</p><ul class=related-links><li><a>q</a></ul><script>var t='</p>';</script></article>", "x link y"),
    ("<main><p>cut off in the mid <b", "cut off in the mid"),
    ("<nav>only menus</nav>", ""),
    ("<div>" * 3000 + "deep", "deep"),
]


def test_html_cases(spark):
    rows = spark.createDataFrame([(i, f"u{i}", p, "t") for i, (p, _) in enumerate(PAGES)] + [(None, None, "<p>a</p>", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(rows).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i].text == want, i
        assert got[i].n_chars == len(want) and got[i].url == f"u{i}"
    assert got[None].text == "a" and html_text.extract(rows.limit(0)).count() == 0


LOOSE = [
    ("<article><p>x <a href=\"/hidden/falls\">link</a> y</p><p title='the hidden valley'>z</p><p data-x=\"a class=ad b\">w</p></article>", "x link y\nz\nw"),
    ("<article><p hidden>a</p><p class='ad'>b</p><p title=x hidden=''>c</p><p>d, e and f and more</p></article>", "d, e and f and more"),
    *((f"<body><nav>n</nav><div {x}><article><p>Long text, here.</p></article></div>", "Long text, here.") for x in ('class="content with-sidebar"', 'id="main-header-wrap"', "class='entry-content share-enabled'")),
    ("<body><div class='with-sidebar'><div class=text><p>One long text, of many words, here.</p><p>Two, three.</p></div><div class=sidebar><p>side</p></div></div>", "One long text, of many words, here.\nTwo, three."),
    ("<body><p class=more>First half.</p><p class=more>Other half.</p></body>", "First half.\nOther half."),
    ("<article><p>Text, of an article.</p><div class=comments><article><p>me too</p></article></div></article>", "Text, of an article."),
    ("<body><div class=comments><p>c, d</p></div><div><p>One, two and three and four.</p></div>", "One, two and three and four."),
    ("<body><header><h2>Site</h2></header><div><p>One, two and three and four and five.</p></div>", "One, two and three and four and five."),
    ("<form><div><p>Long text, here, of a page.</p><p>More.</p></div></form>", "Long text, here, of a page.\nMore."),
    ("<article><p>Long text, here, of a page.</p><form><p>Your name, please</p></form></article>", "Long text, here, of a page."),
    ("<div class='side-by-side content'><p>Hello, world, this is text.</p></div>", "Hello, world, this is text."),
    ("<body><p class=share-price>Price, 5 and more</p><p>Other, text, that is much longer than it.</p>", "Price, 5 and more\nOther, text, that is much longer than it."),
    ("<body><p>Text, that is longer than what is shared.</p><p class=share-buttons>Tell others</p>", "Text, that is longer than what is shared."),
    ("<article><header><h1>T</h1><ul><li><a href=x>menu</a></ul><a href=y>home</a></header><p>Text, of it.</p></article>", "T\nText, of it."),
    ("<body><div class='privacy-notice'><p>We keep your data, and more.</p></div><p>Text, that is longer than what the notice says.</p>", "Text, that is longer than what the notice says."),
    ("<article><div class='article-header'><h1>Title</h1></div><p>Text, of it.</p><div class='reader-comment'><p>Me, too</p></div></article>", "Title\nText, of it."),
    ("a < b and <3 c <p>d</p", "a < b and <3 c\nd"),
    ("<p title='it''s > \"x\"'>quotes, in tags</p>", "quotes, in tags"),
    ("<p>a<script>if (a < b) '</p>'</script >b</p>", "ab"),
]


LINKS = "<li><a href=1>Source one, of many</a></li><li><a href=2>Source two</a></li>"
ATTRIBUTES = [
    ("<div role='main'><p>Main text, here.</p></div>", "Main text, here."),
    ("<body><div role=navigation><p>menu</p></div><div role='banner x'><p>top</p></div><p>Long text, of the page.</p></body>", "Long text, of the page."),
    ("<article role=search><p>Text, with an odd role.</p></article>", "Text, with an odd role."),
    ("<article><p>a, b and c.</p><p aria-hidden=true>x</p><p aria-hidden=false>y</p><p hidden>z</p><p style='color:red; DISPLAY : none'>q</p><p style=color:red>r</p></article>", "a, b and c.\ny\nr"),
    ("<article><p role=note>a, b and c.</p><p role=''>d</p><p role>e</p></article>", "a, b and c.\nd\ne"),
    (f"<article><p>Text, one.</p><ul>{LINKS}</ul><p>Text, two.</p></article>", "Text, one.\nSource one, of many\nSource two\nText, two."),
    (f"<article><p>Text, one.</p><h2>Sources</h2><ol>{LINKS}</ol></article>", "Text, one.\nSources\nSource one, of many\nSource two"),
    (f"<article><p>Text, one.</p><ul class=comment-on-sources>{LINKS}</ul></article>", "Text, one.\nSource one, of many\nSource two"),
    (f"<article><p>Text, one.</p><ul class=menu>{LINKS}</ul><p>Text, two.</p></article>", "Text, one.\nText, two."),
    (f"<div><ul>{LINKS}</ul><p>Text, one.</p><ul>{LINKS}</ul><p>Text, two.</p><ul>{LINKS}</ul></div>", "Text, one.\nSource one, of many\nSource two\nText, two."),
    (f"<div><ul>{LINKS}</ul><p>Text, one and more of it.</p><h3>Sources</h3><ul>{LINKS}</ul></div>", "Text, one and more of it.\nSources\nSource one, of many\nSource two"),
    ("<article><p>Text, one.</p><table><tr><td><a href=x>Cell</a><td class='ad-free'><a href=y>Other</a></table><p>Text, two.</p></article>", "Text, one.\nCell\nOther\nText, two."),
    *((f"<article><p>Text, of the page.</p><{t} class='{c}'>Some more, of it.</{t}></article>", "Text, of the page.\nSome more, of it.") for t, c in (("p", "alert-level"), ("div", "social-history"), ("p", "comment-on-law"), ("p", "ad-free"), ("p", "cookie-recipes"), ("div", "newsletterHistory"))),
    *((f"<body><div class=story><p>Text, of the page, long.</p><{t} class='{c}'>Some more, of it.</{t}></div></body>", "Text, of the page, long.\nSome more, of it.") for t, c in (("p", "alert-level"), ("div", "social-history"), ("p", "comment-on-law"), ("p", "ad-free"))),
    *((f"<article><p>Text, of the page, long.</p><div class='{c}'>Not of it.</div></article>", "Text, of the page, long.") for c in ("sidebarLeft", "AdSlot", "comment-list", "wp-block-newsletter", "user-comments", "x cookie-notice", "ad300x250", "alert", "social-links")),
    ("<article><p>Text, of the page, long.</p><div class=comment-feed><a href=x>Reader one</a> <a href=y>Reader two</a></div></article>", "Text, of the page, long."),
    ("<body><div class=cookie-law-info><p>We use some.</p></div><div><p>Text, of the page, long.</p></div></body>", "Text, of the page, long."),
    ("<article><p>Text, one of two.</p><fieldset><legend>Note</legend><p>In a box.</p></fieldset><fieldset><p>Your name</p><input name=x></fieldset></article>", "Text, one of two.\nNote\nIn a box."),
]


def test_html_drops_no_article_on_loose_matches():
    for page, want in ATTRIBUTES:
        assert html_text.main_text(page) == want, page
    for page, want in LOOSE:
        assert html_text.main_text(page) == want, page


def test_html_is_read_in_linear_time():
    import time

    for unit in ("<a x=' ", "<b ", "</p>", "<div><i></p>", "<i></b>", "<center>", "</script ", "<li><i>", "<x ' y> ", "<td><b></i>"):
        page, began = "<b><div>" + unit * (1_000_000 // len(unit)), time.process_time()
        html_text.tree(page)
        assert time.process_time() - began < 15, unit


def test_html_of_the_test_pages(spark):
    import html
    import re

    pages = queries.table(spark, SF, "pages")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>?", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


def kinds(text, **lexicon):
    model = toxicity.Model(lexicon or {"idiot": 0.9}, {})
    return [(kind, round(weight, 2)) for kind, weight, _ in model.clauses(text, model.machine, 1.5)]


def test_transducers_compose():
    assert kinds("an idiot") == [("insult", 2.8)] and kinds("a friend, you") == []
    assert kinds("you big idiot") == kinds("idiot that you are") == [("aimed insult", 4.3)]
    assert kinds("not an idiot") == [("negated insult", 1.8)] and kinds("not at all some idiot") == kinds("not me, idiot") == [("insult", 2.8)]
    assert kinds("he said, what an idiot") == [("reported insult", 1.8)]
    assert kinds("to kill time") == [("threat", 0.0)] and kinds("i will kill you") == [("aimed intended threat", 3.0)]
    assert kinds("they said i will not kill you") == [("aimed reported negated intended threat", 1.0)]
    assert kinds("idiot idiot. you idiot") == [("insult", 5.6), ("aimed insult", 4.3)]  # paths and clauses add up
    swap = transducers.lexicon({"a": ("b", 1.0)})
    assert swap.then(transducers.scope("x", {"b": "c"}, 2, 0.5)).run(["x", "a", "a", "a"]) == [("x", 0.0), ("c", 1.5), ("c", 1.5), ("b", 1.0)]


def test_reported_speech_across_colons_and_quotation_marks():
    assert kinds("she said: idiot") == kinds("she: \"idiot\"") == kinds("laut ihm: «idiot»") == [("reported insult", 1.8)]
    assert kinds("he said: you are an idiot") == kinds("he wrote “you are an idiot”") == [("aimed reported insult", 3.3)]
    assert kinds('he wrote "i know. you idiot. really." you idiot') == [("aimed reported insult", 3.3), ("aimed insult", 4.3)]
    assert kinds('he said "fine" idiot') == kinds('"idiot"') == kinds("idiot: you") == kinds("not: idiot") == [("insult", 2.8)]
    assert kinds('he wrote "i know.\nan idiot"') == [("insult", 2.8)]  # a paragraph ends what nothing closes


def test_threats_are_inflected():
    for text in ("he kills you", "killing you", "stabbed you", "il te tue", "ich schlage dich", "te mata", "er tötet dich", "they will be strangling you"):
        assert "threat" in kinds(text)[0][0] and kinds(text)[0][0].startswith("aimed"), text
    assert toxicity.inflected("en", "slap") == {"slap", "slaps", "slapping", "slapped"} and {"punishes", "choking", "détruisez", "destruyen"} <= toxicity.THREATS
    assert not {"tuesday", "stable", "beatles", "matador"} & toxicity.THREATS


def test_toxicity_words_and_clauses_in_any_marks():
    for text in ("«idiot»", "“idiot”", "¡idiot!", "idiot—really", "you…idiot", "3idiot4", "IDIOT’s"):
        assert [k for k, _ in kinds(text.lower())] == ["insult"], text
        assert len(toxicity.Model({"idiot": 0.9}, {}).batch(pa.array([text]))[0][0]) == 1, text
    assert kinds("you. idiot") == kinds("you – idiot") == [("insult", 2.8)]


def test_toxicity_prefilter_misses_nothing(spark):
    rnd = random.Random(2)
    model = toxicity.Model({"idiot": 0.9, "täter": 0.7, "e": 0.6}, {"grum": 0.8, "ñandúes"[:5]: 0.5})
    pieces = ["idiot", "Täter", "grumpfel", "ñandú", "ñandúes", "kill", "você", "e", "x", "«", "”", "—", "…", ",", ".", "1", "\u0301", "\u00a0", "漢字", "İ", "ﬁ", "\u200b", " ", " ", "\n"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 9))) for _ in range(4000)]
    low, near = model.near(pa.array(texts))
    want = {i for i, t in enumerate(low.to_pylist()) if model.clauses(t, model.machine, 1.5)}
    assert want <= set(near.tolist()) and len(want) > 1000
    scores = model.batch(pa.array(texts))[1]
    for i, t in enumerate(low.to_pylist()):
        assert scores[i] == pytest.approx(model.score(float(model.features(t) @ model.weights)), abs=1e-9), t


def labelled(spark, n=600):
    rnd = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = [rnd.choice(words) for _ in range(rnd.randrange(3, 60))]
        if toxic:
            text[rnd.randrange(len(text))] = rnd.choice(["dolt", "Nitwit,", "grumpfel", "grumpfest", "GRUMPFÖ"])
        docs.append((i, " ".join(text) + ".", toxic))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    df = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(9000, None), (9001, ""), (None, "a dolt"), (9002, "word " * 50_000 + "dolt")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (9001, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    assert {"dolt", "nitwit"} <= set(model.words) and "grum" in model.stems
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(i, x) for i, _, x in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].predicted == int(x) for i, x in held) and len(held) > 80
    assert got[9000].predicted == got[9001].predicted == 0 and got[None].predicted == got[9002].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].clauses[0].endswith("a dolt")
    again = df.selectExpr("doc_id", "text", "1 AS score", "'x' AS clauses", "2 AS key").unionAll(df.selectExpr("doc_id", "text", "1", "'x'", "2"))
    assert toxicity.score(again, model).count() == 2 * len(got) and toxicity.reject(again, model).columns == again.columns
    assert toxicity.reject(df, model).count() == sum(r.predicted == 0 for r in got.values())
    held_rows = df.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held_rows)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "you will kill me"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(df, none)
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert got == {1: 1, 2: 0} and toxicity.score(df.limit(0), model).count() == 0


def test_label_values_of_held_out_rows_do_not_matter(spark):
    docs, labels = labelled(spark, 200)
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    turned = [(i, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, x in labels]
    a, b = (toxicity.fit(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert (a.words, a.stems, a.weights, a.bias) == (b.words, b.stems, b.weights, b.bias)


def test_mix_equals_sql(spark):
    docs = queries.table(spark, SF, "documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for share, epochs in ((0.6, 2), (1.7, 3), (5.0, 2), (0.01, 1)):
        got = mixing.mix(docs, queries.mix_domain(), share, epochs, queries.MIX_WEIGHTS)
        assert got.columns == [*docs.columns, "epoch", "mix_tokens"]
        want = con.execute(mixing.sql(queries.MIX_DOMAIN_SQL, share, epochs, queries.MIX_WEIGHTS)).fetchall()
        assert sorted((r.doc_id, r.epoch, r.mix_tokens) for r in got.collect()) == sorted(want)


def test_mix_budgets_by_hand(spark):
    rows = [(i, "x" * 40, "en", s, "clash", 0) for i, s in enumerate(["a"] * 60 + ["b"] * 30 + ["c"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string, bin int")
    got = mixing.mix(docs, F.lit("d"), 0.6, 1, bins=7)
    assert got.columns == [*docs.columns, "_epoch", "mix_tokens"]
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert n == {"a": 25, "b": 25, "c": 10}  # c is short, its siblings share the rest
    assert mixing.mix(docs, F.lit("d"), 0.6, 1, bins=1).exceptAll(got).count() == 0
    assert mixing.mix(docs.limit(0), F.lit("d")).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, "a", None, "s"), (1, "a", None, "s")], "doc_id long, text string, lang string, source string")
    assert mixing.mix(odd, F.lit(None), 1.0, 1).count() == 3


def test_pipeline_stage_by_stage(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_dedup", "mixing", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None
    docs = queries.table(spark, SF, "documents").cache()
    clean = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    assert clean.schema == docs.schema
    toxic = {r.doc_id for r in queries.op3_toxicity(spark, SF).filter("predicted = 1").collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == toxic
    one = corpus_pipeline.drop_near_copies(spark, clean, SF).cache()
    groups = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(clean, 80).collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(groups.values())
    mixed = corpus_pipeline.mix_sources(spark, one, SF).cache()
    assert mixed.columns == docs.columns and mixed.exceptAll(one).count() == 0 and 0 < mixed.count() < one.count()
    e = byte_bpe.encoding(queries.RANKS, P.PATTERN)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    out = corpus_pipeline.encode_decode(spark, mixed, SF).collect()
    assert len(out) == len(texts)
    assert all(r.n_tokens == len(e.encode_ordinary(texts[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)
    assert corpus_pipeline.run(spark, SF).count() == len(out)


def test_pipeline_stages_with_odd_rows(spark):
    long = "a word and more of them, " * 4000
    rows = [(None, None, None, None, None), (1, "", "en", "s1", 0), (2, long, "en", "s1", 5), (2, long, "en", "s1", 5), (3, long + "end", "en", "s2", 5), (None, long, None, "s2", 5), (4, "one two three four five six", "de", "s3", 3), (5, "one two three four five six", "de", "s3", 3)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, component_id string, epoch int")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    one = corpus_pipeline.drop_near_copies(spark, clean, SF)
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "2", "4", "None", "None"]
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.exceptAll(docs).count() == 0
    out = corpus_pipeline.encode_decode(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in out) == sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", ["op1_collision_dedup", "op9_mix_sources", "op10_rendezvous_shards"])
def test_registered(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
