import hashlib

import duckdb
import pandas as pd
import pytest

from wayfold.llm import chat, html, urls

RULED = {
    "https://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
    "http://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/", "block"),
    "http://badexample.com/de/1": ("badexample.com", "/de/1", None, "allow"),
    "ftp://q.org/fr/": ("q.org", "/fr/", "org/fr/", "allow"),
    "http://q.net": ("q.net", "", None, "allow"),
    "http://q.net?u://v": ("q.net", "", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://É.org:80/fr/a?b": ("É.org:80", "/fr/a", None, "allow"),
}


def test_rules_hosts_and_paths(spark):
    pages = spark.createDataFrame(list(enumerate(RULED)), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS n")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(pages, none, urls.RULES).join(pages.select("page_id", "url"), "page_id").collect()}
    assert got == RULED
    assert urls.url_filter(pages.limit(0), none, urls.RULES).count() == 0


def test_reputation_shrinks_and_equals_sql(spark):
    hosts = ["good.site.com", "bad.site.com", "new.site.com", "bad.spam.org", "x.spam.org", "y.spam.org", "a.co.uk", "b.co.uk", "c.b.co.uk", "10.0.0.1"]
    pages, labels, n = [], [], 0
    for h in hosts:
        for i in range(60):
            pages.append((n, f"http://{h}/p{i}"))
            if i % 3 and h != "new.site.com":
                bad = "spam" in h or h.startswith("bad") or i % 20 == 0
                labels.append((n, 0 if bad else 1, int(bad and i % 2)))
            n += 1
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url"]))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]))
    want = con.execute(urls.OP1_SQL).fetchall()
    outcomes = spark.createDataFrame([(d, int(q == 1 and t == 0)) for d, q, t in labels], "page_id long, good int")
    got = urls.url_filter(spark.createDataFrame(pages, "page_id long, url string"), outcomes, urls.RULES).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.n_labelled, round(r.good, 6), round(r.upper, 6)) for r in got) == sorted(want)
    good = {r.host: (r.good, r.verdict) for r in got}
    assert good["bad.spam.org"][1] == good["bad.site.com"][1] == "block" and good["good.site.com"][1] == "allow"
    assert good["x.spam.org"][0] < good["new.site.com"][0] < good["good.site.com"][0]


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|>\n \\ there"), (1, 2, "assistant", "</s>[INST] ok [/INST]"),
    (2, 0, "system", "be kind"), (2, 1, "user", "other"), (2, 2, "assistant", "yes"), (2, 3, "user", None), (2, 4, "assistant", ""),
    (3, 0, "system", "be kind"), (3, 1, "user", "other"), (3, 2, "assistant", "yes"),
    (4, 0, "assistant", "\\<|turn|>\\"), (4, 1, None, "x" * 70000), (4, 2, "odd\nrole\\", "y"), (5, 0, "system", "be kind"), (None, 0, "user", "null id"),
]


def digest(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "".join(t or "" for _, _, r, t in rows if r == "assistant")
    return len(rows), sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)), len(said), sha(said)


@pytest.mark.parametrize("tokens", [chat.PACK_TOKENS, 60])
def test_packs_read_back(spark, tokens):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS path", "2 AS head")
    packs = chat.pack_chats(df, tokens)
    want = {c: digest(sorted((t for t in TURNS if t[0] == c), key=lambda t: t[1])) for c in {t[0] for t in TURNS}}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(packs).collect()}
    assert got == want
    for p in packs.collect():
        seen = [i for n in p.nodes for i in range(n.start, n.start + n.length)]
        assert seen == list(range(len(p.text)))  # every token once, in order
        for n in p.nodes:
            before = sum(a.stop - a.start for a in n.attends)
            assert n.position == before and (n.parent == -1) == (not n.attends)
            assert all(a.stop < b.start for a, b in zip(n.attends, n.attends[1:], strict=False))
    if tokens > 60:
        tree = [p for p in packs.collect() if {c.conv_id for c in p.conversations} == {1, 2, 3, 5}]
        assert len(tree) == 1 and tree[0].text.count("be kind") == 1 and tree[0].text.count("yes") == 1
    assert chat.pack_chats(df.limit(0)).count() == 0


def test_escapes_are_reversible():
    for t in ("", "\\", "<|", "\\<|\\|>", "<s></s>[INST][/INST]<<SYS>><</SYS>>", "a\nb", "<|end|>\n<|turn|>user\nx"):
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
        assert chat.parse_turns(chat.format_turn("ro\nle", t) * 2) == [("ro\nle", t)] * 2


PAGES = [
    ("<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a>Menu</a></ul></nav><div class=ad>Buy</div><article><h1>Head</h1><p>One <b>two<br>three</b>\n &amp; four<p>Five</article><footer>F</footer></body></html>", "Head\n\nOne two three & four\n\nFive"),
    ("<html><body><div class='cookie-banner'>We use</div><main><div id=content><p>A &lt;b&gt; &#233;</p><aside>no</aside><form>no <input></form><ul><li>x<li>y</ul></div><section class='comments'><p>troll</p></section></main>", "A <b> é\n\nx\n\ny"),
    ("<p>bare &nbsp; text <!-- c --> here <style>p{}</style>", "bare text here"),
    ("no tags at all", "no tags at all"),
    ("<article><p>cut off <b>in the mid", "cut off in the mid"),
    ("", ""),
    (None, ""),
    ("<article>" + "<div>" * 3000 + "deep", "deep"),
    ("<article><table><tr><td>a<td>b</table><pre>c\n d</pre></article>", "a\n\nb\n\nc d"),
    ("<article><p>a <a href='>'>b</a> < c</p></article><article><p>second</p></article>", "a b < c\n\nsecond"),
]


def test_main_text(spark):
    rows = [(i, f"http://h{i}.com/", h) for i, (h, _) in enumerate(PAGES)] + [(100, None, "<p>x"), (100, None, "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS host", "'w' AS wrapper")
    got = html.extract_pages(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 100:
            assert r.text == PAGES[r.page_id][1], r.page_id
        assert r.n_chars == len(r.text)
    assert html.extract_pages(df.limit(0)).count() == 0


def test_wrappers_align_pages_of_a_host(spark):
    base = "<html><body><nav><a>m</a></nav>{}<article><h1>t</h1>{}</article></body></html>"
    pages = [("h", base.format("", "<p>a</p>")), ("h", base.format("<div class=ad>x</div>", "<p>a</p><p>b</p>")), ("h", base.format("", "")), ("g", "<p>x</p>")]
    got = {r.host: html.load(r.wrapper) for r in html.wrappers(spark.createDataFrame(pages, "host string, html string")).collect()}
    assert {h: (n, html.dump(w)) for h, (n, w) in got.items()} == {"h": (3, "html(body(nav(a(#=)) div.ad?(#=) article(h1(#=) p*(#=))))"), "g": (1, "p(#=)")}
    assert html.load(html.pack(*got["h"])) == got["h"]


def host_pages(rng, n):
    """Pages without article or main, all tags alike: menu, offer, notice in the text and ending are the same on each."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    out = []
    for i in range(n):
        own = [text(rng.randrange(8, 40)) for _ in range(rng.randrange(2, 6))]
        at = rng.randrange(len(own) + 1)
        body = "".join(f"<p>{t}</p>" for t in [*own[:at], "All prices include tax and may change.", *own[at:]])
        page = f"<html><body><div><div><p>Start</p><p>Shop</p></div><div>{body}</div></div><div><p>Part of the group</p></div></body></html>"
        out.append((i, f"http://h{i % 3}.com/{i}", page, "\n\n".join(own)))
    return out


def test_template_texts_are_told_by_the_wrapper(spark, monkeypatch):
    import random

    rows = host_pages(random.Random(4), 90)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    want = {r[0]: r[3] for r in rows}
    assert {r.page_id: r.text for r in html.extract_pages(df).collect()} == want
    monkeypatch.setattr(html, "FAN", 4)
    assert {r.page_id: r.text for r in html.extract_pages(df).collect()} == want
    # alone, a page doesn't show what is template
    few = {r.page_id: r.text for r in html.extract_pages(df.where("page_id < 3")).collect()}
    assert all("All prices" in few[i] for i in range(3))


def test_regions_by_mass_and_marks():
    one = lambda page: html.extract(page, html.region(1, html.skeleton(html.tree(page))))
    long = "word " * 40
    assert one(f"<div class='layout has-sidebar'><article><p>{long}</p></article></div>") == long.strip()
    assert one(f"<article class=a><p>one {long}</p></article><section><article class=b><p>two</p></article></section>") == f"one {long.strip()}\n\ntwo"
    assert one(f"<article><p>short</p><section class=comments><article class=comment><p>{long}</p></article></section></article>") == "short"
    assert one(f"<div class=related><article class=teaser><p>x</p></article></div><main><p>{long}</p></main>") == long.strip()
    assert one(f"<div class=sidebar><p>{long}</p></div>") == long.strip()
    deep = "<div>" * 200 + f"<div class=ad>no</div><article><p>{long}</p></article>" + "</div>" * 200
    assert one(deep) == long.strip()


def test_ids_and_classes_of_headings_and_paragraphs_drop_nothing():
    one = lambda page: html.extract(page, html.region(1, html.skeleton(html.tree(page))))
    page = '<article><h2 id="related-work">a</h2><h3 id="search-algorithm">b</h3><p id="share-of-votes">c</p><p class="notice-board">d</p><section id="related-work"><p>e</p></section><div id="comments"><p>no</p></div><ul id="main-nav"><li>no</ul><p>f</p></article>'
    assert one(page) == "a\n\nb\n\nc\n\nd\n\ne\n\nf"


@pytest.mark.parametrize("n", [2, 7, 8, 12])
def test_a_sentence_that_articles_share_stays_however_many_pages(spark, n):
    page = lambda i: f"<html><body><nav>menu</nav><article><p>The same opening.</p><p>{'word ' * (20 + i)}{i}</p></article></body></html>"
    df = spark.createDataFrame([(i, f"https://a.org/{i}", page(i)) for i in range(n)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract_pages(df).collect()} == {i: f"The same opening.\n\n{'word ' * (20 + i)}{i}" for i in range(n)}


def plain_wrapper(pages):
    """Labels and flags of pages whose children have distinct labels in one order, by looking at each label of all pages."""
    order, seen = [], {}
    for p in pages:
        for x in p:
            if x[0] not in seen:
                seen[x[0]] = []
                order.append(x[0])
            seen[x[0]].append(x)
    return [(lab, "1" if len(seen[lab]) == len(pages) else "?", plain_wrapper([x[2] for x in seen[lab]])) for lab in sorted(order)]


def test_alignment_equals_a_plain_union_of_labels():
    import random

    rng = random.Random(6)

    def draw(depth, names, share=0.7):
        return [[n, "1", draw(depth - 1, names, share) if depth else []] for n in names if rng.random() < share]

    for _ in range(200):
        # the first page has all labels in order; of two that no page has together the order would be open
        pages = [draw(2, "abcd", 1), *[draw(2, "abcd") for _ in range(rng.randrange(1, 5))]]
        merged = pages[0]
        for p in pages[1:]:
            merged = html.align(merged, p)
        shape = lambda items: sorted((x[0], "?" if x[1] == "?" else "1", shape(x[2])) for x in items)  # noqa: E731, B023
        # an element is optional once a page with its parent lacks it
        assert shape(merged) == plain_wrapper(pages)
