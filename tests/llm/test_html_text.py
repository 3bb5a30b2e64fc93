import html
import re

from floodlens.llm.html_text import container_of, extract_text, infer, infer_wrappers, main_text, packed, stream, unpacked, written

SF = "/root/testdata/sf0.01"


def test_pages(spark):
    """The article of every page, read with plain patterns that only hold for these pages."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", article) if False else re.sub(r"</?b>", "", article).replace("<br>", " "))
        want = [" ".join(html.unescape(p).split()) for p in parts]
        assert r.text == "\n".join(w for w in want if w) and r.n_chars == len(r.text)


def page(body, nav="Home", foot="f"):
    return f"<html><body><div class='menu'><a>{nav}</a></div><div class=wrap>{body}</div><div id='footer'>{foot}</div></body></html>"


def test_furniture():
    text = main_text("""<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header>
      <div id=nav><a>x</a></div><div class="layout"><div class="post-content"><h1>Title &amp; more</h1><p>One<br>two <b>bo</b>ld &#169;<p>Three &lt;x&gt; a < b
      <div class=ad>buy</div><ul><li>i1<li>i2</ul><script>var a="</p>";</script><table><tr><td>c1<td>c2</table></div><aside>side</aside></div>
      <section class="comments"><p>nice</p></section><form><p>f</p></form><!-- <p>no</p> --><footer>f</footer></body></html>""", None)
    assert text == "Title & more\nOne two bold ©\nThree <x> a < b\ni1\ni2\nc1\nc2"


def test_wrapper_has_optional_and_repeated_groups():
    pages = [page("<h1>A</h1>" + "<p>t%d</p>" * k % tuple(range(k)) + extra) for k, extra in ((2, ""), (3, "<blockquote>q</blockquote>"), (1, ""))]
    wrapper = infer(pages)
    assert "(<p # >p)+" in written(wrapper) and "(<blockquote)?" in written(wrapper)
    assert container_of(wrapper) == ("html", "body", "div.wrap")


def test_repeated_text_stays():
    """Text that all pages of a host share is still text of the article."""
    pages = [page("<article><p>same</p><p>%d</p></article>" % i) for i in range(4)]
    path = container_of(infer(pages))
    assert [main_text(p, path) for p in pages] == [f"same\n{i}" for i in range(4)]
    assert main_text(page("<article></article>"), path) == "" and main_text(page("<p>other template</p>"), path) == "other template"


def test_edges(spark):
    rows = [(1, "http://a.b/x", None), (2, None, "<p>one"), (3, "http://A.b:80/y", ""), (4, "//u@c.d", "plain &amp; text"), (5, "bad url", "<p " + "a" * 100),
            (6, "http://a.b/z", "<article><p>" + "long &nbsp; text " * 20_000 + "</article>"), (None, "http://a.b/x", "<article>n</article>"),
            (7, "http://a.b/q", "<article>n</article>"), (7, "http://a.b/q", "<article>n</article>"), (8, "http://a.b/q", "</div></p><script>x"),
            (9, "http://e.f/", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    frame = spark.createDataFrame([(*r, "h", "c") for r in rows], "page_id bigint, url string, html string, host string, container string")
    for limit in (8 << 20, 0):
        got = extract_text(frame, limit).collect()
        by = {r.page_id: r.text for r in got}
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert by[1] == by[3] == by[8] == "" and by[2] == "one" and by[4] == "plain & text" and by[7] == by[None] == "n" and by[9] == "deep"
        assert by[6] == " ".join(["long text"] * 20_000)
    assert extract_text(frame.where("false")).count() == 0
    assert infer_wrappers(frame).count() == 4


def texts_of(bodies):
    pages = [page(b) for b in bodies]
    path = container_of(infer(pages))
    return [main_text(p, path) for p in pages], [main_text(p, None) for p in pages]


def test_all_that_varies_is_read():
    """Hosts without an article, with a body in two parts, and with several articles."""
    long = "long text " * 40
    forms = ["<div class=post><div class=entry-content><p>%d a LONG</p></div><div class=more><p>%d b LONG</p></div></div>",
             "<div class=page><h1>%d t</h1><p>%d lead</p><div class=text><p>%d LONG LONG LONG</p></div></div>",
             "<article class=first><p>%d LONG</p></article><article class=second><p>%d more</p></article>",
             "<h1>%d t</h1><article><p>same</p><div><p>%d LONG</p></div></article>"]
    for form in forms:
        form = form.replace("LONG", long)
        bodies = [form.replace("%d", str(i)) for i in range(4)]
        want = [[" ".join(x.split()) for x in re.split("<[^>]*>", b) if x.strip()] for b in bodies]
        for got in texts_of(bodies):
            assert [t.split("\n") for t in got] == want


def test_what_all_pages_share_is_template():
    """Lists without a furniture name too, as long as an article is nowhere around them."""
    form = "<div class=x><ul><li>Home<li>About<li>Help</ul></div><div class=y><h1>%d t</h1><p>%d u</p><p>%d v</p></div>"
    assert texts_of([form.replace("%d", str(i)) for i in range(3)])[0] == [f"{i} t\n{i} u\n{i} v" for i in range(3)]


def test_slugs_are_no_furniture():
    """Ids and classes after titles, in an article and in plain containers; names of furniture still count."""
    body = ("<h2 id='data-sharing'>a</h2><p class='social-history'>b</p><section id='related-work'><h3 id=search>c</h3><p id=notice>d</p></section>"
            "<section id='search-algorithms'><p>e</p></section><div class=section id='login-flow'><p>f</p></div>"
            "<table id='skip-lists'><tr id=comments><td>g</table><ul><li id='ad'>h</ul>")
    junk = ("<p class=advert>1</p><section class='related-posts'>2</section><ul class='share-buttons'><li>3</ul><section class='comments list'>4</section>"
            "<div id='my-sidebar'>5</div><p class='share links'>6</p>")
    for around in ("article", "main", "div"):
        for outside in ("", "<section id='comments'>7</section>", "<section id='related-posts'>8</section>"):
            text = main_text(page(f"<{around}>{body}{junk}</{around}>{outside}"), None)
            assert text.split("\n") == list("abcdefgh"), (around, outside)
    assert main_text(page("<article><section id='comments'><p>On comments</p></section></article>"), None) == "On comments"


def test_all_pages_of_a_host_decide(spark):
    """Thirteen pages and more: those that any twelve of them miss count as well, and long ones vote too."""
    def page(i, holder):
        return f"<html><body><div class='{holder}'><p>text {i} of it</p><p>more {i * 7}</p></div><div class='footer'>same</div></body></html>"
    rows = [(i, "http://h.example/%d" % i, page(i, "alpha" if i < 20 else "beta")) for i in range(60)]
    rows.append((60, "http://h.example/60", page(60, "beta") + "<!--" + "x" * 300_000 + "-->"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1, 12, 240):
        (found,) = infer_wrappers(pages, run_pages=1, bucket_pages=size).collect()
        assert "div.beta" in found.container
    streams = unpacked(packed(rows[0][2]))
    assert [(i.key, i.path) for i in streams] == [(i.key, i.path) for i in stream(rows[0][2])]
    lone = spark.createDataFrame(rows[-1:], pages.schema)
    assert infer_wrappers(lone).count() == 1  # a page however long
