import random

import pytest

from tapeframe.llm import templates as T

SCHEMA = "page_id long, url string, html string"


def text(html):
    found, _ = T.blocks(html)
    return T.main_text(found, "", set(), set())


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("a<b>b</b>c", "abc"), ("a<br>b", "a b"), ("a &amp;&lt;&eacute;&#233;&#x41; b", "a &<éé" + "A b"),
        ("<script>var t='</p>';</script>x<style>p{}</style>", "x"), ("x<!-- <p>no</p> -->y", "xy"), ("<div>a</div>\n\t<div>  b \n c </div>", "a b c"),
        ("<nav><ul><li>menu</ul></nav><p>text", "text"), ("<div class=\"site-sidebar\">no</div><p>yes</p>", "yes"), ("<div id=comments><p>no</div><p>yes", "yes"),
        ("<p class='download'>yes", "yes"), ("<div class='has-sidebar'>yes</div>", "yes"), ("<div hidden>no</div><div style='display: none'>no</div>yes", "yes"),
        ("<header>top</header><article><header><h1>T</h1></header><p>x</p></article><footer>f", "T x"), ("<p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<a href='x>y'>link</a>", "link"), ("<p>cut <b", "cut"), ("<title>t</title><p>a", "a"), ("<main>m</main><div>other</div>", "m"), ("</div></p>x", "x"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<form>f<p>g</form>h", "h"), ("<div class='cookie-notice'>c</div>d", "d"), ("<textarea>no</textarea>e", "e"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a b c"), ("<img alt='x'>i<input>j", "ij"), ("<P>A</P><DIV>B</DIV>", "A B"),
    ],
)
def test_blocks(html, want):
    assert text(html) == want


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(1000)) for _ in range(n))


def site(r, host, n, shape):
    """Pages of one template, and their main text."""
    out = []
    for k in range(n):
        title, paras = words(r, 4), [words(r, r.randint(3, 60)) for _ in range(r.randint(1, 6))]
        menu = "".join(f"<li><a href='/{i}'>{words(r, 1)}</a></li>" for i in range(r.randint(3, 8)))
        body = "".join(f"<p>{p}</p>" for p in paras)
        if shape == "article":
            html = f"<html><head><title>{title}</title></head><body><nav><ul>{menu}</ul></nav><div class='ad'>{words(r, 9)}</div><article><h1>{title}</h1>{body}</article><section class='comments'><p>{words(r, 30)}</p></section><aside>{words(r, 5)}</aside><footer>&copy; {words(r, 3)}</footer></body></html>"
        else:
            html = f"<body><div class='x1'><ul>{menu}</ul></div><div class='x2'><div class='x3'><h2>{title}</h2>{body}<p>Read this on our pages every day.</p></div></div><div class='x4'>{words(r, 2)}</div></body>"
        out.append((f"http://{host}/p/{k}", html, " ".join([title, *paras])))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_templates_of_hosts(spark, parts):
    r = random.Random(4)
    pages = [(i, *p) for i, p in enumerate(site(r, "a.example.org", 40, "article") + site(r, "b.example.org:8080", 30, "div") + site(r, "few.example.org", 1, "article"))]
    df = spark.createDataFrame([p[:3] for p in pages], SCHEMA).selectExpr("*", "'x' as text", "1 as host", "2 as token").repartition(parts)
    got = {x.page_id: x for x in T.digest(T.extract(spark, df)).collect()}
    for i, url, _, want in pages:
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))
    found = {x.host: x for x in T.templates(spark, df).collect()}
    assert found["b.example.org"].container == "/body/div.x2/div.x3" and len(found["b.example.org"].constant) == 1
    assert found["b.example.org"].peripheral == ["/body/div.x1/ul/li"]


def test_classes_have_equal_vectors(spark):
    """The sums tell the same classes as the vectors themselves."""
    r = random.Random(6)
    pages = [(i, u, h) for i, (u, h, _) in enumerate(site(r, "h", 25, "article"))]
    counts = [T.blocks(h)[1] for _, _, h in pages]
    vectors = {}
    for p in {p for c in counts for p in c}:
        vectors.setdefault(tuple(c.get(p, 0) for c in counts), set()).add(p)
    lines = T.templates(spark, spark.createDataFrame(pages, SCHEMA)).first().template.split("\n")
    classes = {}
    for line in lines:
        k, _, p = line.partition(": ")
        classes.setdefault(k, set()).add(p)
    assert sorted(map(sorted, (c - {""} for c in classes.values()))) == sorted(map(sorted, vectors.values()))


def test_odd_rows(spark):
    rows = [(1, None, "<p>a"), (2, "no url", "<p>b"), (None, "http://x/", None), (3, "http://x/", ""), (4, "http://x/", "<p>same"), (4, "http://x/", "<p>same"), (5, "http://x/", "<p>" + "long " * 100000)]
    got = sorted(((r.page_id, r.url, r.text if len(r.text) < 10 else len(r.text), r.n_chars) for r in T.digest(T.extract(spark, spark.createDataFrame(rows, SCHEMA))).collect()), key=repr)
    assert got == sorted([(1, None, "a", 1), (2, "no url", "b", 1), (None, "http://x/", "", 0), (3, "http://x/", "", 0), (4, "http://x/", "same", 4), (4, "http://x/", "same", 4), (5, "http://x/", 499999, 499999)], key=repr)
    assert T.extract(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def plain_site(r, host, n, layout):
    """Pages without an article element and without names that tell anything, and their main text."""
    pool = [words(r, 8) for _ in range(3)]
    out = []
    for k in range(n):
        title, lead, paras = words(r, 4), words(r, 20), [words(r, r.randint(10, 40)) for _ in range(r.randint(2, 5))]
        body = "".join(f"<p>{p}</p>" for p in paras)
        menu = "".join(f"<li><a href='/{i}'>{words(r, 2)}</a></li>" for i in range(5))
        if layout == "lead":
            main, want = f"<h1>{title}</h1><div class='c5'>{lead}</div><div class='c6'>{body}</div>", [title, lead, *paras]
        elif layout == "table":
            main, want = f"<table><tr><td><h2>{title}</h2>{body}</td></tr></table>", [title, *paras]
        else:
            main, want = f"<div class='c7'><div class='c8'><h1>{title}</h1>{body}</div></div>", [title, *paras]
        html = f"<body><div class='c1'><ul>{menu}</ul></div><div class='c2'>{r.choice(pool)}</div><div class='c3'>{main}</div><div class='c4'><p>We use your data as all do.</p><p>Call 555 at any hour.</p></div></body>"
        out.append((f"http://{host}/{k}", html, " ".join(want)))
    return out


def test_the_template_decides(spark):
    """Without article elements and telling names the result is right, and wrong without the template."""
    r = random.Random(11)
    sites = [plain_site(r, f"{layout}.example.org", n, layout) for layout in ("lead", "table", "deep") for n in (30, 8)]
    sites.append(plain_site(r, "two.example.org", 2, "deep"))
    pages = [(i, *p) for i, p in enumerate(p for s in sites for p in s)]
    df = spark.createDataFrame([p[:3] for p in pages], SCHEMA)
    got = {x.page_id: x.text for x in T.extract(spark, df).collect()}
    right = [got[i] == want for i, url, _, want in pages if "two" not in url]
    assert all(right)
    # On two pages one text from the pool proves nothing; what both have is still cut.
    assert all("555" not in got[i] and want in got[i] for i, url, _, want in pages if "two" in url)
    off = [text(html) == want for _, _, html, want in pages]
    assert not any(off)


@pytest.mark.parametrize("n", [1, 2, 12])
def test_copies_of_a_page_are_no_template(spark, n):
    r = random.Random(12)
    _, html, want = site(r, "copies.example.org", 1, "article")[0]
    df = spark.createDataFrame([(i, f"http://copies.example.org/{i}", html) for i in range(n)], SCHEMA)
    assert [x.text for x in T.extract(spark, df).collect()] == [want] * n


def test_headline_beside_an_article_inside_main(spark):
    r = random.Random(13)
    rows, wants = [], {}
    for i in range(15):
        title, lead, body = words(r, 5), words(r, 9), words(r, 80)
        rows.append((i, f"http://m.example.org/{i}", f"<body><main><h1>{title}</h1><p>{lead}</p><article><p>{body}</p></article></main><div>{words(r, 12)}</div></body>"))
        wants[i] = f"{title} {lead} {body}"
    assert {x.page_id: x.text for x in T.extract(spark, spark.createDataFrame(rows, SCHEMA)).collect()} == wants
