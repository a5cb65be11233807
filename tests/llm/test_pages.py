import random

from cellweave.llm import wrapper

SCHEMA = "page_id long, url string, html string, host string, text string"


def rows_of(n=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        body = "".join(f"<p>Line {i} {rng.randrange(10**6)} &amp; <b>bold</b>\n more<br>" for _ in range(rng.randint(1, 4)))
        html = f'<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="ad">Buy</div><article><h1>Title {i}</h1>{body}</article><div class="comments"><p>nice {i}</p></div><footer>&copy; x</footer></body></html>'
        rows.append((i, "http://a.example.com/p", html))
    return rows


def run(spark, rows):
    return {r.page_id: r for r in wrapper.extract(spark.createDataFrame([(*r, "h", "t") for r in rows], SCHEMA)).collect()}


def test_article_blocks(spark):
    rows = rows_of()
    got = run(spark, rows)
    for i, _, html in rows:
        lines = got[i].text.split("\n")
        assert lines[0] == f"Title {i}"
        assert all(x.startswith(f"Line {i} ") and x.endswith("& bold more") for x in lines[1:])
        assert len(lines) - 1 == html.count("<p>Line")


def test_template_is_induced_without_a_main_element(spark):
    rows = []
    for i in range(30):
        rows.append((i, "https://b.example.org/x", f"<body><div class='top'><p>Same on all</p></div><div class='x1'><p>Own text {i}</p><p>and more {i * 7}</p></div><div class='low'><p>{'Even' if i % 2 else 'Odd'}</p></div></body>"))
    got = run(spark, rows)
    assert all(got[i].text == f"Own text {i}\nand more {i * 7}" for i in range(30))


def test_copies_do_not_become_template(spark):
    html = "<body><nav>m</nav><article><h1>T</h1><p>Same</p></article></body>"
    got = run(spark, [(i, "http://c.example.com/", html) for i in range(25)])
    assert all(r.text == "T\nSame" for r in got.values())


def test_edge_cases(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    many = "<article>" + "".join(f"<p>{k}</p><h2>h{k}</h2>" for k in range(400)) + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "plain &lt; text &amp"), (4, "http://d.example.com/", deep), (5, "http://d.example.com/", many), (6, "http://e.example.com/", "<article><p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>"), (7, "http://e.example.com/", '<p hidden>no</p><p title="a>b">yes</p><script>no')]
    got = run(spark, rows)
    assert got[1].text == got[2].text == "" and got[3].text == "plain < text &" and got[4].text == "deep"
    assert got[5].text.split("\n") == [x for k in range(400) for x in (str(k), f"h{k}")]
    assert got[6].text == "a\nb\nc\nd\ne f" and got[7].text == "yes"
    assert wrapper.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_matching_is_the_largest():
    page = wrapper.Page("<div class=a><p>x</p></div><div class=b></div><ul><li>y</ul>").skeleton()
    other = wrapper.Page("<div class=b></div><ul><li>z</ul>").skeleton()
    match = wrapper.tree_match(page, other)
    labels = [line.split(" ", 1)[1] for line in page.split("\n")]
    assert sorted(labels[k] for k in match) == ["#", "div.b", "li", "ul"]


def test_deep_boilerplate_goes(spark):
    deep = "<div>" * 60 + "<nav>menu</nav><article><p>own</p><div class=ad>buy</div><p>more</p></article><div>below</div>" + "</div>" * 60
    other = "<section>" * 60 + "<p>text</p><div class='comments'><div><p>nice</p></div></div><p>end</p>"
    got = run(spark, [(1, "http://f.example.com/", deep), (2, "http://g.example.com/", other)])
    assert got[1].text == "own\nmore" and got[2].text == "text\nend"


def test_copies_count_once(spark):
    """Copies of an article whose list no other page has, and a host whose articles all appear three times."""
    list_of = "<body><article><h1>A</h1><p>text</p><ul><li>one</li><li>two</li></ul></article></body>"
    rows = [(i, "http://h.example.com/", list_of) for i in range(20)]
    rows += [(100 + i, "http://h.example.com/", f"<body><article><h1>T{i}</h1><p>p{i}</p></article></body>") for i in range(15)]
    rows += [(200 + i, "http://i.example.com/", f"<body><div class='x'><p>Body {i // 3}</p></div><div class='y'><p>Same</p></div></body>") for i in range(36)]
    got = run(spark, rows)
    assert all(got[i].text == "A\ntext\none\ntwo" for i in range(20))
    assert all(got[200 + i].text == f"Body {i // 3}" for i in range(36))


def test_minority_layouts_have_a_template(spark):
    rows = [(i, "http://j.example.com/", f"<body><div class='a'><p>first {i}</p></div><div class='z'>Kept on all</div></body>") for i in range(40)]
    rows += [(100 + i, "http://j.example.com/", f"<body><section class='b'><h2>Hot today</h2><blockquote>second {i}</blockquote></section></body>") for i in range(20)]
    got = run(spark, rows)
    assert all(got[i].text == f"first {i}" for i in range(40))
    assert all(got[100 + i].text == f"second {i}" for i in range(20))


def test_names_declare_a_role_as_a_whole(spark):
    pages = {
        "<article><header><h1>Title</h1></header><p>Body</p></article>": "Title\nBody",
        '<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>': "Title\nBody",
        '<header><p>Site</p></header><article><p>Body</p><div class="social-history">On social history</div><div class="social share">Share</div></article>': "Body\nOn social history",
        '<div class="post-teaser">Teaser</div><div class="text">Body</div>': "Teaser\nBody",
        '<div class="page-header">Site</div><div class="article-body"><p>Body</p><footer>Tags</footer></div><div id="post-comments">Nice</div>': "Body",
    }
    rows = [(i, f"http://k{i}.example.com/", f"<body>{html}</body>") for i, html in enumerate(pages)]
    got = run(spark, rows)
    assert [got[i].text for i in range(len(rows))] == list(pages.values())


def brute_match(a, b):
    """The weight of the largest matching that keeps order and parents, over all choices of children."""
    if a[0] != b[0]:
        return 0

    def best(p, q):
        if not p or not q:
            return 0
        return max(best(p[1:], q), best(p, q[1:]), brute_match(p[0], q[0]) + best(p[1:], q[1:]))

    return 1 + best(a[1], b[1])


def test_tree_matching_equals_brute_force():
    rng = random.Random(5)

    def tree(depth):
        return (rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])

    def lines(t, parent, out):
        k = len(out)
        out.append(f"{parent} {t[0]}")
        for x in t[1]:
            lines(x, k, out)
        return out

    for _ in range(60):
        x, y = ("#", [tree(2), tree(2)]), ("#", [tree(2), tree(1)])
        found = wrapper.tree_match("\n".join(lines(x, -1, [])), "\n".join(lines(y, -1, [])))
        assert len(found) == brute_match(x, y) and len(set(found.values())) == len(found)


def text_of(html):
    return wrapper.page_text(wrapper.Page(html), {})


def test_forms_and_sidebars_that_hold_the_page():
    assert text_of('<body><form id="aspnetForm"><div><p>Long article text</p></div></form><div>low</div></body>') == "Long article text\nlow"
    assert text_of('<body><form><article><p>Short</p></article><p>other words that are longer</p></form><p>much longer text outside of the form is here</p></body>') == "Short"
    assert text_of('<body><div class="sidebar-right"><p>Body of the page</p><p>and more</p></div></body>') == "Body of the page\nand more"
    assert text_of('<body><p>Body of the page, which is long</p><div class="sidebar">Tags</div><form>Search</form></body>') == "Body of the page, which is long"


def test_names_of_parts_of_a_text_inside_a_main_element():
    assert text_of('<article><p>a</p><section id="discussion"><p>b</p></section><div class="promotion">c</div><section class="search">d</section><div class="ads">e</div><div class="comments">f</div></article>') == "a\nb\nc\nd"
    assert text_of('<div class="text"><p>a</p></div><section id="discussion">b</section>') == "a"


def test_a_teaser_outside_main_is_no_article():
    assert text_of('<main><p>Body</p></main><article class="card">Teaser</article>') == "Body"
    assert text_of('<main></main><article class="card">Only</article>') == "Only"


def test_broken_markup_is_read_in_linear_time():
    import time

    cases = ['<p title="' * 40_000, "<a " * 70_000, '<p a=">' * 40_001 + "end", "<" * 200_000, '<div a="' + "x" * 300_000, "<p " + "a" * 300_000 + ">t", "<div>" * 40_000 + "</p>" * 40_000, "<div>" * 20_000 + "<li></li>" * 20_000, "<p title='\"" * 30_000 + ">x"]
    for html in cases:
        t = time.perf_counter()
        wrapper.Page(html)
        assert time.perf_counter() - t < 5, html[:20]
    assert text_of('<p title="never closed>one</p><p>two</p>') == "one\ntwo"
    assert text_of("a < b <p>c</p") == "a < b\nc</p"


def test_wide_trees_match_in_time():
    import time

    wide = "\n".join(["-1 #", *(f"0 div.c{k}" for k in range(4000))])
    other = "\n".join(["-1 #", *(f"0 div.c{k}" for k in range(0, 4000, 2))])
    t = time.perf_counter()
    found = wrapper.tree_match(wide, other)
    assert len(found) == 2001 and time.perf_counter() - t < 3


def plain_extract(rows):
    """Induction by plain counting, for hosts of one layout without main elements: a slot whose text is one of
    few over the different rests of its pages is template."""
    pages = [(u, wrapper.Page(h)) for _, u, h in rows]
    sums = [p.checksums() for _, p in pages]
    out = []
    for i, (url, page) in enumerate(pages):
        kinds = {}
        for k in range(len(page.labels)):
            seen = [(s[k], tuple(x for j, x in enumerate(s) if j != k and x and not p.away[j])) for (u, p), s in zip(pages, sums, strict=True) if u == url and s[k]]
            texts, n = len({t for t, _ in seen}), len({r for _, r in seen})
            if n >= 3 and texts * 3 <= n:
                kinds[k] = "template"
            if texts == 1 and n >= 10:
                kinds[k] = "fixed"
        out.append(wrapper.page_text(page, kinds))
    return out


def test_extraction_equals_plain_counting(spark):
    rng = random.Random(9)
    rows = []
    for host in range(3):
        for i in range(30):
            low = rng.choice(["Low A", "Low B"])
            rows.append((len(rows), f"http://p{host}.example.com/", f"<body><nav>n</nav><div class='t'><p>Top {host}</p></div><div class='m'><h2>H {host} {i}</h2><p>text {rng.randrange(10**6)}</p></div><div class='l'>{low}</div><footer>f</footer></body>"))
    got = run(spark, rows)
    assert [got[i].text for i in range(len(rows))] == plain_extract(rows)
