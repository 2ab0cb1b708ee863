import random

from ledgerloom.llm import html_extract as h


def page(n, body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T{n}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a{n}">Menu {n}</a></li></ul></nav><!-- x --><div class="ad">Buy {n}.</div><div class="top">Welcome to the site.</div>{body}{extra}<footer>&copy; {n}</footer></body></html>'


def naive(a, b):
    """Simple tree matching as defined: size only."""
    if a.key != b.key:
        return 0
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + naive(a.children[i], b.children[j]))
    return 1 + best[m][n]


def test_tree_matching_counts_aligned_nodes():
    a, _ = h.parse("<div><p>x</p><ul><li>1</li><li>2</li></ul><b>y</b></div>")
    b, _ = h.parse("<div><ul><li>1</li></ul><i>k</i><b>y</b></div>")
    m = h.Matching(a, b)
    assert m.size == len(m.partners()) == 5  # root, div, ul, li, b


def test_tree_matching_equals_the_definition():
    r = random.Random(8)

    def soup(depth):
        return "".join(f"<{t}>{soup(depth - 1) if depth else 'x'}</{t}>" for t in (r.choice(["b", "i", "u"]) for _ in range(r.randrange(0, 7 if depth < 3 else 20))))

    for _ in range(150):
        a, b = (h.parse("<div>" + soup(3) + "</div>")[0] for _ in range(2))
        m = h.Matching(a, b)
        found = m.partners()
        assert m.size == naive(a, b) == len(found)
        nodes = {id(n): n for n in h.preorder(a)}
        for i, to in found.items():
            n = nodes[i]
            assert n.key == to.key and (n.parent is None or found[id(n.parent)] is to.parent)


def test_main_text_by_hosts(spark):
    prose = [f"Story {n} goes on\n for   a while &amp; ends." for n in range(6)]
    soup = [f"<article><h1>Head {n}</h1><p><b>{p}<br><p>Second {n} &#233;.</p><div class='comments'><p>Nice {n}!</p></div></article>" for n, p in enumerate(prose)]
    rows = [(n, f"https://a.example.com/{n}", page(n, s)) for n, s in enumerate(soup)]
    rows += [(10 + n, f"http://b.example.org:80/{n}", page(n, f"<div class=body><p>{p}</p></div>")) for n, p in enumerate(prose)]
    rows += [(20, "https://c.example.com/", page(3, soup[3])), (21, None, None), (22, "x", ""), (23, "https://d.example.com/", "<p>cut <b>off <a href='"), rows[0]]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in h.html_digest(df).collect()}
    clean = [p.replace("\n for   a", " for a").replace("&amp;", "&") for p in prose]
    for n in range(6):
        assert got[n].text == f"Head {n}\n\n{clean[n]}\n\nSecond {n} é."
        assert got[10 + n].text == clean[n]  # the constant welcome is template, the varying slots are content
    assert got[20].text == got[3].text and got[20].n_chars == len(got[3].text)
    assert got[21].text == got[22].text == ""
    assert got[23].text == "cut off"
    assert h.html_digest(df).count() == len(rows)
    assert h.html_digest(df.limit(0)).collect() == []


def test_the_wrapper_decides_where_names_say_nothing(spark):
    """Anonymous markup whose menus, adverts and footers differ from page to page: only the aligned slots tell them apart."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    rows, want = [], {}
    for k in range(5):
        for n in range(6):
            prose = [line(30) for _ in range(r.randrange(2, 6))]
            title = line(4)
            menu = "".join(f"<div><a href=/{w}>{w}</a></div>" for w in (word() for _ in range(5)))
            url = f"https://h{k}.example.com/{n}"
            rows.append((url, f"<html><body><div class=x{k}>{menu}</div><div class=y{k}>{line(6)}</div><div class=z{k}><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in prose)}<div class=q>Read it all on h{k}</div></div><div class=w{k}>{line(5)}</div></body></html>"))
            want[url] = "\n\n".join([title, *prose])
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "page_id long, url string, html string")
    for bytes_ in (32_000_000, 0):  # by broadcast, and by the salted join
        got = {x.url: x.text for x in h.extract(df, broadcast_bytes=bytes_).collect()}
        assert got == want
    assert all(h.unwrapped_text(h.parse(html)[1]) != want[url] for url, html in rows)


def test_short_articles_and_copies_keep_their_text(spark):
    ad = lambda n: f"<div>Here stands advert number {n}, which is longer than all.</div>"
    rows = [(f"https://short.example.com/{n}", f"<body>{ad(n)}<article><h1>H {n}</h1><p>T {n}</p></article></body>", f"H {n}\n\nT {n}") for n in range(3)]
    same = "<article><h1>Same</h1><p>The very same article in every page of this host.</p><p>It goes on.</p></article>"
    text = "Same\n\nThe very same article in every page of this host.\n\nIt goes on."
    rows += [(f"https://copies.example.com/{n}", f"<body>{ad(n)}{same}</body>", text) for n in range(4)]
    near = [f"<article><h1>Same</h1><p>A near copy of an article, changed in place {n} only.</p><p>It goes on.</p></article>" for n in range(4)]
    rows += [(f"https://near.example.com/{n}", f"<body>{ad(n)}{x}</body>", f"Same\n\nA near copy of an article, changed in place {n} only.\n\nIt goes on.") for n, x in enumerate(near)]
    rows += [("https://near.example.com/odd", "<body><section>Another layout.</section></body>", "Another layout.")]
    df = spark.createDataFrame([(i, u, x) for i, (u, x, _) in enumerate(rows)], "page_id long, url string, html string")
    assert {x.url: x.text for x in h.extract(df).collect()} == {u: t for u, _, t in rows}


def test_deep_and_wide_pages_are_aligned_as_others():
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    wide = "".join(f"<div class={'abc'[i % 3]}x>w{i}</div><i>{i}</i>" for i in range(1500))
    trees = [h.parse(x)[0] for x in (deep, wide, wide + "<b>1</b>")]
    assert h.Matching(trees[0], trees[0]).size == 5001
    assert h.Matching(trees[1], trees[2]).size == 3001
    skeleton = h.induce([deep, wide, wide.replace("w", "v")])
    w = h.Wrapper(h.decide(skeleton, []))
    assert h.main_text(deep, w) == "text"
    assert h.main_text(wide, w).count("w") == 1500


def test_constants_are_counted_over_all_pages_of_a_host(spark):
    body = lambda n, top: f"<html><body><div class=top>{top}</div><div class=body><p>Story {n} goes on for a while.</p></div></body></html>"
    rows = [(f"https://h{k}.example.com/{n}", body(f"{k} {n}", "Welcome to the site.")) for k in range(24) for n in range(2)]  # two pages each
    rows += [(f"https://big.example.com/{n}", body(n, "Shared by a few." if n % 4 == 0 else f"Headline {n}.")) for n in range(40)]
    rows += [(f"https://rare.example.com/{n}", f"<html><body><p>Page {n} is here.</p>{'<section class=extra>Only on some.</section>' if n % 10 == 0 else ''}</body></html>") for n in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.url: r.text for r in h.html_digest(df).collect()}
    for k in range(24):
        for n in range(2):
            assert got[f"https://h{k}.example.com/{n}"] == f"Story {k} {n} goes on for a while."
    for n in range(40):
        top = "Shared by a few." if n % 4 == 0 else f"Headline {n}."
        assert got[f"https://big.example.com/{n}"] == f"{top}\n\nStory {n} goes on for a while."
        assert got[f"https://rare.example.com/{n}"] == f"Page {n} is here."


def test_class_names_do_not_empty_pages(spark):
    """Names on the page's own containers, and names of content that hold the words of others, hide nothing."""
    story = lambda n: "".join(f"<p>Paragraph {k} of story {n} says what {'happened ' * 6}there.</p>" for k in range(5))
    shapes = {
        "body": "<body class='has-sidebar'><article>%s</article></body>",
        "widget": "<body class='page no-widget'><article>%s</article></body>",
        "bodyname": "<body class='comments'><div id='sidebar'><article>%s</article></div></body>",
        "main": "<body><main class='with-sidebar search'>%s</main></body>",
        "article": "<body><article class='post comments-open comments'>%s</article></body>",
        "methods": "<body><article><section class='search-methods'>%s</section></article></body>",
        "whole": "<body><div class='search'><div>%s</div></div></body>",
        "form": "<body><form id='aspnet'><div class='page'><article>%s</article></div></form></body>",
    }
    rows, want = [], {}
    for name, shape in shapes.items():
        for n in range(6):
            url = f"https://{name}.example.com/{n}"
            extra = "<div class='cookie-banner'>We use them.</div><nav><a href=/>Home</a></nav><div class='comment-list'><article class='comment'>So it is, says %d.</article></div>" % n
            rows.append((url, "<html>" + (shape % story(n)).replace("</body>", extra + "</body>") + "</html>"))
            want[url] = "\n\n".join(f"Paragraph {k} of story {n} says what {'happened ' * 6}there." for k in range(5))
        rows.append((f"https://alone-{name}.example.com/", rows[-1][1]))
        want[rows[-1][0]] = want[url]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert {r.url: r.text for r in h.extract(df).collect()} == want


def test_notices_and_comments_inside_an_article_go(spark):
    long = lambda n: f"Sentence one of {n} is here. " * 8
    rows = [(f"https://in.example.com/{n}", f"<article><p>{long(n).strip()}</p><div class='notice'>Sale until day {n}.</div><div class='comments'><article class='comment'>{long(n + 50)}</article></div></article>") for n in range(5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    for part in (df, df.limit(1)):
        assert all(r.text == long(r.page_id).strip() for r in h.extract(part).collect())


def test_pages_of_megabytes_are_read_whole(spark):
    rows = [(n, f"https://big.example.com/{n}", "<body><div class='menu'><a href=/>x</a></div><article>" + "".join(f"<p>Line {i} of page {n}.</p>" for i in range(60_000)) + "</article></body>") for n in range(3)]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text.count("\n\n") for r in got} == dict.fromkeys(range(3), 59_999)
