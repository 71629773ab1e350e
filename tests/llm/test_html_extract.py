"""Main text of hosts whose pages have no article, and of wrappers named like side bars."""

from folioscope.llm import html_extract


def texts(spark, pages):
    rows = [(k, f"http://{host}/{k}", html) for k, (host, html) in enumerate(pages)]
    found = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def page(k, wrap="wrap"):
    return f"<body><div class=top>The Site</div><div class='{wrap}'><h1>Title {k}</h1><div class=lead>Lead {k}</div><div class=body>{f'Long text {k}. ' * 20}</div></div><div class=imprint>All rights</div></body>"


def test_title_and_lead_stay(spark):
    wanted = [f"Title {k}\nLead {k}\n" + " ".join([f"Long text {k}."] * 20) for k in range(9)]
    assert texts(spark, [("a.example", page(k)) for k in range(6)] + [("b.example", page(k)) for k in range(6, 9)]) == wanted


def test_copies_keep_their_text(spark):
    got = texts(spark, [("a.example", page(1))] * 5)
    assert all("Title 1" in t and "Lead 1" in t and "Long text 1." in t for t in got)


def test_names_are_whole_and_keep_articles(spark):
    assert [t.split("\n")[:2] for t in texts(spark, [("a.example", page(k, "layout has-sidebar")) for k in range(5)])] == [[f"Title {k}", f"Lead {k}"] for k in range(5)]
    pages = [("a.example", f"<body><div class=sidebar><article><p>Text {k}</p></article></div></body>") for k in range(4)]
    assert texts(spark, pages) == [f"Text {k}" for k in range(4)]
    outside = "<body><article><p>Text</p></article><div class=comments><article>Reply</article></div></body>"
    assert texts(spark, [("a.example", outside)]) == ["Text"]


def model(pages):
    """{host: (main, fixed)} by vectors of counts, one entry a page."""
    import os.path

    hosts = {}
    for host, html in pages:
        elements, pieces = html_extract.parse(html)
        counts = {p: n for p, (n, _) in elements.items()}
        chars = {p: size for p, (_, size) in elements.items()}
        for _, path, dropped, article, text in pieces:
            if not dropped and text.strip():
                token = f"{path} " if article else f"{path} {text.strip()}"
                counts[token] = counts.get(token, 0) + 1
        hosts.setdefault(host, []).append((counts, chars, sum(len(t.strip()) for _, _, d, _, t in pieces if not d)))
    out = {}
    for host, found in hosts.items():
        if len(found) < 2:
            continue
        vector = lambda t, found=found: tuple(c.get(t, 0) for c, _, _ in found)
        of = lambda t: sum(n > 0 for n in vector(t))
        valid = lambda t, found=found: of(t) >= max(2, html_extract.SUPPORT * len(found))
        tokens = {t for c, _, _ in found for t in c}
        texts = [t for t in tokens if " " in t]
        own = lambda t, found=found: valid(t) if len(found) >= html_extract.MIN_PAGES else of(t) == len(found)
        slots = [t.split(" ")[0] for t in texts if t.endswith(" ") or not own(t)]
        common = os.path.commonpath(slots) if slots else None
        fixed = sorted(t for t in texts if not t.endswith(" ") and valid(t) and len(found) >= html_extract.MIN_PAGES)
        articles = [t for t in tokens if " " not in t and t.split("/")[-1].split(".")[0] in ("article", "main") and valid(t) and sum(vector(t)) == of(t)]
        best = max(articles, key=lambda t: (sum(s.get(t, 0) for _, s, _ in found), -t.count("/"), t), default=None)
        big = best and sum(s.get(best, 0) for _, s, _ in found) >= html_extract.MAIN_SHARE * sum(n for _, _, n in found)
        main = best if big and not (common and (common + "/").startswith(best + "/")) else common
        out[host] = (main if main != "/" else None, fixed)
    return out


def test_templates_against_a_loop(spark):
    import random

    rng = random.Random(3)
    pages = []
    for host in range(25):
        site = [f"<div class=c{rng.randrange(6)}>{rng.choice(['Site', 'Imprint', '{}', ''])}</div>" for _ in range(rng.randint(0, 4))]
        wrap = rng.choice(["<article>{}</article>", "<div class=x>{}</div>", "<main>{}</main>", "<div><article>{}</article><div class=y>side {}</div></div>", "{}"])
        for k in range(rng.choice([1, 2, 3, 5, 9])):
            body = "".join(f"<p>{rng.choice(['Same', f'Text {rng.random()}'])}</p>" for _ in range(rng.randint(0, 4)))
            inner = "".join(x.replace("{}", f"Part {k}") for x in site if rng.random() < 0.9)
            pages.append((f"h{host}", f"<body><nav>Menu</nav>{inner}{wrap.replace('{}', body)}</body>"))
    df = spark.createDataFrame([(k, f"http://{h}/{k}", html) for k, (h, html) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.host: (r.main, r.fixed) for r in html_extract.template(df.repartition(5)).collect()}
    assert got == model(pages)


def test_neutral_names_and_no_article(spark):
    """Without the template the site's own words would stay; menus and side texts that all pages share go by their class alone."""
    make = lambda k: f"<body><div class=q1>Home About</div><div class=q2><h2>Head {k}</h2><p>Body {k}</p></div><div class=q3>All rights</div></body>"
    assert texts(spark, [("a.example", make(k)) for k in range(6)]) == [f"Head {k}\nBody {k}" for k in range(6)]
    assert html_extract.extract(make(1), None, set()) == "Home About\nHead 1\nBody 1\nAll rights"


def test_slots_beside_an_article(spark):
    make = lambda k: f"<body><div class=q1>Teaser {k}</div><article><p>{f'Long text {k}. ' * 9}<span class=share>kept</span></p><section class=related-work>Prior {k}</section></article></body>"
    assert texts(spark, [("a.example", make(k)) for k in range(5)]) == [" ".join([f"Long text {k}."] * 9) + f" kept\nPrior {k}" for k in range(5)]


def test_names_with_slashes_and_odd_attributes(spark):
    page_ = lambda k: f"<body><div class='w-1/2 a%2Fb'>Site</div><div id='/x//y' class=\"md:w-2/3\"><p class=/>Text {k}</p></div></body>"
    assert texts(spark, [("a.example", page_(k)) for k in range(5)]) == [f"Text {k}" for k in range(5)]


def test_parse_takes_any_page():
    import random

    rng = random.Random(8)
    bits = list("<>/\"'= %.&;-!\n\x00\xa0 é") + ["<div", "<p ", "</div>", "class=", "id='", "<article", "</", "<script>", "<!--", "-->", "text", "w-1/2", "<li>", "<br/>", "&amp;", "<td", "<a href=/x/y"]
    for _ in range(4000):
        elements, pieces = html_extract.parse("".join(rng.choices(bits, k=rng.randint(0, 40))))
        assert all(path in elements or not path for _, path, _, _, _ in pieces)


def test_pages_that_name_nothing(spark):
    """Menus, adverts and footers whose words change, in plain elements with plain classes, on hosts of one page and of many."""
    import random

    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    pages, wanted = [], []
    for host, n in [("one%d" % k, 1) for k in range(12)] + [("two", 2), ("five", 5), ("ten", 10)]:
        for _ in range(n):
            menu = "".join(f"<li><a href='/x'>{words(1)}</a></li>" for _ in range(6))
            body = [words(rng.randint(8, 60)) for _ in range(rng.randint(2, 9))]
            pages.append((f"{host}.example", f"<html><body><div class=q1><ul>{menu}</ul></div><div class=q2>{words(7)}</div><div class=q3><h1>{body[0]}</h1>{''.join(f'<p>{b}</p>' for b in body[1:])}</div><div class=q4>{words(9)}</div></body></html>"))
            wanted.append("\n".join(body))
    got = texts(spark, pages)
    assert sum(g == w for g, w in zip(got, wanted, strict=True)) >= 0.9 * len(pages)
    assert sum(html_extract.extract(h, None, set()) == w for (_, h), w in zip(pages, wanted, strict=True)) == 0


def test_headings_beside_the_focus(spark):
    make = lambda k: f"<body><div class=m>{f'Menu {k} '}</div><h1>Title {k}</h1><div class=c>{f'Long text {k}. ' * 9}</div><div class=f>Foot {k}</div></body>"
    assert texts(spark, [("a.example", make(k)) for k in range(4)]) == [f"Title {k}\n" + " ".join([f"Long text {k}."] * 9) for k in range(4)]
