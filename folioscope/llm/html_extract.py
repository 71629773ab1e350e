"""Main text of web pages by deducing the template of each host.

Pass 1 reads every page as tokens: elements by their path (tag and class or id of each
level), texts outside an article, and the places of text inside one.  For every host,
tokens that occur equally often in the same pages have one occurrence vector; tokens that
share it form an equivalence class.  The vectors are compared by a commutative fingerprint (a sum of hashes of page
and count), so no task gathers the pages of a host.  A class is valid if most pages of
its host hold it; valid classes nest by path into the template.  Texts of valid classes
are the template's own words; all other text stands in slots.  The main slot is the
smallest element around all slots that are not dropped by their role.  Only where text of
other slots stands beside an article, an ``article`` or ``main`` that the template has once
in each page decides, if it holds ``MAIN_SHARE`` of the slots' text.

Pages may name nothing: menus, adverts and footers whose words change from page to page,
beside a text in a plain element.  Then all of the page is the smallest element around the
slots, and the classes of elements decide alone: the *focus* is the element that every
page has once, below the page's own, and that holds ``MAIN_SHARE`` of the text.  It counts
on pages without an article, with headings that stand directly beside it.  Hosts of
one page have no classes of their own; they take the focus of all pages, on whatever
host, that use the same class names and ids.

Pass 2 walks each page with its host's template and extracts the slots that remain:
those in the main slot, outside menus, headers, footers, side bars, notices, adverts,
forms and reader comments.  A class or id names such a part only as a whole word, and only of a block
of its own, not of a phrase within one; what is named so is kept if all articles of the page
are inside such parts and it holds one.  Each page is parsed whole, in one task, with no limits.

Null and empty pages have empty text; pages without a host or of a host with one page
are templates of their own; an element left open ends where its parent does; equal
pages count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.llm.scratch import materialize
from folioscope.llm.url_filter import host_of

#: Share of a host's pages that hold a valid class; pages from which on texts count as the template's.
SUPPORT, MIN_PAGES = 0.5, 4
#: Share of a host's text in slots from which on an article among them is the main slot.
MAIN_SHARE = 0.5
#: Rows and bytes of the templates that are sent to every executor; more are joined by host and by layout.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 4 << 20

# Elements by their role in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
_DROPPED = frozenset("head nav header footer aside form menu dialog button select script style noscript template iframe svg object canvas audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split())
_CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dd dt", {"dl"}), "dd": ("dd dt", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
_ROLE_WORDS = re.compile(r"(?i)(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side-bar|widget\w*|footer\w*|header|masthead|banner\w*|cookie\w*|consent\w*|notice\w*|popup|modal|newsletter|subscribe|signup|comment\w*|disqus\w*|replies|share|sharing|social\w*|related\w*|recommend\w*)")
_ROLES = frozenset("navigation banner contentinfo complementary search form menu dialog alert".split())

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
#: A path is cut at slashes, so those of names are written otherwise.
_NAMES = str.maketrans({"/": "%2F", "%": "%25"})
_ATTR = re.compile(r"""(?i)(?:^|\s)(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def parse(page: str) -> tuple[dict[str, list[int]], list[tuple[int, str, bool, str, str]]]:
    """Elements of a page - path to [times, code points of text below] - and its pieces of text:
    (block, path, whether it is in a dropped element, path of its article or '', text)."""
    elements: dict[str, list[int]] = {}
    pieces: list[tuple[int, str, bool, str, str]] = []
    stack: list[tuple[str, str, bool, tuple[int, ...], str]] = [("", "", False, (), "")]  # tag, path, dropped, elements dropped by their names, article
    named: list[tuple[int, ...]] = []
    around: list[tuple[int, ...]] = []  # of each article
    block = at = n_named = 0

    def add(raw: str) -> None:
        _, path, dropped, names, article = stack[-1]
        pieces.append((block, path, dropped, article, _html.unescape(raw)))
        named.append(names)

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            if tag not in _INLINE:
                block += 1
            continue
        if tag in _CLOSES_P:
            _close(stack, ("p",), {"article", "section", "div", "td", "th", "li", "blockquote", "body", "aside", "main", "table", "button"})
        if tag in _CLOSES:
            closed, scope = _CLOSES[tag]
            _close(stack, tuple(closed.split()), scope)
        if tag == "br":
            add(" ")
        elif tag not in _INLINE:
            block += 1
        attrs = {a.lower(): x or y or z for a, x, y, z in _ATTR.findall(m[3] or m[6] or "")}
        _, path, dropped, names, article = stack[-1]
        name = ".".join([tag, *sorted(f"{attrs.get('class', '')} {attrs.get('id', '')}".split())])
        path = f"{path}/{name.translate(_NAMES)}"
        elements.setdefault(path, [0, 0])[0] += 1
        if tag in _VOID:
            continue
        words = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
        main = tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        dropped = dropped or tag in _DROPPED or "hidden" in attrs or attrs.get("role") in _ROLES
        if not main and tag != "body" and tag not in _INLINE and any(map(_ROLE_WORDS.fullmatch, words)):
            n_named += 1
            names = (*names, n_named)
        if main and not dropped:
            around.append(names)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            dropped = True
        stack.append((tag, path, dropped, names, article or (path if main else "")))
    kept = set().union(*around) if all(around) else set()
    pieces = [(b, path, dropped or not kept.issuperset(names), article, text) for (b, path, dropped, article, text), names in zip(pieces, named, strict=True)]
    for _, path, dropped, _, text in pieces:
        if not dropped and (n := len(text.strip())):
            while path:
                elements[path][1] += n
                path = path.rpartition("/")[0]
    return elements, pieces


def _close(stack: list, names: tuple[str, ...], scope: set[str]) -> None:
    """Close the innermost open element of ``names`` within the scope."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in names:
            del stack[k:]
            return
        if stack[k][0] in scope:
            return


def _join(pieces: list[tuple[int, str]]) -> str:
    blocks: dict[int, list[str]] = {}
    for block, text in pieces:
        blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def _page_level(path: str | None) -> bool:
    """Whether a main slot is the page itself, or not known."""
    return path is None or bool(re.fullmatch(r"(?:/html[^/]*)?(?:/body[^/]*)?", path))


def extract(page: str, main: str | None, fixed: set[str], focus: str | None = None) -> str:
    """Main text of a page under a template: path of the main slot or None, texts that are the template's own, and path of the focus or None."""
    _, pieces = parse(page)
    left = [p for p in pieces if not p[2]]
    if focus is not None and _page_level(main) and not any(p[3] for p in left):
        above = re.escape(focus.rpartition("/")[0])
        head = re.compile(rf"{above}/h[1-6](?:\.[^/]*)?(?:/.*)?")
        under = [p[1] == focus or p[1].startswith(focus + "/") for p in left]
        if any(p[4].strip() and f"{p[1]} {p[4].strip()}" not in fixed for p, is_under in zip(left, under, strict=True) if is_under):  # it is a slot
            own = [p for p, is_under in zip(left, under, strict=True) if is_under or head.fullmatch(p[1])]
            return _join([(p[0], p[4]) for p in _varying(own, fixed)])
    if main is not None:
        inside = [p for p in left if p[1] == main or p[1].startswith(main + "/")]
        if any(p[4].strip() for p in inside):
            return _join([(p[0], p[4]) for p in _varying(inside, fixed)])
    own = [p for p in left if p[3]]
    if any(p[4].strip() for p in own):
        return _join([(p[0], p[4]) for p in own])
    return _join([(p[0], p[4]) for p in _varying(left, fixed)])


def _varying(pieces: list[tuple], fixed: set[str]) -> list[tuple]:
    """Pieces that are not the template's own; all, if no others have text."""
    found = [p for p in pieces if not p[4].strip() or f"{p[1]} {p[4].strip()}" not in fixed]
    return found if any(p[4].strip() for p in found) else pieces


def layout_of(html: Column) -> Column:
    """What pages of one layout have in common, on whatever host: the class names and ids they use; a slash, which no host has, comes first."""
    names = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<[a-z][^<>]*?\s(?:class|id)\s*=\s*["']?([^"'<>]*)"""), F.lit(1))
    return F.concat(F.lit("/"), F.md5(F.array_join(F.array_sort(F.array_distinct(names)), "\n")))


def template(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, main, fixed): path of the host's main slot or null, and its fixed texts, for hosts of two pages or more."""
    return _templates(pages, html_col, url_col).filter(~F.col("host").startswith("/")).select("host", "main", "fixed")


def _templates(pages: DataFrame, html_col: str, url_col: str) -> DataFrame:
    """(host, main, fixed, focus) of hosts, and of layouts (with a focus only), of two pages or more."""
    rows = pages.select(host_of(pages[url_col]).alias("host"), F.xxhash64(pages[url_col]).alias("page"), pages[html_col].alias("html"), layout_of(pages[html_col]).alias("layout"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            hosts, keys, layouts = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for host, key, page, layout in zip(hosts, keys, batch.column(2), layouts, strict=True):
                elements, pieces = parse(page.as_py() or "")
                found = [(path, n, size) for path, (n, size) in elements.items()]
                plain = list(found)
                texts: dict[str, int] = {}
                total = 0
                for _, path, dropped, article, text in pieces:
                    if not dropped and (text := text.strip()):
                        total += len(text)
                        token = f"{path} " if article else f"{path} {text}"
                        texts[token] = texts.get(token, 0) + 1
                found += [(t, n, 0) for t, n in texts.items()]
                for group, tokens_ in ((host, found), (layout, plain)):
                    for token, n, size in [*tokens_, ("", 1, total)]:  # the last is the page itself
                        for column, value in zip(out, (group, key, token, n, size), strict=True):
                            column.append(value)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["host", "page", "token", "n", "size"])

    seen = rows.mapInArrow(tokens, "host string, page long, token string, n long, size long")
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector")
    counted = seen.groupBy("host", "token").agg(vector, F.count(F.lit(1)).alias("pages"), F.sum("n").alias("times"), F.sum("size").alias("size"))
    counted = materialize(counted, "html-tokens")
    whole = rows.select(F.explode(F.array("host", "layout")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    classes = counted.groupBy("host", "vector").agg(F.max("pages").alias("held"))
    valid = classes.join(whole, "host").filter((F.col("held") >= 2) & (F.col("held") >= SUPPORT * F.col("of")))
    # of hosts with few pages, texts on all of them are not dropped but may be outside the main slot
    tokens_ = counted.join(whole.filter("of >= 2"), "host").join(valid.select("host", "vector", F.lit(True).alias("valid")), ["host", "vector"], "left")
    element = ~F.col("token").contains(" ")
    inside = F.col("token").endswith(" ")  # a place of text in an article
    once = element & F.col("valid") & (F.col("times") == F.col("pages"))
    last = F.element_at(F.split("token", "/"), -1)
    depth = F.size(F.split("token", "/"))
    article = last.rlike(r"^(article|main)(\.|$)")
    best = F.when(once & article, F.struct("size", -depth, F.col("token")))
    # the shallowest of the elements of most text, of those that hold enough of it
    below = once & ~last.rlike(r"^(html|body)(\.|$)") & (depth > 1)
    focus = F.max(F.when(below, F.struct("size", -depth, F.col("token")))).alias("centre")
    own = F.when(F.col("of") >= MIN_PAGES, F.coalesce("valid", F.lit(False))).otherwise(F.col("pages") == F.col("of"))
    fixed = F.when(~element & ~inside & F.col("valid") & (F.col("of") >= MIN_PAGES), F.col("token"))
    varies = F.when(~element & (inside | ~own), F.concat(F.substring_index("token", " ", 1), F.lit("/")))
    whole_text = F.max(F.when(F.col("token") == "", F.col("size"))).alias("text")
    found = tokens_.groupBy("host").agg(F.max(best).alias("best"), focus, whole_text, F.min(varies).alias("low"), F.max(varies).alias("high"), F.array_sort(F.collect_set(fixed)).alias("fixed"))
    # the common beginning of all paths is that of the least and the greatest
    steps = F.expr("filter(sequence(1, size(split(low, '/')) - 1), k -> substring_index(low, '/', k) = substring_index(high, '/', k))")
    common = F.when(F.col("low").isNotNull(), F.expr("substring_index(low, '/', n)"))
    found = found.withColumn("n", F.array_max(steps)).withColumn("common", F.when(common != "", common))
    chosen = F.col("best.token")
    beside = ~F.startswith(F.concat("common", F.lit("/")), F.concat(chosen, F.lit("/")))
    main = F.when((F.col("best.size") >= MAIN_SHARE * F.col("text")) & F.coalesce(beside, F.lit(True)), chosen).otherwise(F.col("common"))
    focus = F.when(F.col("centre.size") >= MAIN_SHARE * F.col("text"), F.col("centre.token")).alias("focus")
    return found.select("host", main.alias("main"), "fixed", focus)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    every = materialize(_templates(pages, html_col, url_col), "html-templates")
    made = every.filter(~F.col("host").startswith("/")).select(F.col("host").alias("host__"), "main", "fixed", "focus")
    plans = every.filter(F.col("host").startswith("/") & F.col("focus").isNotNull()).select(F.col("host").alias("layout__"), F.col("focus").alias("shared__"))
    size = every.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("focus") + F.octet_length(F.concat_ws(" ", "fixed"))), F.lit(0))).first()
    if size[0] <= BROADCAST_HOSTS and size[1] <= BROADCAST_BYTES:
        made, plans = F.broadcast(made), F.broadcast(plans)
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host_of(pages[url_col]).alias("host"), layout_of(pages[html_col]).alias("layout"))
    rows = rows.join(made, rows["host"] == F.col("host__"), "left").join(plans, F.col("layout") == F.col("layout__"), "left")
    rows = rows.select("page_id", "url", "html", "main", "fixed", F.coalesce("focus", "shared__").alias("focus"))
    schema = StructType([rows.schema["page_id"], rows.schema["url"]] + StructType.fromDDL("text string, n_chars long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mains, fixed, centres = (batch.column(k).to_pylist() for k in (3, 4, 5))
            texts = [extract(h.as_py() or "", m, set(f or ()), c) for h, m, f, c in zip(batch.column(2), mains, fixed, centres, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)
