"""Main text of web pages by template deduction from equivalence classes.

Tokens of a page are its tags and its whole text nodes, told apart by the path of open elements. Over the
different pages of a host, tokens with the same occurrence vector (the same count on every page) form a class.
A class is valid if it occurs on at least LEAST_PAGES pages and on most pages of the host, has several tokens,
one of them a tag, and if those of its elements that occur once a page stand in one order and each within the
same enclosing element on every page. The valid classes, nested into each other by these enclosing elements, are
the host's template; its text tokens are fixed text, and what stands between its tags are its slots.

An occurrence vector is never gathered: each page adds a mixed hash of itself and the count, so equal
sums are equal vectors, and a host of any size is a plain aggregation; so are order, nesting and the words
in each element's slots. What a host's template keeps is bounded by what most of its pages contain.

The template's element whose slots hold the article is found from the outside in: an element is entered if it has
more than half of the words in the slots of the one around it and nothing but sections beside it, and an article
or main element that has a tenth of them in any case. The slots of the element that this ends at are the page's
text, without fixed text of the template. Names of elements, roles and classes only weigh: words in what is named a
menu, header, footer, sidebar, notice, advert, form or comment count a quarter. Within the slots and within article elements
only menus, asides, footers, forms and what is named so outright are left out: a headline in a header, a class such as
share-price and a sentence that stands among the others on every page are text.

A page without that element, one of a host with fewer pages or without a template, and one without a host get the text
of their article or main elements or, if there is none, all text outside what is named as above (the tag path).
Fixed text is never left out of an article or main element, where equal paragraphs are copied articles.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, stored

LEAST_PAGES, MOST_SHARE = 3, 0.6

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_CUT_TAG = re.compile(r"""</?[a-zA-Z][^<>]*\Z|<!?-{0,2}\Z|</\Z""")
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_MAIN = {"article", "main"}
_OTHER = {"nav", "header", "footer", "aside", "head", "menu", "dialog", "button", "select", "svg", "object", "canvas"}
_OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
#: Words in a class or id that say that an element holds no article: outside of an article any of them, within one only a
#: name that has no other words than these and _WITH.
_OTHER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related",
    "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
    "toolbar", "widget", "widgets",
}
_WITH = {"area", "articles", "bar", "block", "body", "box", "buttons", "container", "form", "icons", "inner", "item", "items", "links", "list", "posts", "section", "stories", "thread", "unit", "wrap", "wrapper"}
#: An open element of the first kind ends where one of the second begins.
_CLOSES = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_WORDS = re.compile(r"[a-z]+|[^a-z\W_]+")
#: What the first word of a class or id says of an article element that is a reader's.
_READERS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
#: Elements that are parts of a text, not sections of a page.
_TEXTUAL = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure"}


def host(url: str | None) -> str:
    """The host in lower case, without user and port; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


@lru_cache(1 << 14)
def _kind(name: str, attributes: str) -> tuple[str, str]:
    """'main', 'other', 'loose' (other, but within an article a part of it), 'form' or ''; and the classes, as a part of a
    path. Tags of one make recur on page after page."""
    kind = "main" if name in _MAIN else "loose" if name == "header" else "other" if name in _OTHER else "form" if name == "form" else ""
    classes = []
    for key, value in _NAMES.findall(attributes) if attributes else ():
        value = value.strip("\"'").lower()
        if key.lower() == "class":
            classes.append(value)
        if key.lower() == "role":
            kind = "main" if value in ("main", "article") else "other" if value in _OTHER_ROLES else kind
        elif name in _MAIN and any(w and w[0] in _READERS for w in map(_WORDS.findall, value.split())):
            kind = "other"
        elif name not in ("html", "body") and kind != "main":
            named = [set(_WORDS.findall(part)) for part in value.split()]
            if any(words & _OTHER_WORDS and words <= _OTHER_WORDS | _WITH for words in named):
                kind = "other"
            elif kind == "" and any(words & _OTHER_WORDS for words in named):
                kind = "loose"
    return "other" if name in _RAW else kind, ".".join(sorted(classes))


def _events(page: str, known: frozenset | set | dict = frozenset()):
    """(path, name, text, in main, in other, breaks, owner) of tags and text nodes in page order.

    Tags have a name ('/p' for an end) and no text; breaks tells that a tag ends a block; owner is the innermost open
    element whose token is known (0 if none); for a known element's own start it is that around it. Within a known
    element only what is named other inside of it counts as such, and a form around an article or main element does
    not count for it, as some sites put all of a page into one."""
    stack: list[tuple[str, str, str, int, int, int]] = []  # name, kind, path, owner, other elements and forms around it

    kinds: Counter = Counter()  # of the open elements
    names: Counter = Counter()

    def state(text=None, name="", breaks=False, path=None, owner=None):
        _, _, here, own, around, forms = stack[-1] if stack else ("", "", "", 0, 0, 0)
        return (path if path is not None else here, name, text, kinds["main"] > 0, kinds["other"] > around or kinds["form"] > forms, breaks, own if owner is None else owner)

    def push(name, kind, path):
        owner, around, forms = stack[-1][3:] if stack else (0, 0, 0)
        names[name] += 1
        kinds[kind] += 1
        if known and (token := _token(path, name, None)) in known:
            owner, around, forms = token, kinds["other"], kinds["form"]
        elif kind == "main" and kinds["main"] == 1:
            forms = kinds["form"]
        stack.append((name, kind, path, owner, around, forms))

    def pop():
        name, kind, *_ = stack.pop()
        names[name] -= 1
        kinds[kind] -= 1

    at, n = 0, len(page)
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            yield state(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, block = m[2].lower(), m[2].lower() not in _INLINE
        if m[1]:
            if names[name]:
                while stack[-1][0] != name:
                    pop()
                path = stack[-1][2]
                pop()
            else:
                path = stack[-1][2] if stack else ""
            yield state(name="/" + name, breaks=block, path=path)
            continue
        # an open paragraph ends with the next block; list items and cells end with their like
        if stack and block:
            top = stack[-1][0]
            while stack and stack[-1][0] in _INLINE and names["p"] and name in ("p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "footer", "blockquote", "pre"):
                pop()
            top = stack[-1][0] if stack else ""
            if top in _CLOSES and (_CLOSES[top] is None or name in _CLOSES[top]):
                pop()
        kind, words = _kind(name, m[3])
        if kind == "loose":
            kind = "" if kinds["main"] or stack and stack[-1][3] else "other"
        # beyond some length a path goes on from its digest, so that depth costs nothing
        above = stack[-1][2] if stack else ""
        path = (above if len(above) < 4096 else xxhash.xxh3_128_hexdigest(above.encode("utf-8", "surrogatepass"))) + "/" + name + ("." + words if words else "")
        if name in _VOID or m[3].endswith("/"):
            yield state(name=name, breaks=block, path=path)
            continue
        around = stack[-1][3] if stack else 0
        push(name, kind, path)
        yield state(name=name, breaks=block, path=path, owner=around)
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
    if at < n:
        rest = _CUT_TAG.sub("", page[at:])
        if rest:
            yield state(rest)


@lru_cache(1 << 14)
def _tag_token(path: str, name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{name}") >> 1


def _token(path: str, name: str, text: str | None) -> int:
    return _tag_token(path, name) if text is None else xxhash.xxh3_64_intdigest(f"{path}\1{' '.join(text.split())}") >> 1


def _counts(batches):
    """(host, token, kind, once, lo, hi, pages): of a batch's pages, each token's part of its occurrence vector's hash;
    kind is 0 of a text, 1 of a start, 2 of an end."""
    for b in batches:
        found: dict = {}
        for url, page, weight in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), b.column("weight").to_pylist()):
            page = page or ""
            where, key, counts = host(url), xxhash.xxh3_64_intdigest(page), {}
            for path, name, text, main, *_ in _events(page):
                if text is not None and (main or not text.strip()):
                    continue
                t = _token(path, name, text)
                counts[t] = (counts.get(t, (0,))[0] + 1, 0 if text is not None else 2 if name[:1] == "/" else 1)
            counts[0] = (1, 0)  # the page itself
            for t, (c, kind) in counts.items():
                h = xxhash.xxh3_64_intdigest(f"{key}:{c}")
                lo, hi, pages, once, _ = found.get((where, t), (0, 0, 0, True, kind))
                found[where, t] = (lo + (h & 0xFFFFFFFF), hi + (h >> 32), pages + weight, once and c == 1, kind)
        rows = [(w, t, kind, once, lo, hi, pages) for (w, t), (lo, hi, pages, once, kind) in found.items()]
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["host", "token", "kind", "once", "lo", "hi", "pages"])


def _shapes(batches):
    """(host, token, name, main, parent, place, words): of a batch's pages, the elements of the template: the element
    around each, its place among those of its class, and the weight of the words in its own slots; several rows where
    pages differ."""
    for b in batches:
        found: dict = {}
        for where, page, weight, known, fixed in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("weight").to_pylist(), b.column("elements").to_pylist(), b.column("fixed").to_pylist()):
            known, fixed, met, rows = {x["token"]: x["class"] for x in known}, set(fixed or ()), Counter(), {0: ["", False, 0, 0, 0]}
            for path, name, text, main, other, _, owner in _events(page or "", known):
                if text is not None:
                    inside = path.rpartition("/")[2].partition(".")[0]
                    if inside not in _RAW and (main or _token(path, name, text) not in fixed):
                        rows[owner][4] += len(text.split()) * (1 if other else 4)
                elif name[:1] != "/" and (token := _token(path, name, None)) in known:
                    rows[token] = [name, main, owner, met[known[token]], 0]
                    met[known[token]] += 1
            for token, (name, main, owner, place, words) in rows.items():
                key = (where, token, name, main, owner, place)
                found[key] = found.get(key, 0) + words * weight
        rows = [(*k, float(v)) for k, v in found.items()]
        types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["host", "token", "name", "main", "parent", "place", "words"])


def container(elements: list) -> int:
    """The element whose slots hold the article, of one host's elements(token, name, main, parent, valid, words); 0 if
    it is the whole page. Elements that are not valid hand their words on to those around them."""
    by = {e["token"]: e for e in elements}

    def holder(t):
        seen = set()
        while t in by and not by[t]["valid"] and t not in seen:
            seen.add(t)
            t = by[t]["parent"]
        return t if t in by else 0

    own: Counter = Counter()
    children: dict[int, list] = {}
    for t, e in by.items():
        own[holder(t)] += e["words"]
        if t and e["valid"]:
            children.setdefault(holder(e["parent"]), []).append(t)
    order, at = [0], 0
    while at < len(order):
        order += children.get(order[at], [])
        at += 1
    total = Counter(own)
    for t in reversed(order[1:]):
        total[holder(by[t]["parent"])] += total[t]
    node = 0
    while True:
        below = sorted((c for c in children.get(node, ()) if total[c] > 0), key=lambda c: (-total[c], c))
        mains = [c for c in below if by[c]["main"] and 10 * total[c] >= total[node]]
        if mains and not (node in by and by[node]["main"]):
            node = mains[0]
        elif below and 2 * total[below[0]] > total[node] and 20 * own[node] <= total[node] and not any(by[c]["name"] in _TEXTUAL for c in below):
            node = below[0]
        else:
            return node


def _containers(batches):
    for b in batches:
        found = [container(x) for x in b.column("elements").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("fixed"), pa.array(found, pa.int64())], ["host", "fixed", "container"])


def hosts():
    """`host` as a column."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """(host, fixed, container): of each host that has a template, over its different pages, the text tokens and the
    element of the article. Pages without a host are of no common site and have no template."""
    # copies of a page are one page: each of c copies on a host counts as 1 / c
    named = pages.select(hosts().alias("host"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"), "url", "html").where("host <> ''")
    copies = stored(named.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "copies")
    weighed = named.join(copies, ["host", "digest"], "left").select("host", "url", "html", (1 / F.coalesce("c", F.lit(1))).alias("weight"))
    counts = weighed.select("url", "html", "weight").mapInArrow(_counts, "host string, token long, kind long, once boolean, lo long, hi long, pages double")
    tokens = stored(counts.groupBy("host", "token").agg(F.max("kind").alias("kind"), F.min("once").alias("once"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.sum("pages").alias("pages")), "tokens")
    size = tokens.where("token = 0").select("host", F.col("pages").alias("of")).where(f"of > {LEAST_PAGES} - 1e-6")
    often = tokens.where("token <> 0").join(size, "host").where(f"pages > {LEAST_PAGES} - 1e-6 and pages > {MOST_SHARE} * of - 1e-6")
    # a valid class has several tokens with one vector, and a tag that holds its text
    element = F.struct("token", F.col("lo").alias("class"))
    classes = often.groupBy("host", "lo", "hi").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n"), F.collect_list(F.when((F.col("kind") == 1) & F.col("once"), element)).alias("elements"), F.collect_list(F.when(F.col("kind") == 0, F.col("token"))).alias("fixed"))
    valid = classes.where("kind > 0 and n > 1")
    known = stored(valid.groupBy("host").agg(F.flatten(F.collect_list("elements")).alias("elements"), F.flatten(F.collect_list("fixed")).alias("fixed")), "classes")
    shapes = weighed.join(known, "host").select("host", "html", "weight", "elements", "fixed").mapInArrow(_shapes, "host string, token long, name string, main boolean, parent long, place long, words double")
    # an element that stands elsewhere on some page, in its class or among the others, is not of the template
    found = shapes.groupBy("host", "token").agg(
        F.first("name").alias("name"),
        F.max("main").alias("main"),
        F.min("parent").alias("parent"),
        ((F.min("parent") == F.max("parent")) & (F.min("place") == F.max("place"))).alias("valid"),
        F.sum("words").alias("words"),
    )
    tree = found.groupBy("host").agg(F.collect_list(F.struct("token", "name", "main", "parent", "valid", "words")).alias("elements"))
    return tree.join(known.select("host", "fixed"), "host").select("host", "elements", "fixed").mapInArrow(_containers, "host string, fixed array<long>, container long")


def main_text(page: str, fixed: frozenset | set = frozenset(), element: int = 0) -> str:
    """The page's blocks, joined by newlines; `element` is the token of the template's element that holds the article."""
    blocks: dict[str, list[str]] = {"slot": [], "main": [], "other": []}
    now: list[str] = []
    kind = "other"

    def end():
        block = " ".join("".join(now).split())
        if block:
            blocks[kind].append(block)
        now.clear()

    events = list(_events(page, {element} if element else frozenset()))
    # within the template's element a fixed text is left out where nothing but fixed text stands, not among the others
    varied = {path for path, _, text, _, _, _, owner in events if owner and text is not None and text.strip() and _token(path, "", text) not in fixed} if element and fixed else ()
    for path, name, text, inside, skip, breaks, owner in events:
        here = "slot" if owner else "main" if inside else "other"
        if breaks or here != kind:
            end()
            kind = here
        if text is None:
            if name == "br":
                now.append(" ")
            continue
        if skip or (not inside and fixed and text.strip() and not (owner and path in varied) and _token(path, name, text) in fixed):
            continue
        now.append(_html.unescape(text))
    end()
    return "\n".join(blocks["slot"] or blocks["main"] or blocks["other"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null html is empty and gives an empty text; pages with a null or hostless url have no template. Repeated rows give
    repeated rows; other columns are ignored; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    fixed = stored(templates(pages), "templates")

    def run(batches):
        for b in batches:
            cache: dict = {}
            out = []
            for name, page, tokens, element in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("fixed"), b.column("container").to_pylist()):
                if name not in cache:
                    cache[name] = set(tokens.as_py() or ())
                out.append(main_text(page or "", cache[name], element or 0))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    met = pages.withColumn("host", hosts()).join(fixed, "host", "left").select("page_id", "url", "html", "host", "fixed", "container")
    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long")
