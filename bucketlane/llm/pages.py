"""Main text of HTML pages by deduction of their hosts' templates.

Pass 1 reads each page as tokens: tags with their element path, and whole text nodes with theirs. Copies on a host, pages
whose content text is equal, count once; fewer than FEWEST different pages make no template. A token's occurrence
vector over the pages of a host is kept as a sum of 32-bit page marks (times its count), so equal vectors have equal sums
and sums combine before any shuffle. Tokens with equal sums on a host are one equivalence class. Classes with the support
of most pages are its template; by their mean places they are put in order, and a class whose tokens lie between two
neighbours of the class of all pages is valid and nested there (`nest`). With each token of an element go the characters
of text, and of links, that the host's pages have within it.

Pass 2 cuts each page at the template tokens it holds in template order; what is left between them are slots, and slots
are all that is extracted (`slots`). Text nodes of the template aren't content, in articles neither, unless they are half
of the article's text and more: that is a near copy of another page, which stays whole. Which slots are content is settled
for the template's elements (`settle`), and holds for what they enclose:
- An element with more than half of the host's unlinked text holds the content; its names don't matter.
- A list that is mostly links over the host's pages is a menu, outside of article and main elements.
- Elements that say so by tag, role or a few classes (navigation, header, footer, sidebar, advert, form, script, comments)
  aren't content; other names (banner, social, ...) count only for elements of the template within an article or main
  element, and anywhere outside of one. Headings are never left out for their names, sections never for their id.
- If the page has an article or main element with text, only slots within it are content.
A page without a template (its host has too few) is judged by its own elements; there nothing confirms names, holds or
links. An empty template is no template: all visible text is one slot then.

Text: character references decoded, white space in a block made one blank, blocks joined by one blank in page order.
What a menu's switch says in a bare div is no text.

Edge cases: null, empty or text-free html gives an empty text; broken nesting closes what it must; unclosed comments,
scripts and tags run to the end of the page, quotes that never close are plain characters; hosts of fewer than FEWEST
different pages, or a url that is null or has no host, have no template; repeated pages stay. Reading takes time in
proportion to the page, however broken.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketlane.llm.runtime import checkpoint, lean, ship

#: Share of a host's pages that template tokens have; most template tokens that go to all workers; fewest pages; hosts of
#: most rows, whose pages aren't moved where templates have to be joined.
SUPPORT, MOST, FEWEST, HOT = 0.6, 100_000, 4, 500

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?"
    rf"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg)\b{_ATTRS}(?:>|\Z)(?P<body>.*?)(?:</(?P=raw)\s*+>|\Z)"
    rf"|</(?P<end>[a-z][^\s>/]*+)[^>]*+(?:>|\Z)|<(?P<tag>[a-z][^\s>/]*+)(?P<attrs>{_ATTRS})(?:>|\Z)"
    r"|(?P<text>(?:[^<]++|<(?![a-z/!?]))++)|<",
    re.I | re.S,
)
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "body", "html", "head", "title"}
_OTHER = frozenset("nav header footer aside form script style head title noscript template button select textarea iframe svg annotation annotation-xml dialog menu input label".split())
_OTHER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad-?(?:box|slot|unit|block|wrap|wrapper|container)|adverts?|advertisement|advertising|banner|promo\w*|sponsor\w*|cookies?|consent|notice|alert|comment(?:s|list|box|area|section|thread|form)?|discussion|replies|respond|disqus|"
    r"side-?bar|menu|nav|navbar|navigation|breadcrumbs?|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|footer|header|masthead|popup|modal|widget|pagination|pager|toolbar|copyright|legal|disclaimer|skip)(?:$|[\s_-])", re.I)  # fmt: skip
#: Classes that exclude elements within articles, too, whatever the template has.
_OTHER_CLASS = re.compile(r"(?:^|\s)(?:ads?|ad-?(?:box|slot|unit|block|wrap|wrapper|container)|adverts?|advertisement|advertising|cookie-?(?:banner|notice|consent)|comments|comments?-?(?:list|box|area|section|thread|form)|disqus|side-?bar|navbar|breadcrumbs?|newsletter|pagination|pager)(?:$|\s)", re.I)
_HEADING = re.compile("h[1-6]")
_LISTS = frozenset("ul ol dl menu".split())
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article-?body|post-?body|post-?content|entry-?content|main-?content|article-?content|story-?body)(?:$|[\s_-])", re.I)

#: What the switch of a menu says, as a whole block of bare div and span elements.
_LABEL = re.compile(r"(?:(?:main|toggle|open|close|site) )?(?:menu|navigation)", re.I)


#: What an element says of itself: nothing, by any name, by a class that is sure, by tag or role; or that it's a main one.
PLAIN, NAMED, SURE, OTHER, MAIN = range(5)


def _name(tag: str, attrs: str) -> tuple[str, int]:
    """Path step of an element, and what it says of itself."""
    if not attrs or attrs.isspace():
        return tag, OTHER if tag in _OTHER else MAIN if tag in ("article", "main") else PLAIN
    got = {a.lower(): (v or "").strip("\"'") for a, v in _ATTR.findall(attrs)}
    classes = got.get("class", "")
    named = " ".join(got.get(k, "") for k in ("class", "id"))
    role, prop = got.get("role", "").lower(), got.get("itemprop", "").lower()
    step = f"{tag}.{named.strip().lower()}" if named.strip() else tag
    if tag in _OTHER or role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
        return step, OTHER
    if "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower():
        return step, OTHER
    if tag not in ("body", "html", "article", "main") and not _HEADING.fullmatch(tag):
        if _OTHER_CLASS.search(classes):
            return step, SURE
        # ids of sections are words of their headings
        if _OTHER_NAME.search(classes if tag == "section" or "section" in classes.lower().split() else named):
            return step, NAMED
    main = tag in ("article", "main") or role in ("main", "article") or prop == "articlebody" or _MAIN_NAME.search(named)
    return step, MAIN if main else PLAIN


_SCOPE = frozenset(("p", "div", "td", "li", "article", "section", "body"))


def tokens(page: str | None) -> Iterator[tuple[str, int, str, int]]:
    """(kind, path, text, says): "<" opens an element, "-" is one without content, ">" closes one, "t" is a text node, "|" a
    break between blocks. path is a hash of the element's path; text is the tag for "<" and "-"."""
    # tag, path, where the nearest element of _SCOPE is
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    open_: Counter = Counter()
    pack = int.to_bytes

    def close(tag: str):
        while open_[tag]:
            t, path, _ = stack.pop()
            open_[t] -= 1
            yield ">", path, t, 0
            if t in _BLOCK:
                yield "|", 0, "", 0
            if t == tag:
                return

    for m in _TOKEN.finditer(page or ""):
        kind = m.lastgroup
        if kind == "text":
            yield "t", stack[-1][1], m[0], 0
        elif kind == "attrs":
            tag, attrs = m["tag"].lower(), m["attrs"]
            if tag in _CLOSES_P and stack[stack[-1][2]][0] == "p":
                yield from close("p")
            elif tag == "li" and any(s[0] == "li" for s in stack[-2:]):
                yield from close("li")
            step, says = _name(tag, attrs)
            if tag in _BLOCK:
                yield "|", 0, "", 0
            path = xxhash.xxh64_intdigest(step, stack[-1][1])
            if tag in _VOID or attrs.endswith("/"):
                yield "-", path, tag, says
            else:
                yield "<", path, tag, says
                stack.append((tag, path, len(stack) if tag in _SCOPE else stack[-1][2]))
                open_[tag] += 1
        elif kind == "end":
            yield from close(m["end"].lower())
        elif kind == "body":
            yield "-", xxhash.xxh64_intdigest(m["raw"].lower(), stack[-1][1]), m["raw"].lower(), OTHER
        elif m[0] == "<":
            yield "t", stack[-1][1], "<", 0


def _key(kind: str, path: int, text: str) -> int:
    """Token: elements by path, text nodes by path and words."""
    if kind == "t":
        return xxhash.xxh64_intdigest(" ".join(text.split()), path ^ 1) - (1 << 63)
    return xxhash.xxh64_intdigest(kind, path) - (1 << 63)


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame, html: str = "html", support: float = SUPPORT) -> DataFrame:
    """(host, token, klass, place, chars, linked, says) of template tokens; token 0 is the page itself. `host` is a column of
    pages. chars and linked: characters of text, and of links, within an element over all pages. Pages of a host whose content
    text is equal count once (as the one of least hash). The number of tokens of a host is at most that of an average page
    divided by `support`."""
    ship(pages.sparkSession)

    def run(batches):
        for b in batches:
            said_, page_, ends = [], [], [0]
            flat: tuple[list[int], ...] = ([], [], [], [], [], [])
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mark = xxhash.xxh32_intdigest(page or "", 11) | 1
                count, said, n = page_tokens(page)
                for key, (times, place, chars, linked, says) in count.items():
                    flat[0].append(key)
                    flat[1].append((mark * times * (2 * times + 1)) & 0xFFFFFFFF if times > 1 else mark)
                    for f, x in zip(flat[2:], (place * 1000 // (n + 1), chars, linked, says)):
                        f.append(x)
                ends.append(len(flat[0]))
                said_.append(said)
                page_.append(xxhash.xxh64_intdigest(page or "") - (1 << 63))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], ["token", "vector", "place", "chars", "linked", "says"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said_, pa.int64()), pa.array(page_, pa.int64()), lists], ["host", "said", "page", "tokens"])

    fields = "token: bigint, vector: bigint, place: bigint, chars: bigint, linked: bigint, says: bigint"
    rows = pages.select("host", html).mapInArrow(lean(run), f"host string, said long, page long, tokens array<struct<{fields}>>")
    once = rows.groupBy("host", "said").agg(F.min_by("tokens", "page").alias("tokens")).select("host", F.inline("tokens"))
    totals = [F.sum(c).alias(c) for c in ("vector", "place", "chars", "linked")]
    sums = once.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), *totals, F.max("says").alias("says"))
    summed = checkpoint(sums.where("pages > 1 or token = 0"))
    whole = summed.where("token = 0").select("host", F.col("pages").alias("of"), F.col("vector").alias("all"))
    often = summed.join(whole, "host").where((F.col("of") >= FEWEST) & (F.col("pages") >= F.ceil(F.col("of") * support)))
    klass = F.when(F.col("vector") == F.col("all"), F.lit(0)).otherwise(F.col("vector"))
    return often.select("host", "token", klass.alias("klass"), (F.col("place") / F.col("pages")).alias("place"), "chars", "linked", "says")


def page_tokens(page: str | None) -> tuple[dict[int, list[int]], int, int]:
    """By token: [count, place of the last one, characters, of these in links, what it says]; hash of the content text; number
    of tokens. Token 0 is the page."""
    count: dict[int, list[int]] = {}
    said = xxhash.xxh64(seed=11)
    n = chars = linked = 0
    open_: list[tuple[list[int], int, int, bool, bool]] = []  # counts of the element, chars and linked before, never content, link
    other = link = False
    for kind, path, text, says in tokens(page):
        if kind == "|":
            continue
        if kind == "t":
            if text.isspace():
                continue
            words = " ".join(text.split())
            chars += len(words)
            if link:
                linked += len(words)
            if not other:
                said.update(f"{words}\x1f")
        n += 1
        c = count.setdefault(_key(kind, path, text), [0, n, 0, 0, says])
        c[0] += 1
        if kind == "<":
            open_.append((c, chars, linked, other, link))
            other, link = other or says in (SURE, OTHER) or says == NAMED, link or text == "a"
        elif kind == ">":
            c, chars0, linked0, other, link = open_.pop()
            c[2] += chars - chars0
            c[3] += linked - linked0
    for c, chars0, linked0, *_ in open_:
        c[2] += chars - chars0
        c[3] += linked - linked0
    count[0] = [1, 0, chars, linked, 0]
    return count, said.intdigest() - (1 << 63), n


#: A template by token: class (0: on all pages, once), mean place, and what its element is.
Template = dict[int, tuple[int, float, str]]
#: A page that is judged by its own elements.
ALONE: Template = {0: (0, 0.0, "")}


def settle(rows: list[tuple[int, int, float, int, int, int]]) -> Template:
    """The template of (token, klass, place, chars, linked, says) rows of a host. An element "holds" more than half of the
    host's unlinked text, "links" are those with more text in links than else, "named" ones say that they aren't content."""
    own = next((chars - linked for token, _, _, chars, linked, _ in rows if not token), 0)
    what = lambda chars, linked, says: "holds" if 2 * (chars - linked) > own > 0 else "links" if own > 0 and 2 * linked > chars else "named" if says == NAMED else ""
    return nest({token: (klass, place, what(chars, linked, says) if token else "") for token, klass, place, chars, linked, says in rows})


def nest(template: Template) -> Template:
    """The tokens of valid classes. The class of all pages (0) makes the outer slots; another class is valid if its tokens
    lie in one of them, and is nested there."""
    outer = sorted(v[1] for v in template.values() if v[0] == 0)
    slots: dict[int, set[int]] = defaultdict(set)
    for klass, place, *_ in template.values():
        slots[klass].add(bisect_left(outer, place) if klass else 0)
    return {t: v for t, v in template.items() if len(slots[v[0]]) == 1}


def slots(page: str | None, template: Template) -> Iterator[tuple[int, str, str, bool, bool]]:
    """(slot, state, text, shared, bare) of text nodes; a text of "" is a break between blocks. slot numbers the gaps between
    template tokens; state is "" for plain slots, "main" within a main element, "out" where no content is; shared: of the
    template; bare: directly in a div or span."""
    reached, slot, state, tag = -1.0, 0, "", ""
    open_: list[tuple[str, str]] = []
    for kind, path, text, says in tokens(page):
        if kind == "|":
            yield slot, "", "", False, False
            continue
        if kind == "t" and text.isspace():
            yield slot, state, text, False, tag in ("div", "span")
            continue
        known = template.get(_key(kind, path, text)) if len(template) > 1 else None
        shared = known is not None and known[1] >= reached
        if shared:
            reached, slot = known[1], slot + 1
        if kind == "t":
            yield slot, state, text, shared, tag in ("div", "span")
        elif kind == "<":
            open_.append((state, tag))
            tag = text
            what = known[2] if known else ""
            if state == "out" or not template:
                continue
            if says == OTHER or says == SURE and what != "holds" or says == SURE and state == "main":
                state = "out"
            elif says == NAMED and what != "holds" and (state != "main" or known) or what == "links" and state != "main" and text in _LISTS:
                state = "out"
            elif says == MAIN:
                state = "main"
        elif kind == ">":
            state, tag = open_.pop()


def extract(page: str | None, template: Template) -> str:
    """Text of the content slots of a page."""
    parts, size = [], {False: 0, True: 0}  # characters in main elements, by whether they are of the template
    for _, state, text, shared, bare in slots(page, template):
        if state == "main":
            size[shared] += len(text.strip())
        if not text or state == "main" or state == "" and not shared:
            parts.append((state, text, shared, bare))
    any_main, copied = bool(size[False] + size[True]), size[True] >= size[False]
    out, now, plain = [], [], True

    def close():
        said = " ".join("".join(now).split())
        if said and not (plain and _LABEL.fullmatch(said)):
            out.append(said)

    for state, text, shared, bare in parts:
        if not text:
            close()
            now, plain = [], True
        elif (state == "main" and (copied or not shared)) if any_main else True:
            now.append(_html.unescape(text))
            plain = plain and state != "main" and bare
    close()
    return " ".join(out)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most: int = MOST) -> DataFrame:
    """page_id, url, text, n_chars of each row. Templates of up to `most` tokens go to all workers. Beyond, only those of the
    hosts with most rows do, so their pages stay where they are; the pages of other hosts are joined with theirs by host."""
    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    made = checkpoint(templates(rows.select("host", "html")))
    by: dict[str, list] = {}
    fields = ("token", "klass", "place", "chars", "linked", "says")
    without = F.lit(None).cast("array<struct<token: bigint, klass: bigint, place: double, chars: bigint, linked: bigint, says: bigint>>")
    near, with_template = made, rows.withColumn("template", without)
    if made.limit(most + 1).count() > most:
        hot = [r.host for r in rows.groupBy("host").count().orderBy(F.desc("count"), "host").limit(HOT).collect()]
        while hot and made.where(F.col("host").isin(hot)).limit(most + 1).count() > most:
            hot = hot[: len(hot) // 2]
        near, far = made.where(F.col("host").isin(hot)), ~F.col("host").isin(hot)
        lists = made.where(far).groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("template"))
        with_template = with_template.where(~far).unionByName(rows.where(far).join(lists, "host", "left"))
    for r in near.collect():  # at most `most` rows
        by.setdefault(r.host, []).append(tuple(r[f] for f in fields))
    by = {host: settle(t) for host, t in by.items()}
    shared = pages.sparkSession.sparkContext.broadcast(by)

    def run(batches):
        for b in batches:
            texts = []
            for host, page, template in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                t = settle([tuple(x[f] for f in fields) for x in template]) if template else shared.value.get(host, ALONE)
                texts.append(extract(page, t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_template.select("page_id", "url", "host", "html", "template").mapInArrow(lean(run), f"page_id {kind}, url string, text string, n_chars long")
