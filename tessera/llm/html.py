"""Main text of web pages: template deduction by equivalence classes of tokens, then the slots' text."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import BATCH_ROWS, map_batches
from tessera.session import materialize

#: A token belongs to a template if it is on half of a host's distinct pages, and on three at least.
LEAST_PAGES = 3

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
RAW = frozenset("script style textarea title xmp noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements without article text, and words of a class, id or role that mark such an element.
DROPPED = frozenset("head script style noscript template iframe nav footer aside menu button select textarea input svg canvas object dialog title".split())
BOILERPLATE = frozenset("""
ad ads adbox advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments comentarios
consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr kommentare login masthead menu modal nav
navbar navbox navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related reply
respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription syndication toolbar widget widgets
""".split())
#: First words of a class that tell of a layout ("has-sidebar", "no-comments"), as a last "free" does ("ad-free").
STATES = frozenset("has have no non not with without".split())
#: What marks a block: nothing, a form around it, a word of a class, id or role, or a tag without article text.
NONE, FORM, WORD, TAGGED = range(4)
#: The same outside an article only: an article has a header of its own.
OUTER = frozenset({"header"})
MAIN = frozenset({"article", "main"})
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that an unclosed paragraph or list item doesn't reach out of.
SCOPE = frozenset("article main section div table ul ol dl td th body html aside nav footer header form blockquote".split())


def names_boilerplate(value: str, words: frozenset[str]) -> bool:
    """Whether a name in a class, id or role has one of the words, unless it tells of a layout."""
    parts = [re.split(r"[^a-z0-9]+", name) for name in value.split()]
    return any(not words.isdisjoint(x) and x[0] not in STATES and x[-1] != "free" for x in parts)


def mark(tag: str, attributes: str, in_main: bool) -> int:
    """What an element marks all below it with, as far as no article stands between."""
    if tag in DROPPED or tag in OUTER and not in_main:
        return TAGGED
    found = FORM if tag == "form" else NONE
    if not attributes or tag in MAIN or tag in ("html", "body"):
        return found
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "").lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            return TAGGED
        if name != "style" and names_boilerplate(value, BOILERPLATE if in_main else BOILERPLATE | OUTER):
            found = WORD
    return found


def blocks(page: str) -> list[tuple[str, str, bool, int]]:
    """(path, text, in article, mark) of each tag (without text) and each block of text, in order.

    Text is decoded and its white space is one blank. Inline tags don't part text.
    A form around an article doesn't mark it; a word of a wrapper's leaves it with FORM, so that an
    article without such a wrapper goes before. In an article, a form marks as a word does."""
    out: list[tuple[str, str, bool, int]] = []
    stack: list[tuple[str, str, bool, int]] = [("", "", False, NONE)]  # tag, path, in article, mark
    text: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        words = " ".join("".join(text).split())
        if words:
            out.append((stack[-1][1], words, *stack[-1][2:]))
        text.clear()

    def close(tags: set[str], within: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in within:
                return

    while at < end:
        found = TAG.search(page, at)
        if found is None:
            text.append(unescape(page[at:]))
            break
        if found.start() > at:
            text.append(unescape(page[at : found.start()]))
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if tag == "br":
            text.append(" ")
        if tag in INLINE and tag not in DROPPED:
            if closing or not attributes or not mark(tag, attributes, stack[-1][2]):
                if closing and stack[-1][0] == tag:
                    flush()
                    stack.pop()
                continue
            if tag in VOID:
                continue
        flush()
        if closing:
            close({tag}, frozenset())
            continue
        if tag in ENDS_P:
            close({"p"}, SCOPE)
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE)
        _, path, in_main, above = stack[-1]
        own = mark(tag, attributes, in_main)
        if in_main and own == FORM:
            own = WORD
        if tag in MAIN and not in_main and above != TAGGED:
            above = FORM if above == WORD else NONE
        entry = (tag, f"{path}/{tag}", in_main or tag in MAIN, max(above, own))
        out.append((entry[1] + (attributes.strip() and "[" + attributes.strip() + "]"), "", *entry[2:]))
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(entry)
    flush()
    return out


def hashed(token: str) -> int:
    """A 63-bit number of a token, the same in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest(token) >> 1


def token(path: str, text: str) -> str:
    return f"{path}|{text}"


def matched(found: list[int], classes: list[list[int]]) -> set[int]:
    """The tokens of the classes that a page follows: it has all tokens of the class, and has them in
    the class's order. ``found`` is the page's tokens in order. Classes come from those of most pages
    inward, so what is taken of a class lies in the slots of those before it."""
    first: dict[int, int] = {}
    for place, t in enumerate(found):
        first.setdefault(t, place)
    out: set[int] = set()
    for tokens in classes:
        places = [first.get(t, -1) for t in tokens]
        if min(places) >= 0 and all(x < y for x, y in zip(places, places[1:])):
            out.update(tokens)
    return out


def extracted(page: str, classes: list[list[int]]) -> str:
    """The text in the slots of a page: blocks that are not tokens of the template, in an article or
    outside. The article element and the marks choose among the slots: those of articles go before
    those outside, then unmarked ones before marked ones, which count only where no others have text.
    A template that leaves nothing of the articles is not usable on that page. What no article holds
    counts if it is in a form, too, when most of it is (a form around the whole page)."""
    found = blocks(page)
    names = [hashed(token(path, text)) if classes else 0 for path, text, _, _ in found]
    template = matched(names, classes)
    own = [(text, name in template, main, marked) for (_, text, main, marked), name in zip(found, names, strict=True) if text and marked != TAGGED]
    slots = [x for x in own if not x[1]]
    size = [sum(len(text) for text, _, main, marked in slots if not main and marked == m) for m in (NONE, FORM)]
    outer = (NONE, FORM) if size[1] > size[0] else (NONE,)
    for among, inside, marks in ((slots, True, (NONE,)), (slots, True, (FORM,)), (own, True, (NONE,)), (own, True, (FORM,)), (slots, False, outer), (slots, True, (WORD,)), (slots, False, (FORM, WORD))):
        if taken := [text for text, _, main, marked in among if main == inside and marked in marks]:
            return "\n".join(taken)
    return ""


def templates(pages: DataFrame) -> DataFrame:
    """(host, classes) of the hosts' templates, from (host, page, html) of distinct pages.

    A token is a tag at its path, or a text at its path. Tokens with the same occurrence vector (how
    often on each page of the host) form an equivalence class; vectors are compared by sums of
    hashes, so they are added up before the shuffle and no task sees a host whole. A class is valid
    if it is on half of the host's pages (three at least) and has two tokens or more. Its tokens are in
    the order of their mean places, which is their order on every page if they keep one; whether a
    page keeps it is seen when the page is extracted (``matched``). Classes nest from those on most
    pages inward.
    """

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        host, page, name, times, place = [], [], [], [], []
        for h, p, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
            found = [hashed(token(path, text)) for path, text, _, _ in blocks(html or "")]
            where = {t: i for i, t in reversed(list(enumerate(found)))}
            for t, n in Counter(found).items():
                host.append(h)
                page.append(p)
                name.append(t)
                times.append(n)
                place.append(where[t])
        return pa.RecordBatch.from_arrays([pa.array(host, pa.int64()), pa.array(page, pa.int64()), pa.array(name, pa.int64()), pa.array(times, pa.int32()), pa.array(place, pa.int32())], ["host", "page", "token", "times", "place"])

    seen = map_batches(pages.select("host", "page", "html"), tokens, "host long, page long, token long, times int, place int", rows=BATCH_ROWS)
    part = lambda seed: F.sum(F.pmod(F.xxhash64("page", "times", F.lit(seed)), F.lit(1 << 31)))
    vectors = seen.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), part(1).alias("v1"), part(2).alias("v2"), F.avg("place").alias("place"))
    vectors = vectors.where(F.col("pages") >= LEAST_PAGES)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    frequent = vectors.join(totals, "host").where(F.col("pages") * 2 >= F.col("of"))
    classes = frequent.groupBy("host", "pages", "v1", "v2").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct("place", "token"))).alias("found"))
    nested = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("outer"), "v1", "v2", F.col("found.token").alias("tokens"))))
    return classes.where("size > 1").groupBy("host").agg(nested["tokens"].alias("classes"))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page: its main text, blocks joined by line feeds.

    Templates are deduced a host over distinct pages; they are joined to the pages by host (Spark
    broadcasts them if they are small, and splits hosts with very many pages if not). Null html is
    empty and gives an empty text. Pages with a null url share one host. Rows that repeat have equal
    results. Other columns are not read.
    """
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("host", host)
    # of a host's pages with equal articles one counts, else copies of an article would look like a template
    article = F.regexp_extract(F.regexp_extract("html", r"(?is)<(?:article|main)\b.*", 0), r"(?is)^<[^>]*>(.*)</(?:article|main)\b", 1)
    has_text = F.regexp_replace(article, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|\s+", "") != ""
    distinct = rows.withColumn("page", F.xxhash64(F.when(has_text, article).otherwise(F.col("html")))).groupBy("host", "page").agg(F.min("html").alias("html"))
    found = materialize(templates(distinct), "templates").withColumnRenamed("host", "of")
    kind = rows.schema["id"].dataType.simpleString()

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extracted(h, c or []) for h, c in zip(batch.column("html").to_pylist(), batch.column("classes").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    joined = rows.join(found, F.col("host") == F.col("of"), "left").select("id", "url", "html", "classes")
    return map_batches(joined, extract, f"id {kind}, url string, text string, n_chars long", rows=BATCH_ROWS)
