"""Main text of web pages by equivalence classes of page tokens (op4).

A page is a sequence of tags and texts.  The pages of a host are compared: a
token (a tag with its path, or a text with its path) has an occurrence vector,
how often it stands on each page of the host.  Tokens of one vector are an
equivalence class.  A class is valid if it has several tokens and stands on
enough different pages; the classes nest by their paths, the class of the
``html`` tag outermost, and make the host's template.  Texts of the outermost
class belong to the template itself and are no content.  What stands between
template tags are its slots; a slot's path, its text and its share of link text
over all pages of the host tell content from menus.

A page's main text is taken from the slots inside its article: ``article``,
else ``main``, else the body without the slots that are links for the most
part.  Inside it, menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out, by tag, role, class or id.

The vector of a token is never gathered: it is the sum of two hashes of (page,
count), which is equal for equal vectors.  A host that holds a third of all
pages is summed up in the map tasks first.

Defined cases: null html is empty, an empty page has the empty text; a page
without a host belongs to the host ''; hosts of fewer than ``LEAST_PAGES``
different pages have no template; unclosed and stray tags close as they would
in a browser; repeated rows get equal results.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.llm.common import bounded
from packlake.session import materialize

LEAST_PAGES, LEAST_TOKENS = 8, 3
LINK_SHARE = 0.6
LONG_PATH = 400

# Groups of tags.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = RAW | {
    "head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "optgroup", "datalist", "fieldset", "label",
    "audio", "video", "map", "applet", "frameset", "output", "progress", "meter", "search",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "html", "nav", "aside", "header", "footer", "form", "blockquote"}

# Words of class, id and role that mark what is no content.
MARKS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal "
    "overlay sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer footnav header masthead "
    "comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login search widget "
    "complementary contentinfo dialog form skip".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*(?:>|\Z)|<|[^<]+", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
PART = re.compile(r"[A-Za-z]+")
SPACES = re.compile(r"\s+")
LINK = re.compile(r"/a!?(?=/|$).*")
NEGATIONS = {"no", "not", "non", "with", "without", "has"}


def _marked(tag: str, body: str) -> bool:
    """The tag's class, id or role says that it holds no content."""
    if " " not in body and "\n" not in body and "\t" not in body:
        return False
    for m in ATTRIBUTE.finditer(body):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden":
            return True
        for word in value.split():
            parts = [p.lower() for p in PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", word))]
            if parts and parts[0] not in NEGATIONS and (parts[0] in MARKS or parts[-1] in MARKS):
                return True
    return False


class Event:
    """A tag that opens or closes, or a text, with the path of open tags."""

    __slots__ = ("kind", "tag", "marked", "path", "text")

    def __init__(self, kind: str, tag: str, marked: bool, path: str, text: str):
        self.kind, self.tag, self.marked, self.path, self.text = kind, tag, marked, path, text


def events(page: str) -> Iterator[Event]:
    """The page in order; tags left open are closed where HTML closes them."""
    stack: list[tuple[str, str]] = [("", "")]  # tag, path
    at_char = 0

    def close(to: int) -> Iterator[Event]:
        while len(stack) > to:
            tag, path = stack.pop()
            yield Event("close", tag, False, path, "")

    while at_char < len(page):
        token = TOKEN.match(page, at_char)[0]
        at_char += len(token)
        if token[0] != "<" or token == "<":
            yield Event("text", stack[-1][0], False, stack[-1][1], token)
            continue
        found = NAME.match(token)
        if not found:
            if token.startswith("<![CDATA["):
                yield Event("text", stack[-1][0], False, stack[-1][1], html.escape(token[9:].removesuffix("]]>")))
            continue
        tag = found[1].lower()
        if token[1] == "/":
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] == tag:
                    yield from close(at)
                    break
                if tag in INLINE and stack[at][0] not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] == "p":
                    yield from close(at)
                    break
                if stack[at][0] in SCOPES:
                    break
        if tag in SAME_CLOSES:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] in SAME_CLOSES[tag]:
                    yield from close(at)
                    break
                if stack[at][0] in SCOPES:
                    break
        marked = tag not in ("html", "body") and _marked(tag, token)
        path = stack[-1][1]
        if tag not in INLINE or tag == "a":
            above = path if len(path) < LONG_PATH else f"/#{xxhash.xxh64_hexdigest(path)}"  # a deep page costs no more than its length
            path = f"{above}/{tag}{'!' if marked else ''}"
        yield Event("open", tag, marked, path, "")
        if tag in VOID or token.endswith("/>") and tag not in CLOSES_P:
            continue
        stack.append((tag, path))
        if tag in RAW:  # what stands in a script or style is no markup
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at_char)
            at_char = stop.end() if stop else len(page)
            yield from close(len(stack) - 1)
    yield from close(1)


def _plain(text: str) -> str:
    return SPACES.sub(" ", html.unescape(text)).strip()


def page_tokens(page: str) -> Counter:
    """How often each token stands on the page: ("tag", path) and ("text", path, text)."""
    out: Counter = Counter()
    for e in events(page):
        if e.kind == "open" and e.tag not in INLINE:
            out["tag", e.path, ""] += 1
        elif e.kind == "text" and (text := _plain(e.text)):
            out["text", e.path, text] += 1
    return out


def _text_key(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}".encode("utf-8", "replace")) - 2**63


def _slot(path: str) -> str:
    """The path of the tag around a text, links left aside."""
    return LINK.sub("", path)


def templates(pages: DataFrame) -> DataFrame:
    """(host, texts, links): texts of the host's template, and slot paths that are links for the most part.

    ``pages`` has (host, html).
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page in zip(batch["host"], batch["html"]):
                own = xxhash.xxh64_intdigest(page.encode("utf-8", "replace"))
                slots: dict[str, list[int]] = {}
                for (kind, path, text), n in page_tokens(page).items():
                    vector = xxhash.xxh64_intdigest(f"{own}:{n}".encode())
                    key = _text_key(path, text) if kind == "text" else 0
                    rows.append((host, kind, path if kind == "tag" else "", key, vector & 0x7FFFFFFF, vector >> 33, 0, 0))
                    if kind == "text":
                        sizes = slots.setdefault(_slot(path), [0, 0])
                        sizes[0] += n * len(text)
                        sizes[1] += n * len(text) * (_slot(path) != path)
                rows += [(host, "slot", path, 0, 0, 0, *sizes) for path, sizes in slots.items()]
            yield pd.DataFrame(rows, columns=["host", "kind", "path", "key", "v1", "v2", "size", "linked"])

    schema = "host string, kind string, path string, key bigint, v1 bigint, v2 bigint, size bigint, linked bigint"
    tokens = (
        pages.mapInPandas(work, schema)
        .groupBy("host", "kind", "path", "key")
        .agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).alias(c) for c in ("v1", "v2", "size", "linked")])
        .filter((F.col("pages") >= LEAST_PAGES) | (F.col("kind") == "slot"))
    )
    tokens = materialize(tokens)
    different = pages.select("host", F.xxhash64("html").alias("page")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_PAGES)
    # equivalence classes: tokens of one occurrence vector
    vector = ["host", "pages", "v1", "v2"]
    outermost = F.max(F.when((F.col("kind") == "tag") & (F.col("path") == "/html"), 1).otherwise(0))
    classes = (
        tokens.filter("kind <> 'slot'")
        .groupBy(*vector)
        .agg(F.count(F.lit(1)).alias("tokens"), outermost.alias("outermost"))
        .filter(F.col("tokens") >= LEAST_TOKENS)
        .join(different.select("host"), "host")
    )
    # the classes nest by path; the outermost one, of the html tag, is on every page, and its texts are the host's own
    outer = classes.filter("outermost = 1").select(*vector)
    texts = tokens.filter("kind = 'text'").join(outer, vector).groupBy("host").agg(F.array_sort(F.collect_set("key")).alias("texts"))
    links = (
        tokens.filter("kind = 'slot'")
        .filter(F.col("linked") > F.col("size") * LINK_SHARE)
        .join(different.select("host"), "host")
        .groupBy("host")
        .agg(F.array_sort(F.collect_set("path")).alias("links"))
    )
    return texts.join(links, "host", "full").select("host", "texts", "links")


def _region(sequence: list[Event]) -> str | None:
    """The tag that holds the page's article; one that is itself left out does not count."""
    tags, left_out = set(), 0
    for e in sequence:
        if e.tag in VOID or e.kind == "text":
            continue
        if e.kind == "open":
            left_out += bool(left_out or e.tag in LEFT_OUT or e.marked)
            if not left_out:
                tags.add(e.tag)
        elif left_out:
            left_out -= 1
    return next((t for t in ("article", "main") if t in tags), None)


def main_text(page: str, texts: frozenset = frozenset(), links: frozenset = frozenset()) -> str:
    """Blocks of the page's article, two newlines between them."""
    sequence = list(events(page))
    region = _region(sequence)
    blocks: list[str] = []
    block: list[str] = []
    left_out = inside = 0

    def end() -> None:
        if block and (text := _plain("".join(block))):
            blocks.append(text)
        block.clear()

    for e in sequence:
        if e.kind == "text":
            wanted = inside if region else _slot(e.path) not in links
            if wanted and not left_out and not (texts and _text_key(e.path, _plain(e.text)) in texts):
                block.append(e.text)
            continue
        if e.tag not in INLINE:
            end()
        elif e.tag in ("br", "img"):
            block.append(" ")
        if e.tag in VOID:
            continue
        if e.kind == "open":
            left_out += bool(left_out or e.tag in LEFT_OUT or e.marked)
            inside += bool(inside or e.tag == region)
        else:
            left_out -= bool(left_out)
            inside -= bool(inside)
    end()
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    own = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    known = materialize(templates(own.select("host", "html")))

    @F.pandas_udf("string")
    def text(pages: pd.Series, texts: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, frozenset(() if t is None else t), frozenset(() if k is None else k)) for p, t, k in zip(pages, texts, links)])

    found = own.join(bounded(known), "host", "left").select("page_id", "url", text("html", "texts", "links").alias("text"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
