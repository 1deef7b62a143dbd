"""HTML extraction by templates that are deduced from equivalence classes of tokens.

A page is a sequence of tokens: tags with their path of open elements, and texts with theirs. Tokens
of a host's pages that have the same occurrence signature (how often in which page) form an equivalence
class; classes of two tokens or more that half of the host's pages (and two at least) share are
valid. Rows of one host with equal HTML are one page here, so copies alone make no template. Their tags nest by their paths and make up the host's template; texts among them are part of
it. What stands between a template's tags is a slot, named by the innermost template element around
it. Of a page's slots those of the article are its main text: all slots but those that consist of
links, and only those below an article or main element if there is one; never those below menus,
headers, footers, sidebars, notices, adverts, forms or comments. Elements are such by their name, or by
a class, id or role that is a listed word or made of listed words alone ("cookie-notice", not
"has-sidebar"). The names of html, body and headings decide nothing, nor those of paragraphs, of a header
and ids of sections in an article: template and links decide there. A form, header or element of a listed
class around a page's only article is no such element.

Texts below an article or main element are counted like all others, but as that mark speaks for them,
more has to speak against: a class there needs ARTICLE_PAGES pages, or NAMED_PAGES below an element that
has a class, id or role; a block goes only if all its texts are template; a slot of links goes only if
its element belongs to the template; and an article that would go as a whole stays.

An occurrence signature is kept as the exclusive or of a hash of (page, count) over the distinct pages, so
the classes come from aggregations alone, whatever the size of a host.

Defined cases: null and empty HTML gives the empty text; a null address is a host of its own kind;
a host of one page has no template (its elements bound the slots alone); repeated pages are
extracted alike, as if they stood there once; damaged HTML ends open elements where the page ends; other columns are left out; an
empty table gives an empty one. Text is never cut.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batch, shared_dir, stored, tidied
from lodestone.llm.sketch import mixed

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
APART = frozenset("head nav header footer aside form button select dialog menu".split())
APART_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs share sharing social related promo newsletter subscribe popup modal comment comments reply replies respond disqus footer header masthead pagination widget login search".split())
MAIN = frozenset(("article", "main"))
#: What may stand around a whole page, and what stands in the text whatever it is called.
WRAPS, HEADINGS = frozenset(("form", "header")), frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Least number and share of a host's pages for a valid class, its least size, and the template size up to which it is broadcast.
PAGES, SHARE, SIZE, BROADCAST_BYTES = 2, 0.5, 2, 16 << 20
#: Least number of pages for texts in an article: near copies of an article on a small host are no template.
ARTICLE_PAGES, NAMED_PAGES = 5, 3


@lru_cache(1 << 14)
def _element(name: str, attrs: str, inside: bool) -> tuple[str, int, bool]:
    """An element's name in paths, whether it stands apart from the article (2: whatever it holds), whether it is its container."""
    named = [(m[1].lower(), w) for m in _NAMED.finditer(attrs) for w in html.unescape(m[2] or m[3] or m[4] or "").lower().split()] if "=" in attrs else []
    listed = (w for kind, w in named if not (inside and (w == "header" or kind == "id" and name == "section")))
    if name in ("html", "body"):
        apart = 0
    elif name in APART:
        # the heading of an article may stand in a header of its own
        apart = (name != "header" or not inside) and (1 if name in WRAPS else 2)
    else:
        apart = name not in HEADINGS and not (inside and name == "p") and any(map(_is_listed, listed))
    called = name not in ("html", "body") and any(w == "main" for _, w in named)
    return ".".join([name, *(w.replace("/", " ") for _, w in named)]), 0 if called and apart < 2 else int(apart), called or name in MAIN


def _is_listed(word: str) -> bool:
    return word in APART_WORDS or all(w in APART_WORDS for w in re.split("[_-]+", word))


class Page:
    """Texts of a page in order, each with its path; breaks between blocks are None."""

    def __init__(self, source: str):
        self.tags: list[str] = []
        self.texts: list[tuple[str, str, bool, str, bool] | None] = []  # path, text, apart, the path of the article it is in, linked
        # name, path, apart, path of the article, link; apart is 0, -1 or the number of an element that may hold the article
        stack: list[tuple[str, str, int, str, bool]] = [("", "", 0, "", False)]
        outer, holds = [0], [False]  # of these elements: the one around it, whether an article stands in it
        for m in TOKEN.finditer(source):
            kind = m.lastgroup
            if kind == "text":
                _, path, apart, main, link = stack[-1]
                self.texts.append((path, html.unescape(m["text"]), apart, main, link))
                continue
            name = m["name"]
            if name is None:
                if m["raw"]:
                    self.texts.append(None)
                continue
            name = name.lower()
            if name not in INLINE:
                self.texts.append(None)
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                continue
            closes = CLOSES.get(name, ())
            while len(stack) > 1 and (stack[-1][0] in closes or name in ENDS_P and stack[-1][0] == "p"):
                stack.pop()
            if name in ENDS_P:  # an open paragraph ends even below inline elements
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            _, path, apart, main, link = stack[-1]
            element, own, container = _element(name, m["attrs"], bool(main))
            path = f"{path}/{element}"
            self.tags.append(path)
            if name not in VOID and not m["attrs"].endswith("/"):
                if container and not main and apart >= 0:
                    main, at = path, apart
                    while at:
                        holds[at] = True
                        at = outer[at]
                if own == 2 or apart < 0:
                    apart = -1
                elif own:
                    outer.append(apart)
                    holds.append(False)
                    apart = len(outer) - 1
                stack.append((name, path, apart, main, link or name == "a"))
        # elements around an article count only if there is none outside of them
        free = any(x and x[3] and not x[2] and not x[1].isspace() for x in self.texts)
        aside = [False]
        for at, held in zip(outer[1:], holds[1:]):
            aside.append(not held or free or aside[at])
        self.texts = [x and (x[0], x[1], x[2] < 0 or aside[x[2]], x[3], x[4]) for x in self.texts]


def _hash(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


def _token(kind: int, text: str) -> int:
    return int(mixed(np.array([_hash(text) ^ kind << 63], np.uint64))[0] >> np.uint64(1))


def _tag_token(path: str) -> int:
    return _token(0, path)


def _block(path: str) -> str:
    """The innermost element of a path that is not inline."""
    while path and path.rpartition("/")[2].partition(".")[0] in INLINE:
        path = path.rpartition("/")[0]
    return path


def _least(path: str, main: str) -> int:
    """On how many pages a text has to stand for a valid class."""
    return PAGES if not main else NAMED_PAGES if "." in path[len(main) :] else ARTICLE_PAGES


def _text_token(path: str, text: str) -> int:
    return _token(1, path + "\0" + " ".join(text.split()))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


def _occurrences(pages: DataFrame) -> DataFrame:
    """host, token, least (pages for a valid class), signature (hash of content and count): a page's distinct tokens; token 0 stands for the page."""
    schema = pa.schema([("host", pa.string()), ("token", pa.int64()), ("least", pa.int32()), ("signature", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag_token = lru_cache(1 << 16)(_tag_token)
        for b in batches:
            hosts, tokens, leasts, keys, counts = [], [], [], [], []
            for name, source in zip(*(c.to_pylist() for c in b.columns)):
                p = Page(source)
                seen = Counter(map(tag_token, p.tags))
                least = {}
                for x in p.texts:
                    if x and not x[1].isspace():
                        seen[t := _text_token(x[0], x[1])] += 1
                        least[t] = _least(x[0], x[3])
                seen[0] = 1
                key = int.from_bytes(hashlib.blake2b(source.encode("utf-8", "surrogatepass"), digest_size=8).digest())
                hosts += [name] * len(seen)
                tokens += seen.keys()
                leasts += [least.get(t, PAGES) for t in seen]
                counts += seen.values()
                keys += [key] * len(seen)
            signatures = mixed(mixed(np.array(keys, np.uint64)) ^ np.array(counts, np.uint64)).view(np.int64)
            yield batch(schema, [hosts, tokens, leasts, pa.array(signatures)])

    # equal pages of a host give equal rows
    return pages.select("host", "html").mapInArrow(tidied(run), "host string, token long, least int, signature long").distinct()


def deduced(pages: DataFrame) -> DataFrame:
    """host, template: the tokens of each host's valid classes."""
    met = _occurrences(pages).groupBy("host", "token").agg(F.bit_xor("signature").alias("signature"), F.count("*").alias("pages"), F.max("least").alias("least"))
    whole = met.where("token = 0").select("host", F.col("pages").alias("of"))
    frequent = met.where((F.col("token") != 0) & (F.col("pages") >= F.col("least"))).join(whole, "host").where(F.col("pages") >= F.col("of") * SHARE)
    classes = frequent.groupBy("host", "signature", "pages").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= SIZE)
    return classes.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))


def slots(source: str, template: frozenset[int], tag_token=_tag_token) -> list[tuple[str, list[str]]]:
    """The slots of a page's main text in order: the template element they lie in, and their blocks."""
    page = Page(source)
    inner: dict[str, str] = {}

    def slot(path: str) -> str:
        if path not in inner:
            at = path
            while at and template and tag_token(at) not in template:
                at = at.rpartition("/")[0]
            inner[path] = at or path
        return inner[path]

    has_main = any(x and x[3] and not x[2] and not x[1].isspace() for x in page.texts)
    linked: Counter = Counter()
    size: Counter = Counter()
    # which texts are the page's own and not the template's; in an article whole blocks only
    own: list[bool] = []
    known = 0
    for x in [*page.texts, None]:
        if x is None:
            if has_main and any(own[known:]):
                own[known:] = [True] * (len(own) - known)
            own.append(False)
            known = len(own)
            continue
        path, text, apart, main, link = x
        own.append(not apart and not text.isspace() and (not has_main or bool(main)) and not (template and _text_token(path, text) in template))
        if not apart:
            at = slot(_block(path))
            size[at] += len(text.strip())
            linked[at] += len(text.strip()) * link

    def links(path: str, main: str) -> bool:
        """Whether a text's slot consists of links; in an article only elements of the template below it."""
        at = slot(_block(path))
        return 2 * linked[at] > size[at] and (not main or at.startswith(main + "/") and bool(template) and tag_token(at) in template)

    # an article of nothing but what other pages have too is no template
    whole = has_main and not any(mine and x[3] and not x[2] and not links(x[0], x[3]) for x, mine in zip(page.texts, own) if x)
    out: list[tuple[str, list[str]]] = []
    block: list[str] = []
    where = ""

    def end() -> None:
        nonlocal block
        if block and (text := " ".join("".join(block).split())):
            if out and out[-1][0] == where:
                out[-1][1].append(text)
            else:
                out.append((where, [text]))
        block = []

    for x, mine in zip(page.texts, own):
        if x is None:
            end()
            continue
        path, text, apart, main, _ = x
        if apart or has_main and not main:
            continue
        if not whole and not text.isspace() and (not mine or links(path, main)):
            continue
        if not block:
            where = slot(path)
        block.append(text)
    end()
    return out


def extracted(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_slots of df(page_id, url, html)."""
    path = shared_dir(df.sparkSession)
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    templates = stored(deduced(pages), f"{path}/templates")
    held = templates.agg(F.sum(F.size("template") * 8 + F.octet_length("host") + 64)).first()[0] or 0
    joined = pages.join(F.broadcast(templates) if held <= BROADCAST_BYTES else templates, "host", "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_slots", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag_token = lru_cache(1 << 16)(_tag_token)
        known: dict[str, frozenset[int]] = {}
        for b in batches:
            if len(known) > 1000:
                known.clear()
            rows = []
            for page, url, source, name, template in zip(b.column(0), b.column(1), b.column(2), b.column(3), b.column(4)):
                name = name.as_py()
                if name not in known:
                    known[name] = frozenset(template.as_py() or ())
                found = slots(source.as_py(), known[name], tag_token)
                rows.append((page.as_py(), url.as_py(), " ".join(t for _, texts in found for t in texts), len(found)))
            if rows:
                yield batch(schema, list(map(list, zip(*rows))))

    return joined.select("page_id", "url", "html", "host", "template").mapInArrow(tidied(run), "page_id long, url string, text string, n_slots long")
