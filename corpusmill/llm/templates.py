"""Main text of web pages by equivalence-class template deduction.

Pages of a host come out of one template filled with data, so the template's
tokens occur together.  Steps:

1. **Tokens.**  A page is read as tags and texts.  A token is a tag with the path of
   block elements around it (so that the ``<a>`` of a menu and of an article are two
   tokens; numbers in ids and classes are not told apart), or a whole text with its
   path.
2. **Equivalence classes.**  A token's *occurrence vector* holds its count on every
   page of the host.  Tokens with equal vectors form a class.  Vectors are compared
   by the number of pages, the number of occurrences and two keyed sums over the
   pages, which add up in partial aggregates; no task ever holds a host's pages.
3. **Template.**  Large and frequent classes (of ``LEAST`` tokens, on ``SUPPORT`` of the
   host's pages, two at least; the root class, that of the page itself, in any size) are
   template; the tokens of a class are ordered by their mean place.  Texts belong to the
   template only where they occur as the host's root class does: on every one of
   ``TEXT_PAGES`` pages or more.  An element of a class whose texts are all links is a
   *menu*.
4. **Nesting.**  On every page the occurrences of the classes are matched as brackets:
   an occurrence begins with the first token of its class, goes on in their order and
   lies as a whole between two tokens of the class around it.  A class that is out of
   order on a page, or that crosses another one on more pages (as many: one that began
   earlier), is not valid there and its texts stay.
5. **Slots.**  What stands between two tokens of an occurrence is a slot, named by the
   classes open there from the outermost in and how many tokens of each have gone by; a slot
   lies in the elements that are open around it.  Slots in menus, headers, footers,
   sidebars, notices, adverts, forms, scripts, styles and comments (by element, role,
   or words of class and id) and template texts go; if the page has an article or
   main element, so does what lies outside.  All other slots are the main text.

Blocks are what block elements enclose; ``<br>`` is white space.  Character
references are decoded as HTML5 says, white space of any kind inside a block becomes
one space, empty blocks vanish, blocks are joined by a newline in page order.

Scale: two narrow passes over the pages and one aggregate over (host, token) with
partial sums made in the tasks; per host at most ``1 / SUPPORT`` times its mean
number of tokens remain.  The template table is written and joined by host; pages
are shuffled only if it is too large to broadcast by the session's own limit, and
that join can split a hot host.

Defined cases: null or empty html gives the empty text; a null or unreadable url is
one host of its own (the empty name); a host's only page has no template and is read
by its own tags; cut-off and unbalanced markup ends where the page ends; repeated
rows each give their row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release
from .common import cut, read

#: Share of a host's pages that a template class is on; tokens that it has at least; pages from which on constant
#: texts are template; share of a menu's words that are links; (host, token) sums held in a task before they are passed on.
SUPPORT, LEAST, TEXT_PAGES, LINKS, HELD = 0.5, 3, 10, 0.95, 50_000

# Elements without content, elements inside a line, and elements that hold no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var".split())
AWAY = frozenset("head title nav menu header footer aside form script style noscript template button select option textarea "
                 "iframe object svg canvas audio video dialog".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: ARIA roles, and words of class and id, that mark the same parts.
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie "
                  "cookies consent gdpr notice notices notification alert popup modal overlay sidebar menu nav navbar "
                  "navigation breadcrumb breadcrumbs header masthead footer copyright comment comments commentlist disqus "
                  "reply replies respond discussion share sharing social related recommended recommendations newsletter "
                  "subscribe subscription signup login widget widgets pagination pager toolbar".split())
#: An opening tag that ends open elements of these kinds (up to the nearest list, table or block).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table tbody thead select article main section div body".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S)
ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Mark(NamedTuple):
    """What a tag's attributes say."""
    label: str      # the token's name: element, id and classes with numbers blanked
    away: bool      # holds no main text, whatever is in it
    hinted: bool    # the same, by words of class or id only


@lru_cache(maxsize=20_000)
def mark(name: str, attrs: str) -> Mark:
    found = {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in ATTR.finditer(attrs)}
    names = sorted(set(re.sub(r"\d+", "#", found.get("class", "")).split())) + [re.sub(r"\d+", "#", found.get("id", ""))]
    words = {w.lower() for n in names for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", n)}
    away = (name in AWAY or found.get("role", "").lower() in ROLES or "hidden" in found
            or found.get("aria-hidden", "").lower() == "true")
    page = name in ("html", "body") or name in ("article", "main") and not words & {"comment", "comments", "reply"}
    return Mark(f"<{name} {' '.join(names)}".rstrip(), away, bool(words & HINTS) and not page)


class Open(NamedTuple):
    name: str
    key: int        # the path down to this element
    mark: Mark
    number: int     # which element of the page it is


class Piece(NamedTuple):
    """One token of a page."""
    key: int
    text: str | None    # of a text: as it stands in the page
    block: int          # number of the block that a text lies in
    around: tuple       # of a text: the open elements
    link: bool


def _key(path: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, path & (1 << 64) - 1) - (1 << 63)


def pieces(html: str) -> list[Piece]:
    """The tokens of a page in order.  Closing tags that match nothing are passed over."""
    out: list[Piece] = []
    stack: list[Open] = []
    block = number = links = 0
    around: tuple = ()
    at, size = 0, len(html)

    def path() -> int:
        return next((o.key for o in reversed(stack) if o.name not in INLINE), 0)

    def shut(depth: int) -> None:
        nonlocal links, block
        for o in stack[depth:]:
            links -= o.name == "a"
            block += o.name not in INLINE
        del stack[depth:]

    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        kind = m.lastgroup
        if kind == "text":
            text = m.group("text")
            if not text.isspace():
                if not around and stack:
                    around = tuple(stack)
                out.append(Piece(_key(path(), " ".join(text.split())), text, block, around, links > 0))
            else:
                out.append(Piece(0, text, block, around or tuple(stack), links > 0))
            continue
        if kind is None:
            continue
        if kind == "close":
            name = m.group("close").lower()
            depth = len(stack) - 1
            while depth >= 0 and stack[depth].name != name:
                if name in INLINE and stack[depth].name not in INLINE:
                    depth = -1
                    break
                depth -= 1
            if depth >= 0:
                key = stack[depth].key
                shut(depth)
                around = ()
                out.append(Piece(_key(key, "/"), None, block, (), False))
            continue
        name = m.group("open").lower()
        said = mark(name, m.group("attrs") or "")
        if name == "br":
            out.append(Piece(0, " ", block, around or tuple(stack), links > 0))
            continue
        if name not in INLINE:
            block += 1
            ends = ENDS.get(name, ())
            depth = len(stack)
            for d in range(len(stack) - 1, -1, -1):
                if stack[d].name == "p" and name not in VOID or stack[d].name in ends:
                    depth = d
                if stack[d].name in FENCE:
                    break
            shut(depth)
        key = _key(path(), said.label)
        out.append(Piece(key, None, block, (), False))
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            at = end.start() if end else size
        if name not in VOID and not (m.group("attrs") or "").endswith("/"):
            stack.append(Open(name, key, said, number))
            number += 1
            links += name == "a"
        around = ()
    return out


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m.group(1).lower() if m else ""


#: What is summed for every (host, token): pages, occurrences, two keyed sums of the vector, places, words, linked words.
SUMS = ["pages", "times", "sum1", "sum2", "place", "words", "linked"]
#: The token that stands for the page itself; its vector is that of the root class.
ROOT = 0


def page_counts(html: str, salt: bytes) -> dict[tuple[int, bool], list[int]]:
    """(token, whether it is a text) -> the page's part of SUMS."""
    found: dict[tuple[int, bool], list[int]] = {(ROOT, False): [1, 1, 0, 0, 0, 0, 0]}
    for place, p in enumerate(pieces(html)):
        if not p.key:
            continue
        row = found.setdefault((p.key, p.text is not None), [1, 0, 0, 0, place, 0, 0])
        row[1] += 1
        if p.text is not None:
            words = len(p.text.split())
            for o in p.around:
                if (o.key, False) in found:
                    held = found[(o.key, False)]
                    held[5] += words
                    held[6] += words * p.link
    for row in found.values():
        h = xxhash.xxh64_intdigest(salt, row[1])
        row[2], row[3] = h & 0x7FFFFFFF, h >> 33
    return found


def token_sums(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, token, is_text, *SUMS): partial sums made in the tasks, then one aggregate."""

    def work(batches):
        names = ["host", "token", "is_text", *SUMS]
        kinds = [pa.string(), pa.int64(), pa.bool_()] + [pa.int64()] * len(SUMS)

        def flush(held):
            columns = list(zip(*[(h, t, k, *row) for (h, t, k), row in held.items()]))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

        held: dict[tuple, list[int]] = {}
        for b in batches:
            for url, html in zip(b.column(0), b.column(1)):
                html, host = html.as_py(), _host(url.as_py())
                if not html:
                    continue
                salt = xxhash.xxh128_digest(f"{url.as_py()}\n{html}".encode("utf-8", "surrogatepass"))
                for key, row in page_counts(html, salt).items():
                    old = held.get((host, *key))
                    if old is None:
                        held[(host, *key)] = row
                    else:
                        for i, x in enumerate(row):
                            old[i] += x
                if len(held) > HELD:
                    yield flush(held)
                    held = {}
        if held:
            yield flush(held)

    src = pages.select(F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = "host string, token long, is_text boolean, " + ", ".join(f"{c} long" for c in SUMS)
    sums = src.mapInArrow(work, schema).groupBy("host", "token", "is_text").agg(*[F.sum(c).alias(c) for c in SUMS])
    # texts that stand on one page only are no template, whatever follows
    return sums.where((F.col("pages") >= 2) | (F.col("token") == ROOT))


def templates(sums: DataFrame) -> DataFrame:
    """(host, tokens): the tokens of every host's large and frequent classes, by their mean places.

    A token has its class (a number of the host), on how many pages that is, whether it is the root class, whether
    the token is a text, and whether it opens a menu.
    """
    vector = ["pages", "times", "sum1", "sum2"]
    root = (sums.where((F.col("token") == ROOT) & ~F.col("is_text"))
            .select(F.col("host").alias("root_host"), *[F.col(c).alias(f"root_{c}") for c in vector]))
    as_root = F.lit(True)
    for c in vector:
        as_root = as_root & (F.col(c) == F.col(f"root_{c}"))
    often = sums.where((F.col("pages") >= 2) & (F.col("token") != ROOT))
    kept = (often.join(root, F.col("host") == F.col("root_host")).withColumn("as_root", as_root)
            .where(F.when(F.col("is_text"), F.col("as_root") & (F.col("pages") >= TEXT_PAGES))
                   .otherwise(F.col("pages") >= F.col("root_pages") * SUPPORT)))
    token = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", "is_text",
                     F.xxhash64(*vector).alias("kind"), "pages", "as_root",
                     ((F.col("words") > 0) & (F.col("linked") >= F.col("words") * LINKS)
                      & (F.col("times") == F.col("pages"))).alias("menu"))
    classes = kept.groupBy("host", "as_root", *vector).agg(F.collect_list(token).alias("tokens"))
    classes = classes.where(F.col("as_root") | (F.size("tokens") >= LEAST))
    return classes.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("tokens")) \
        .withColumnRenamed("host", "of_host")


class Template:
    """A host's template, ready to be matched against its pages."""

    def __init__(self, tokens):
        self.size: dict[int, int] = {}
        self.pages: dict[int, int] = {}
        self.step: dict[int, tuple[int, int]] = {}      # token -> its class and its place in there
        self.texts = {t["token"] for t in tokens if t["is_text"]}
        self.menus = {t["token"] for t in tokens if t["menu"] and not t["is_text"]}
        for t in tokens:
            at = self.size.setdefault(t["kind"], 0)
            self.step[t["token"]] = t["kind"], at
            self.size[t["kind"]] = at + 1
            self.pages[t["kind"]] = t["pages"]

    def nest(self, page: list[Piece]) -> tuple[set[int], list[tuple]]:
        """(the classes that are in order and nested on this page, the slot that every piece stands in or ends).

        One pass with a stack of the open occurrences [class, tokens gone by].
        """
        met: set[int] = set()
        bad: set[int] = set()
        stack: list[list[int]] = []
        slot: tuple = ()
        places = []
        for p in page:
            places.append(slot)
            kind, at = self.step.get(p.key, (None, 0))
            if kind is None or kind in bad:
                continue
            met.add(kind)
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == kind), -1)
            inner = stack[depth + 1:] if depth >= 0 else []
            if (stack[depth][1] if depth >= 0 else 0) != at or any(self.pages[k] > self.pages[kind] for k, _ in inner):
                bad.add(kind)       # out of order, or it would cut a class of more pages
                stack = [s for s in stack if s[0] != kind]
            else:
                if depth < 0:
                    stack.append([kind, 0])
                else:
                    bad.update(k for k, _ in inner)
                    del stack[depth + 1:]
                stack[-1][1] += 1
                if stack[-1][1] == self.size[kind]:
                    stack.pop()
            slot = tuple([(k, n) for k, n in stack])
        bad.update(k for k, _ in stack)
        if bad:
            places = [tuple([s for s in x if s[0] not in bad]) for x in places]
        return met - bad, places


NOTHING = Template([])


def slots(html: str, template: Template = NOTHING) -> list[tuple[tuple, int, str]]:
    """(slot, block, text) of the page's main text; a slot is ((class, tokens of it gone by), ...) from the outermost class in."""
    page = pieces(html)
    good, places = template.nest(page)
    texts = {k for k in template.texts if template.step[k][0] in good}
    menus = {k for k in template.menus if template.step[k][0] in good}
    holders = [o for p in page if p.text is not None and p.key for o in p.around if o.name in ("article", "main")]

    def away(around: tuple, hints: bool) -> bool:
        return any(o.mark.away or (hints and o.mark.hinted) for o in around)

    # a hint on an element around the only article is not heeded
    tops = [p.around for p in page if p.key and p.text is not None and any(o.name in ("article", "main") for o in p.around)]
    hints = not tops or any(not away(a, True) for a in tops)
    inside = any(not away(a, hints) for a in tops) if holders else False
    out = []
    for p, slot in zip(page, places):
        if p.text is None:
            continue
        if away(p.around, hints) or inside and not any(o.name in ("article", "main") for o in p.around):
            continue
        if p.key in texts:
            continue
        if not inside and any(o.key in menus for o in p.around if o.name not in ("html", "body")):
            continue
        out.append((slot, p.block, p.text))
    return out


def main_text(html: str | None, template: Template = NOTHING) -> str:
    """The page's main text: its blocks, one a line."""
    if not html:
        return ""
    blocks: dict[int, list[str]] = {}
    for _, block, text in slots(html, template):
        blocks.setdefault(block, []).append(unescape(text) if "&" in text else text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join([line for line in lines if line])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, host, text, n_template) per row: the main text, and how many tokens the host's template has."""
    sums = cut(token_sums(pages, url_col, html_col), "tokens")     # read twice below
    found = cut(templates(sums), "templates")
    release(sums)
    host = F.regexp_extract(F.col("url"), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    src = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                       F.col(f"`{html_col}`").cast("string").alias("html"))
    src = src.withColumn("host", F.lower(F.coalesce(host, F.lit(""))))
    joined = src.join(found, F.col("host") == F.col("of_host"), "left").drop("of_host")

    def work(batches):
        known: dict[str, Template] = {}
        for b in batches:
            texts, sizes = [], []
            for html, host, tokens in zip(b.column(2), b.column(3), b.column(4)):
                name = host.as_py()
                if name not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[name] = Template(tokens.as_py()) if tokens.is_valid else NOTHING
                texts.append(main_text(html.as_py(), known[name]))
                sizes.append(len(known[name].step))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(texts, pa.string()),
                                              pa.array(sizes, pa.int32())], ["id", "url", "host", "text", "n_template"])

    kind = dict(src.dtypes)["id"]
    return joined.mapInArrow(work, f"id {kind}, url string, host string, text string, n_template int")


def query(spark, sf_dir: str) -> DataFrame:
    done = extract(read(spark, sf_dir, "pages"))
    return done.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


#: For pages whose article stands in an article element with h1, p, b and br inside, as the given table's do.
ORACLE = r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS body FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '</?(p|h1)>', chr(10), 'g'), '<br>|</?b>', ' ', 'g'),
    chr(10)), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
      '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS lines
  FROM article),
texts AS (SELECT page_id, url, array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""
