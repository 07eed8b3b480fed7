"""Main-text extraction with wrappers inferred per host as union-free regular expressions.

A page is a stream of tokens, one a block of text: its path of tags and names from the root, and its text. Streams of one
host are aligned one after another. Equal paths meet; a path that one side lacks becomes optional, one that stands
several times in a page a repeated group, and one whose text differs a text slot. Each path has one place in the
expression (a sibling's first run and its later runs have different ones), so the expression is union-free and
an alignment takes linear time, whatever a page's depth, width or period. An item keeps on how many pages it is, how much
of it is text and links, and how often each of its texts occurs.

A task aligns the pages of its hosts and gives its wrappers as rows, one an item and one a text, which Spark sums by host
and path, or host and text: a host with a third of all pages is counted by many tasks. What a task holds is bounded: items and texts on fewer than one page in ``RARE`` of a host leave its wrapper as rows now and
then, and the rest too beyond ``BLOCKS_HELD`` blocks. Sums do not depend on when rows leave, so that nothing is
forgotten and every count is that of all pages of the host, in whatever order they come.

From the finished wrapper come a host's rules, which decide on every block, inside a marked article as well:

- a text that stands under one path on half of the pages, with at least ``MIN_PAGES`` different main blocks (so that copies
  of one page make no template), is template text and goes;
- an item of the host that is mostly link text goes wherever the block on the page is mostly links. The rules list only items
  whose pages differ in this: for every other item the page alone says what all pages say. Where a host has more than
  ``RULE_PATHS`` of them, a page is sent those of its own paths only;
- the region: marked articles if half of the pages have one, else main elements, else elements named as content;
- tags and roles of menus, headers, footers, sidebars, forms and the like go. Names of elements are evidence only:
  a name counts if all its words are boilerplate words ("ad", "cookie-notice", "post-comments", not "no-sidebar" or
  "share-price"), and all names are void on a host where hardly any text would be left without them.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.llm._common import load, staged

MIN_PAGES, RARE, BLOCKS_HELD, HOSTS_HELD, RULE_PATHS, BROADCAST_BYTES = 4, 100, 100_000, 2_000, 2_000, 4 << 20

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|</?[a-zA-Z](?:[^>]*\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.S)
_WORDS = re.compile(r"[a-z]+")
RAW = frozenset("script style noscript template iframe noembed noframes textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CHROME_TAGS = frozenset("nav footer aside form menu head dialog button select svg canvas object audio video map".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of names of boilerplate elements, and words that may stand beside them.
CHROME_WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar ad ads advert adverts advertisement advertisements banner sponsor sponsored promo promotion cookie "
    "cookies consent notice notices popup modal newsletter subscribe signup social share sharing comment comments disqus replies related breadcrumb "
    "breadcrumbs pagination pager widget widgets toolbar skip legal copyright".split()
)
BESIDE = frozenset("site page main top bottom left right post article entry global primary secondary box block bar container wrapper section area list links inner outer item buttons".split())
STORY_WORDS = frozenset("article post entry story content maincontent articlebody".split())
BESIDE_STORY = frozenset("main body text page single wrapper inner container area".split())
#: Evidence on a block's path.
CHROME, WORDS, ARTICLE, MAIN, STORY, HEAD = 1, 2, 4, 8, 16, 32
CLOSES_P = BLOCK - {"option", "summary", "legend"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}




class Node:
    __slots__ = ("ev", "kids", "sig", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.kids = tag, []
        self.sig, self.ev = _signature(tag, attrs)


@lru_cache(65_536)
def _signature(tag: str, attrs: str) -> tuple[str, int]:
    """Name of an element in paths (digits do not matter) and what its tag, role and names say."""
    got = {k.lower(): html.unescape(a or b or c).lower() for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
    names = [x for x in (got.get("id", ""), *got.get("class", "").split()) if x]
    role, ev = got.get("role", ""), 0
    bare = re.sub(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "=", attrs).lower().split() if attrs else ()
    hidden = tag not in ("html", "body") and ("hidden" in bare or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", ""))
    if tag in CHROME_TAGS or tag in RAW or role in CHROME_ROLES or hidden:
        ev |= CHROME
    if tag == "header":
        ev |= HEAD
    if tag == "article" or role == "article":
        ev |= ARTICLE
    if tag == "main" or role == "main":
        ev |= MAIN
    if tag not in ("html", "body", "article", "main"):
        for name in names:
            parts = frozenset(_WORDS.findall(name))
            if parts & CHROME_WORDS and parts <= CHROME_WORDS | BESIDE:
                ev |= WORDS
            elif parts & STORY_WORDS and parts <= STORY_WORDS | BESIDE_STORY:
                ev |= STORY
    elif tag == "article" and any((w := frozenset(_WORDS.findall(x))) & CHROME_WORDS and w <= CHROME_WORDS | BESIDE for x in names):
        ev = ev & ~ARTICLE | WORDS  # a comment marked up as an article
    return tag + "".join(f".{x}" for x in sorted(re.sub(r"\d+", "0", n) for n in names)) + (f"@{role}" if role else "") + ("!" if hidden else ""), ev


def parse(page: str) -> Node:
    """A lenient element tree: implied ends of p, li, td and the like; unclosed and stray tags are tolerated."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag does not close a block
            else:
                if tag == "p":
                    stack[-1].kids.append(Node("p"))  # a stray end of a paragraph still ends the block before it
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in _SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SAME[tag]:
                    del stack[k:]
                    if tag != "tr":
                        break
                elif stack[k].tag in _SCOPE[tag]:
                    break
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


class Slot(NamedTuple):
    """One block of a page: its path, evidence on it, text, characters of link text, and the hash of path and whole text.

    The hash takes the path without the runs of siblings, as a text may stand before or behind what cuts a run in two.
    """

    path: int
    ev: int
    text: str
    links: int
    mark: int


def slots(root: Node) -> list[Slot]:
    """The blocks of a page in order; scripts, styles and comments are no text. Nesting depth is unbounded."""
    out: list[Slot] = []
    line: list[tuple[str, bool]] = []
    path = kind = ev = 0  # of the text in ``line``; ``kind`` is the path without runs

    def flush() -> None:
        if text := _clean("".join(t for t, _ in line)):
            links = sum(len(_clean(t)) for t, link in line if link)
            out.append(Slot(path, ev, text, links, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), kind)))
        line.clear()

    todo: list = [(root, 0, 0, 0, False)]
    while todo:
        item, at, bare, seen, link = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            path, kind, ev = at, bare, seen
            line.append((item, link))
        elif item.tag == "br":
            line.append((" ", link))
        else:
            if item.tag in BLOCK:
                flush()
                todo.append((None, 0, 0, 0, False))
            runs: dict[str, int] = {}
            last, kids = None, []
            for kid in item.kids:
                if isinstance(kid, str):
                    kids.append((kid, at, bare, seen, link))
                elif kid.tag in RAW or kid.tag not in BLOCK and kid.ev & CHROME:
                    continue
                elif kid.tag in BLOCK:
                    if kid.sig != last:
                        last = kid.sig
                        runs[last] = runs.get(last, -1) + 1
                    # a header inside an article is the article's own
                    more = kid.ev & ~HEAD | (CHROME if kid.ev & HEAD and not seen & ARTICLE else 0)
                    kids.append((kid, xxhash.xxh3_64_intdigest(f"{kid.sig}{min(runs[last], 1)}", at), xxhash.xxh3_64_intdigest(kid.sig, bare), seen | more, link))
                else:
                    kids.append((kid, at, bare, seen | kid.ev & (MAIN | STORY | ARTICLE), link or kid.tag == "a"))
            todo.extend(reversed(kids))
    flush()
    return out


# A wrapper is [pages, pages with a region of each level, items by path], an item
# [evidence, optional, repeated, pages, pages where it is mostly links, characters, link characters, texts], a text
# [pages, main blocks of MIN_PAGES pages at most].
EV, OPT, REP, PAGES, LISTS, CHARS, LINKS, TEXTS = range(8)
LEVELS = (ARTICLE, MAIN, STORY)


def expression(found: list[Slot]) -> list:
    """The wrapper of one page: paths that recur are repeated groups."""
    main = max(found, key=lambda x: (len(x.text), x.mark)).mark if found else 0
    items: dict[int, list] = {}
    for x in found:
        if x.path in items:
            item = items[x.path]
            item[EV] |= x.ev
            item[REP] = 1
            item[CHARS] += len(x.text)
            item[LINKS] += x.links
        else:
            item = items[x.path] = [x.ev, 0, 0, 1, 0, len(x.text), x.links, {}]
        item[TEXTS][x.mark] = [1, [main]]
    for item in items.values():
        item[LISTS] = int(2 * item[LINKS] > item[CHARS])
    have = [int(any(x.ev & level and not x.ev & (CHROME | WORDS) for x in found)) for level in LEVELS]
    return [1, have, items]


def align(a: list, b: list) -> list:
    """The least union-free expression over both; ``a`` is changed and returned."""
    if not b[0]:
        return a
    mine, last = a[2], None
    if mine.keys() != b[2].keys():
        new = b[2].keys() - mine.keys()
        for path in mine.keys() - b[2].keys():
            mine[path][OPT] = 1
        if new:  # a new item stands behind the one it follows
            behind: dict = {}
            for path in b[2]:
                if path in new:
                    behind.setdefault(last, []).append(path)
                else:
                    last = path
            order = [*behind.get(None, ()), *(x for path in mine for x in (path, *behind.get(path, ())))]
            mine = {path: mine[path] if path in mine else [0, int(a[0] > 0), 0, 0, 0, 0, 0, {}] for path in order}
            a[2] = mine
    for path, other in b[2].items():
        item = mine[path]
        for k in (EV, OPT, REP):
            item[k] |= other[k]
        for k in (PAGES, LISTS, CHARS, LINKS):
            item[k] += other[k]
        texts = item[TEXTS]
        for mark, (n, mains) in other[TEXTS].items():
            if mark in texts:
                texts[mark][0] += n
                if len(texts[mark][1]) < MIN_PAGES:
                    texts[mark][1] = sorted({*texts[mark][1], *mains})[:MIN_PAGES]
            else:
                texts[mark] = [n, mains]
    a[0] += b[0]
    a[1] = [x + y for x, y in zip(a[1], b[1], strict=True)]
    return a


def prune(wrapper: list) -> list:
    """Takes items and texts that are on fewer than one page in RARE out of the wrapper; what it took, as a wrapper of no pages."""
    n, rare = wrapper[0], {}
    if n > RARE:
        for path, item in wrapper[2].items():
            if RARE * item[PAGES] < n:
                rare[path] = item
            elif few := {mark: t for mark, t in item[TEXTS].items() if RARE * t[0] < n}:
                item[TEXTS] = {mark: t for mark, t in item[TEXTS].items() if mark not in few}
                rare[path] = [item[EV], item[OPT], item[REP], 0, 0, 0, 0, few]
        wrapper[2] = {path: item for path, item in wrapper[2].items() if RARE * item[PAGES] >= n}
    return [0, [0, 0, 0], rare]


def rules(wrapper: list) -> dict:
    """What a host's wrapper says: the region, whether names are void, template texts, and which of the paths that are
    mostly links on some pages only are so as a whole (links) or not (plain). ``host_rules`` says the same from rows.
    """
    pages, have, items = wrapper
    level = next((x for x, n in zip(LEVELS, have, strict=True) if 2 * n >= max(1, pages)), 0)
    shown = [x for x in items.values() if not x[EV] & CHROME and (not level or x[EV] & level)]
    named = sum(x[CHARS] for x in shown if x[EV] & WORDS)
    texts: dict[int, list] = {}
    for x in items.values():
        for mark, (n, mains) in x[TEXTS].items():
            held = texts.setdefault(mark, [0, set()])
            held[0] += n
            held[1].update(mains)
    const = [mark for mark, (n, mains) in texts.items() if 2 * n >= pages and len(mains) >= MIN_PAGES]
    mixed = {path: 2 * x[LINKS] > x[CHARS] for path, x in items.items() if 0 < x[LISTS] < x[PAGES]}
    void = 10 * (sum(x[CHARS] for x in shown) - named) < named
    return {"level": level, "void": void, "const": sorted(const), "links": sorted(p for p, yes in mixed.items() if yes), "plain": sorted(p for p, yes in mixed.items() if not yes)}


def kept(found: list[Slot], rule: dict) -> list[Slot]:
    """The blocks of a page that the rules of its host leave."""
    out = CHROME if rule["void"] else CHROME | WORDS
    own = [x for x in found if not x.ev & out]
    for level in (rule["level"], *LEVELS):
        if level and any(x.ev & level for x in own):
            own = [x for x in own if x.ev & level]
            break
    own = [x for x in own if x.mark not in rule["const"]]
    if not any(x.links for x in own):
        return own
    more: dict[int, int] = {}  # by path: by how much twice the link text exceeds the text of the page
    for x in found:
        more[x.path] = more.get(x.path, 0) + 2 * x.links - len(x.text)
    lists = {path for path, n in more.items() if path in rule["links"] or n > 0 and path not in rule["plain"]}
    return [x for x in own if not (x.path in lists and 2 * x.links > len(x.text))]


def extract(page: str, rule: dict | None = None) -> str:
    """Blocks of the main text, joined by blank lines; without a rule the page is a host of its own."""
    found = slots(parse(page))
    return "\n\n".join(x.text for x in kept(found, rule or rules(expression(found))))


def _packed(wrapper: list) -> str:
    """A whole wrapper as JSON."""
    return json.dumps([wrapper[0], wrapper[1], [[path, *x[:TEXTS], [[m, *t] for m, t in x[TEXTS].items()]] for path, x in wrapper[2].items()]])


def _unpacked(text: str) -> list:
    pages, have, items = json.loads(text)
    return [pages, have, {path: [*x, {m: [n, mains] for m, n, mains in texts}] for path, *x, texts in items}]


#: Kinds of rows: pages of a host (key 0) and those with a region (key: its level), an item (key: its path), a text (key: its mark).
HOST, ITEM, TEXT = range(3)
_PATHS = ("links", "plain")
_FIELDS = "host string, kind int, key long, ev int, pages long, lists long, chars long, links long, mains array<long>"


def _long(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _rows(wrappers: list[tuple[str, list]]) -> pa.RecordBatch:
    """Wrappers of hosts as rows that Spark can sum."""
    hosts, kinds, keys, counts, mains, ends = [], [], [], [], [], [0]
    for host, (pages, have, items) in wrappers:
        before = len(keys)
        if pages:
            for key, n in zip((0, *LEVELS), (pages, *have), strict=True):
                kinds.append(HOST)
                keys.append(key)
                counts.append((0, n, 0, 0, 0))
                ends.append(len(mains))
        for path, x in items.items():
            if x[PAGES]:
                kinds.append(ITEM)
                keys.append(path)
                counts.append((x[EV], *x[PAGES:TEXTS]))
                ends.append(len(mains))
            for mark, (n, some) in x[TEXTS].items():
                kinds.append(TEXT)
                keys.append(mark)
                counts.append((0, n, 0, 0, 0))
                mains.extend(some)
                ends.append(len(mains))
        hosts.extend([host] * (len(keys) - before))
    numbers = np.array(counts, np.int64).reshape(-1, 5)
    columns = [pa.array(hosts, pa.string()), pa.array(kinds, pa.int32()), _long(keys), pa.array(numbers[:, 0].astype(np.int32))]
    columns += [pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(1, 5)]
    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _long(mains)))
    return pa.RecordBatch.from_arrays(columns, names=["host", "kind", "key", "ev", "pages", "lists", "chars", "links", "mains"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a task -> its wrappers as rows; a host, item or text has one row or several."""
    held: dict[str, list] = {}
    gone: list[tuple[str, list]] = []  # what left the wrappers, which stay small, as alignment visits all their items
    blocks = 0
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found = slots(parse(page))
            mine = expression(found)
            held[host] = align(held[host], mine) if host in held else mine
            blocks += len(found)
            if held[host][0] % RARE == 0:
                gone.append((host, prune(held[host])))
            if blocks > BLOCKS_HELD or len(held) > HOSTS_HELD:
                yield _rows(gone)
                gone.clear()
                blocks = sum(len(x[TEXTS]) for w in held.values() for x in w[2].values())
                if 2 * blocks > BLOCKS_HELD or len(held) > HOSTS_HELD:
                    yield _rows(list(held.items()))
                    held.clear()
                    blocks = 0
    yield _rows([*gone, *held.items()])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (host, page, html) -> (host, page, key): the paths under which a block of the page is mostly links."""
    for batch in batches:
        rows, keys = [], []
        for k, page in enumerate(batch.column("html").to_pylist()):
            paths = {x.path for x in slots(parse(page)) if 2 * x.links > len(x.text)}
            rows.extend([k] * len(paths))
            keys.extend(paths)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("host").take(at), batch.column("page").take(at), _long(keys)], names=["host", "page", "key"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        texts = []
        # a page of a wide host brings the paths that its rule leaves out
        own = zip(*(batch.column(c).to_pylist() for c in _PATHS), strict=True) if _PATHS[0] in batch.schema.names else repeat((None, None), batch.num_rows)
        for page, text, paths in zip(batch.column("html").to_pylist(), batch.column("rule").to_pylist(), own, strict=True):
            if len(known) > HOSTS_HELD:
                known.clear()
            if text not in known:
                rule = json.loads(text)
                known[text] = rule | {k: frozenset(x % (1 << 64) for x in rule[k]) for k in ("const", "links", "plain")}
            more = {k: frozenset(x % (1 << 64) for x in some) for k, some in zip(_PATHS, paths, strict=True) if some}
            texts.append(extract(page, known[text] | more if more else known[text]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: str = "url") -> F.Column:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _said(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(host, level, void)`` and ``(host, key, say)`` of ``pages(host, html)``: what ``rules`` says of the wrapper over all
    pages of a host, one row a text or path that it lists.

    Every count is a sum over all rows. Texts on fewer than ``MIN_PAGES`` pages cannot be template text, and the main blocks
    are counted for the texts on half of the pages only. Hashes are signed here.
    """
    found = staged(pages.mapInArrow(_partial, _FIELDS))
    sums = [F.sum(c).alias(c) for c in ("pages", "lists", "chars", "links")]
    counted = found.groupBy("host", "kind", "key").agg(F.bit_or("ev").alias("ev"), *sums)
    counted = staged(counted.where((F.col("kind") != TEXT) | (F.col("pages") >= MIN_PAGES)))

    def has(bits: int) -> F.Column:
        return F.col("ev").bitwiseAND(F.lit(bits)) != 0

    def total(of: str, where: F.Column) -> F.Column:
        return F.coalesce(F.sum(F.when(where, F.col(of))), F.lit(0))

    def at(name: str) -> F.Column:  # the column of the host's level
        out = F.col(f"{name}0")
        for x in reversed(LEVELS):
            out = F.when(2 * F.col(f"have{x}") >= F.greatest(F.lit(1), F.col("have0")), F.col(f"{name}{x}")).otherwise(out)
        return out

    item = (F.col("kind") == ITEM) & ~has(CHROME)
    sizes = []
    for x in (0, *LEVELS):
        shown = item & has(x) if x else item
        sizes.append(total("pages", (F.col("kind") == HOST) & (F.col("key") == x)).alias(f"have{x}"))
        sizes += [total("chars", shown).alias(f"shown{x}"), total("chars", shown & has(WORDS)).alias(f"named{x}"), F.lit(x).alias(f"level{x}")]
    hosts = counted.where(F.col("kind") != TEXT).groupBy("host").agg(*sizes)
    hosts = hosts.select("host", F.col("have0").alias("all"), at("level").alias("level"), (10 * (at("shown") - at("named")) < at("named")).alias("void"))

    often = counted.where(F.col("kind") == TEXT).join(hosts, "host").where(2 * F.col("pages") >= F.col("all")).select("host", "key")
    mains = found.where(F.col("kind") == TEXT).join(often, ["host", "key"], "left_semi").select("host", "key", F.explode("mains").alias("main"))
    const = mains.distinct().groupBy("host", "key").count().where(F.col("count") >= MIN_PAGES).select("host", "key", F.lit("const").alias("say"))
    mixed = counted.where((F.col("kind") == ITEM) & (F.col("lists") > 0) & (F.col("lists") < F.col("pages")))
    mixed = mixed.select("host", "key", F.when(2 * F.col("links") > F.col("chars"), "links").otherwise("plain").alias("say"))
    return hosts, const.union(mixed)


def _paths_of(say: str) -> F.Column:
    return F.sort_array(F.collect_list(F.when(F.col("say") == say, F.col("key")))).alias(say)


def _as_rules(hosts: DataFrame, said: DataFrame) -> DataFrame:
    names = ("const", *_PATHS)
    whole = hosts.join(said.groupBy("host").agg(*(_paths_of(x) for x in names)), "host", "left")
    empty = F.array().cast("array<long>")
    return whole.select("host", F.to_json(F.struct("level", "void", *(F.coalesce(x, empty).alias(x) for x in names))).alias("rule"))


def host_rules(pages: DataFrame) -> DataFrame:
    """``(host, rule)`` of ``pages(host, html)``: what ``rules`` says of the wrapper over all pages of the host, as JSON."""
    return _as_rules(*_said(pages))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)``, one row for every row of ``pages``.

    Null html counts as empty and gives an empty text; null urls share the host ``""``. Repeated rows each give a row.
    An empty table gives no rows; other columns are ignored, whatever their names. The result does not depend on the
    order of a host's pages.
    """
    slim = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    ).withColumn("host", host_of())
    hosts, said = _said(slim.select("host", "html"))
    said = staged(said)
    mixed = said.where(F.col("say") != "const")
    wide = staged(mixed.groupBy("host").count().where(F.col("count") > RULE_PATHS).select("host"))
    some = not wide.isEmpty()
    if some:
        said = said.where(F.col("say") == "const").union(mixed.join(wide, "host", "left_anti"))
    found = staged(_as_rules(hosts, said))
    size = found.agg(F.sum(F.length("rule") + F.length("host"))).first()[0] or 0
    # the rules of all hosts go to every executor only if they are known to be small; else the join shuffles by host
    side = F.broadcast(found) if size <= BROADCAST_BYTES else found
    kind = slim.schema["page_id"].dataType.simpleString()
    joined = slim.join(side, "host")
    if some:  # equal pages have equal paths, and a path more, should hashes meet, does no harm
        joined = joined.withColumn("page", F.xxhash64("html"))
        own = joined.join(wide, "host", "left_semi").select("host", "page", "html").mapInArrow(_listed, "host string, page long, key long")
        own = own.distinct().join(mixed, ["host", "key"]).groupBy("host", "page").agg(*(_paths_of(x) for x in _PATHS))
        joined = joined.join(own, ["host", "page"], "left")
    joined = joined.select("page_id", "url", "html", "rule", *(_PATHS if some else ()))
    return joined.mapInArrow(_apply, f"page_id {kind}, url string, text string")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    return extract_pages(load(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
