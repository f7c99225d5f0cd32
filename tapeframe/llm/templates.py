"""Main text of web pages by deducing each host's template.

A page is a sequence of tokens: the paths of its elements, and its blocks of text.  A token's
occurrence vector is the list of its counts on the host's pages.  Vectors are never gathered: each is
represented by two sums over pages of 32 bits of a hash of page and count, which add up in parallel
and are equal for equal vectors.  Tokens of a host with equal vectors are an equivalence class.  A
class is valid if its tokens are on at least half of the pages and nest (a path that is not the root
hangs below a path of a valid class); the valid classes, nested by their paths, are the template.

Blocks that belong to the class of what stands once on every page are template text, unless they are
most of the pages' text: then the pages are copies.  What remains are slots, one for each path.  A slot is
peripheral if most of its text is links, or if most of its blocks recur on other pages of a host whose text
does not (adverts and notices from a pool).  The content container is found from the root: while nearly all text
that varies and is not peripheral stands below one child, that child is taken; where a headline, a
paragraph or a larger section stands beside it the way ends.  The main text is what the container's slots hold.

The template knows pages only by their tokens.  Where that leaves a choice, elements whose kind or name
says that they are no content (menus, headers, footers, sidebars, notices, adverts, forms, comments of
readers, scripts, styles) lose it, and an article or main element wins it over what stands beside it.

A host may hold any share of all pages: counting is pre-aggregated in its tasks, and the template,
bounded by about twice the tokens of a mean page, is joined to the pages.  Pages are read one at a time in
Python: no built-in function reads markup.

Defined cases: null html is empty and gives an empty text; pages with a null or strange url share a
host of their own; a host's only page has no template text; a page without the
container is read by its own article or main element, else whole; repeated rows each give a row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm.common import bounded, stored

#: Share of pages of a valid class; share of links, or of recurring text, from which on a slot is peripheral.
SUPPORT, MOST = 0.5, 0.5
#: Share of a host's text up to which constant or recurring blocks are template; beyond it the pages are copies.
TEMPLATE = 0.3
#: Share of the varying text below a child that is taken although other sections stand beside it.
WHOLE = 0.9

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|select|svg|math|object|canvas|noframes|title)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[a-zA-Z/][^>]*\Z""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_CONTENT = frozenset("head nav footer aside form button dialog menu header input optgroup option fieldset".split())
MAIN = frozenset(("article", "main"))
HOLDERS = frozenset("body div section article main center table tbody tr td".split())
#: Start tags that end an open paragraph, and elements that end an open one of their own kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPE = frozenset("ul ol dl table article section div body main aside nav header footer blockquote".split())
_NAMES = re.compile(
    r"(?<![a-z])(ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|side-?bar\w*|footer|masthead|cookies?|cookie-?\w+|consent|notice\w*|notification\w*|alert|"
    r"popup|modal|overlay|newsletter|subscri\w+|comments?|comment-\w+|disqus\w*|respond|repl(?:y|ies)|social|shar(?:e|ing)|related|recommend\w*|widget\w*|toolbar|pagination|pager|login|signup|search|copyright|disclaimer|skip-?link|gdpr|paywall)(?![a-z])"
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


def hidden(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element's own marks say that it is no content."""
    if name in ("html", "body") or name in MAIN:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role") in _ROLES:
        return True
    names = re.sub(r"\b(?:has|with|no|without)-[\w-]+", "", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
    return bool(_NAMES.search(names.replace("_", "-")))


_label_cache: dict[tuple[str, str], tuple[str, bool, bool]] = {}


def label(name: str, raw: str) -> tuple[str, bool, bool]:
    """(element name with its class, no content, main) of a start tag."""
    key = (name, raw)
    out = _label_cache.get(key)
    if out is None:
        attributes: dict[str, str] = {}
        for k, v in _ATTRIBUTE.findall(raw):
            attributes.setdefault(k.lower(), entities.unescape(v.strip("\"'")).strip())
        mark = attributes.get("class", "").split()
        main = name in MAIN or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody"
        out = (name + ("." + re.sub(r"[^\w.-]", "", ".".join(mark)) if mark else ""), hidden(name, {k: v.lower() for k, v in attributes.items()}), main)
        if len(_label_cache) < 100_000:
            _label_cache[key] = out
    return out


class Block:
    """Text between block boundaries: where it stands, and the part of it that is links."""

    __slots__ = ("path", "text", "links", "content", "main")

    def __init__(self, path: str, text: str, links: int, content: bool, main: bool) -> None:
        self.path, self.text, self.links, self.content, self.main = path, text, links, content, main


def blocks(page: str | None) -> tuple[list[Block], dict[str, int]]:
    """(blocks of text in page order, how often each element path occurs)."""
    out: list[Block] = []
    counts: dict[str, int] = {}
    stack: list[tuple[str, str, bool, bool]] = [("", "", True, False)]  # name, path, content, main
    parts: list[str] = []
    link_from, links = -1, 0

    def close() -> None:
        nonlocal links, link_from
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                _, path, content, main = stack[-1]
                if link_from >= 0:
                    links += sum(map(len, parts[link_from:]))
                out.append(Block(path, text, min(links, len(text)), content, main))
            parts.clear()
        links, link_from = 0, 0 if link_from >= 0 else -1

    at = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if m[2] or m[5]:
            if name == "a" and link_from >= 0:
                links += sum(map(len, parts[link_from:]))
                link_from = -1
            if name in INLINE:
                continue
            close()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        raw = m[4] if m[3] else m[7]
        if name in INLINE:
            if name == "a":
                link_from = len(parts)
            own, no_content, main = label(name, raw)
            if not no_content or name not in ("span", "a", "small", "label"):
                continue
        elif name == "br":
            parts.append(" ")
            continue
        elif name in VOID:
            if name == "hr":
                close()
            continue
        else:
            own, no_content, main = label(name, raw)
        close()
        if name in ENDS_P or name in SIBLINGS:
            ends = SIBLINGS.get(name, ()) + (("p",) if name in ENDS_P else ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
        _, path, content, in_main = stack[-1]
        path = f"{path}/{own}"
        content = content and not no_content and (name not in NO_CONTENT or (name == "header" and in_main))
        counts[path] = counts.get(path, 0) + 1
        if raw.endswith("/") and name not in ("p", "div", "li"):
            continue
        stack.append((name, path, content, in_main or main))
    if at < len(page):
        parts.append(page[at:])
    close()
    return out, counts


def _host(url: str) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.col(url), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")), F.lit(""))


# Occurrence vectors

TOKENS = "host string, token string, block boolean, path string, pages long, s1 long, s2 long, chars long, links long, low int, high int"
_TOKENS = pa.schema([("host", pa.string()), ("token", pa.string()), ("block", pa.bool_()), ("path", pa.string()), ("pages", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def block_token(b: Block) -> str:
    return xxhash.xxh64_hexdigest(f"{b.path}\0{b.text}", 1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each host with the sums over this batch's pages."""
    for batch in batches:
        sums: dict[tuple[str, str, bool], list] = {}
        for host, key, page in zip(batch.column("host").to_pylist(), batch.column("key").to_pylist(), batch.column("html")):
            found, counts = blocks(page.as_py())
            own: dict[tuple[str, bool], list] = {(p, False): [None, n, 0, 0] for p, n in counts.items()}
            own["", False] = [None, 1, 0, 0]
            for b in found:
                if b.content:
                    for e in (own.setdefault((b.path, False), [None, 1, 0, 0]), t := own.setdefault((block_token(b), True), [b.path, 0, 0, 0])):
                        e[2] += len(b.text)
                        e[3] += b.links
                    t[1] += 1
            for (token, kind), (path, n, chars, links) in own.items():
                h = xxhash.xxh64_intdigest(f"{key} {n}", 2)
                e = sums.setdefault((host, token, kind), [path, 0, 0, 0, 0, 0, n, n])
                for i, x in enumerate((1, h & 0xFFFFFFFF, h >> 32, chars, links), 1):
                    e[i] += x
                e[6], e[7] = min(e[6], n), max(e[7], n)
        rows = [(*k, *v) for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_TOKENS)], schema=_TOKENS)


def equivalence_classes(rows: list[dict]) -> list[list[dict]]:
    """Tokens of one host with equal occurrence vectors; the most frequent class first, each in the order of paths."""
    found: dict[tuple, list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["token"]):
        found.setdefault((r["pages"], r["s1"], r["s2"]), []).append(r)
    return sorted(found.values(), key=lambda c: (-c[0]["pages"], c[0]["token"]))


def nested(classes: list[list[dict]]) -> list[list[dict]]:
    """The classes whose paths all hang below paths of valid classes."""
    valid, paths = [], {""}
    waiting = classes
    while True:
        later = []
        for c in waiting:
            own = {r["token"] for r in c if not r["block"]}
            if all(p.rpartition("/")[0] in paths | own for p in own):
                valid.append(c)
                paths |= own
            else:
                later.append(c)
        if len(later) == len(waiting):
            return valid
        waiting = later


def holds(path: str) -> bool:
    """Whether a path's last element is of a kind that holds sections, not text itself."""
    return path.rpartition("/")[2].partition(".")[0] in HOLDERS | {"html"}


def container(paths: dict[str, int]) -> str:
    """The content container among template paths with their varying text that is not peripheral."""
    below: dict[str, int] = dict.fromkeys(paths, 0)
    children: dict[str, list[str]] = {}
    for p, chars in paths.items():
        at = p
        while True:
            if at in below:
                below[at] += chars
            if not at:
                break
            at = at.rpartition("/")[0]
    for p in paths:
        if p and below[p]:
            children.setdefault(p.rpartition("/")[0], []).append(p)
    at, in_main = "", False
    while children.get(at):
        best = max(children[at], key=lambda p: (below[p], p))
        main = [p for p in children[at] if re.match(r"(article|main)\b", p.rpartition("/")[2])]
        others = [p for p in children[at] if p != best]
        beside = any(not holds(p) for p in others) or paths[at]
        if holds(best) and not beside and below[best] >= WHOLE * below[at]:
            at = best
        elif not in_main and len(main) == 1 and main[0] == best:
            at = best
        else:
            return at
        in_main = in_main or at in main
    return at


def template(table: pa.Table) -> pa.Table:
    """One host's template from its tokens; rows without a kind tell how much of a path's text recurs."""
    every = table.to_pylist()
    rows, again = [r for r in every if r["block"] is not None], {r["token"]: r["chars"] for r in every if r["block"] is None}
    host, total = every[0]["host"], next((r["pages"] for r in rows if r["token"] == "" and not r["block"]), 0)
    valid = nested(equivalence_classes(rows))
    once = [r for c in valid for r in c if r["block"] and r["pages"] == total and r["low"] == r["high"] == 1]
    paths = {r["token"]: (r["chars"], r["links"]) for c in valid for r in c if not r["block"]}
    text = sum(chars for chars, _ in paths.values())
    constant = once if sum(r["chars"] for r in once) <= TEMPLATE * text else []
    fixed: dict[str, int] = {}
    for r in constant:
        fixed[r["path"]] = fixed.get(r["path"], 0) + r["chars"]
    varying = {p: chars - fixed.get(p, 0) for p, (chars, _) in paths.items()}
    recurring = {p: again.get(p, 0) - fixed.get(p, 0) for p in paths}
    several = sum(recurring.values()) <= TEMPLATE * sum(varying.values())
    peripheral = [p for p, (chars, links) in paths.items() if chars and (links > MOST * chars or (several and recurring[p] > MOST * varying[p]))]
    main = container({p: 0 if p in set(peripheral) else n for p, n in varying.items()})
    shown = "\n".join(f"{i}: {r['token']}" for i, c in enumerate(valid) for r in c if not r["block"])
    return pa.Table.from_pylist([{"host": host, "container": main, "constant": [r["token"] for r in constant], "peripheral": peripheral, "template": shown}], schema=_TEMPLATE)


_TEMPLATE = pa.schema([("host", pa.string()), ("container", pa.string()), ("constant", pa.list_(pa.string())), ("peripheral", pa.list_(pa.string())), ("template", pa.string())])


def templates(spark: SparkSession, pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, container, constant, peripheral, template) for every host."""
    rows = pages.select(_host(url).alias("host"), F.xxhash64(F.col(url), F.col(html)).alias("key"), F.col(html).cast("string").alias("html"))
    sums = rows.mapInArrow(_vectors, TOKENS).groupBy("host", "token", "block").agg(F.max("path").alias("path"), *(F.sum(c).alias(c) for c in ("pages", "s1", "s2", "chars", "links")), F.min("low").alias("low"), F.max("high").alias("high"))
    sums = stored(spark, sums, "tokens")
    total = stored(spark, rows.groupBy("host").agg(F.count("*").alias("total")), "hosts")
    # Only what can belong to a valid class comes together: at most 1 / SUPPORT of the mean page's tokens.  It is
    # stored first, so that the join is not laid out for the grouping by host and Spark may split a large host.
    block = F.col("block") & (F.col("pages") == F.col("total")) & (F.col("total") > 1)
    often = stored(spark, sums.join(total, "host").where((F.col("pages") >= SUPPORT * F.col("total")) & (~F.col("block") | block)).drop("total"), "often")
    again = sums.where("block and pages > 1").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    valid = often.where("not block").select("host", F.col("token").alias("path"))
    nulls = [F.lit(None).cast(often.schema[c].dataType).alias(c) for c in ("block", "path", "pages", "s1", "s2", "links", "low", "high")]
    again = again.join(valid, ["host", "path"]).select("host", F.col("path").alias("token"), "chars", *nulls)
    every = often.unionByName(again).select(*often.columns)
    return stored(spark, every.groupBy("host").applyInArrow(template, "host string, container string, constant array<string>, peripheral array<string>, template string"), "templates")


def main_text(found: list[Block], container: str, constant: set[str], peripheral: set[str]) -> str:
    """The blocks in the main slots, joined."""
    content = [b for b in found if b.content]
    own = [b for b in content if b.path == container or b.path.startswith(container + "/")] if container else []
    if not own:
        own = [b for b in content if b.main] or content
    return " ".join(b.text for b in own if not (constant and block_token(b) in constant) and b.path not in peripheral)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for batch in batches:
        out = []
        hosts: dict[str, tuple] = {}
        column = {c: batch.column(c) for c in batch.schema.names}
        for i, host in enumerate(column["host"].to_pylist()):
            if host not in hosts:
                hosts[host] = (column["container"][i].as_py() or "", set(column["constant"][i].as_py() or ()), set(column["peripheral"][i].as_py() or ()))
            out.append(main_text(blocks(column["html"][i].as_py())[0], *hosts[host]))
        yield pa.RecordBatch.from_arrays([column["page_id"], column["url"], pa.array(out, pa.string())], schema=schema)


def extract(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    bounded(spark)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), _host(url).alias("host"), F.col(html).cast("string").alias("html"))
    joined = rows.join(templates(spark, pages, url, html).select("host", "container", "constant", "peripheral"), "host", "left")
    return joined.select("page_id", "url", "host", "html", "container", "constant", "peripheral").mapInArrow(_extract, "page_id long, url string, text string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
