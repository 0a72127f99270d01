"""Main text of web pages by equivalence classes of tokens across the pages of a host.

A token is a tag or a text node together with its path of block elements. Its occurrence vector holds its count on
every page of the host; tokens with equal vectors form a class. Vectors are never built: a sum of hashes of (page,
count) stands for each, so a host with any number of pages is summed before the shuffle and never gathered.

A class is valid if it has several tokens and covers nearly all pages of the host. The class whose tokens occur once
per page is the root of the template; its text nodes are constant and dropped. The other valid classes repeat within
a page and are nested under the deepest root tag whose path leads to all their tokens. What is left between template
tokens are the slots. A nested class or slot made up of links is a menu. All remaining slots are the text, whatever
their share of it: hosts have pages of several layouts, and a page its text in several elements.

Article and main elements are evidence among the slots of a page. If one such element outside furniture holds text, its
slots are the text. Several of them (stories, but also teasers) are it only if they hold at least half of what the
slots hold; else all slots stay. Where every slot of such an element is one of links, the links are its text.

Elements and attribute words that name page furniture are left out on every page, so that a host with too few pages for
a template still gives its text. A word counts as a whole token of class, id or role, and never on html, body, article
or main. A form or a named element is a frame and not furniture if the template shows nearly all varying text of the
host inside, if it holds main (a form: or article), or if nearly all text of a page is inside (unless it is a form:
with an article or h1).

Cases: null or empty html gives empty text. A null url is a host of its own name, "". Unclosed and stray tags are
tolerated. Elements nest to any depth; those deeper than PATH_DEPTH share the path of the one at that depth, so a
template does not tell them apart, but each opens, closes and is furniture on its own. Copies of a page on a host are counted once, so they do not change a class. Other columns are not read.
"""

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import stage, stage_counted

# Words of class, id and role that a path spells out, and levels that it tells apart.
LABEL_WORDS = 3
PATH_DEPTH = 400
MIN_PAGES = 5
MIN_TOKENS = 3
COVERAGE = 0.95
# Share of the varying, unlinked text from which on an element is the frame of a page.
FRAME_SHARE = 0.9
# Templates of up to so many hosts are sent to every task; more are joined by shuffle.
BROADCAST_HOSTS = 50_000
# So many (host, hash) pairs of repeated pages are sent to every task; more are joined by shuffle.
BROADCAST_COPIES = 200_000

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr br".split()
)
RAW = set("script style textarea title noscript template iframe svg math object select".split())
FURNITURE = set("nav footer aside button menu".split())
FORM = ("form", "fieldset")
MAIN = ("article", "main")
NEVER_FURNITURE = ("html", "body", *MAIN)
# Words of class, id and role that name page furniture.
FURNITURE_WORDS = set(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies dialog disqus footer gdpr menu modal nav navbar navigation newsletter notice "
    "notification pagination popup promo promoted recommended related replies reply respond search share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I | re.S)
_SPLIT = re.compile(r"[^a-z]+")


class _Element:
    __slots__ = ("tag", "path", "above", "firm", "own", "furniture", "main", "depth")

    def __init__(self, tag: str, path: str, above: "_Element | None", firm: bool, own: bool, main: "_Element | bool | None"):
        self.tag, self.path, self.above, self.depth = tag, path, above, above.depth + 1 if above else 0
        # Furniture by element name, also inherited; named furniture, which may turn out to be a frame; either, inherited.
        self.firm, self.own, self.furniture = firm, own, firm or own or (above is not None and above.furniture)
        # The outermost article or main element around this one.
        self.main = self if main is True else main

    def named(self) -> "Iterator[_Element]":
        """Named furniture around the element, itself included."""
        at: _Element | None = self
        while at is not None and at.furniture:
            if at.own:
                yield at
            at = at.above


def _open(tag: str, attributes: str, above: _Element) -> _Element:
    named = {k.lower(): v.strip("\"'").lower() for k, v in _NAMES.findall(attributes)} if "=" in attributes else {}
    words = {w for v in named.values() for w in _SPLIT.split(v)}
    is_main = tag in MAIN or named.get("role") == "main"
    # Inside an article a header holds its headline.
    firm = above.firm or tag in FURNITURE or (tag == "header" and not above.main)
    own = tag in FORM or tag == "dialog" or any(w in FURNITURE_WORDS for v in named.values() for w in v.split())
    named_by = sorted(w for w in words if w)
    if len(named_by) > LABEL_WORDS:  # the others are told apart by their hash, which keeps paths short
        named_by[LABEL_WORDS:] = [xxhash.xxh3_64_hexdigest(" ".join(named_by).encode("utf-8", "surrogatepass"))]
    path = f"{above.path}>{'.'.join([tag, *named_by])}" if above.depth < PATH_DEPTH else above.path
    own = own and not is_main and tag not in NEVER_FURNITURE
    return _Element(tag, path, above, firm, own, above.main or is_main or None)


def walk(page: str) -> Iterator[tuple[str, _Element, str, bool]]:
    """("tag", element, "", False) and ("text", element, raw text, inside a link) of a page; ("break", ...) ends a block."""
    root = _Element("", "", None, False, False, None)
    stack = [root]
    at = links = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        begin = m.start() if m else len(page)
        if begin > at:
            yield "text", stack[-1], page[at:begin], links > 0
        if not m:
            return
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if closing else 1
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE or tag in VOID:
            if tag == "br":
                yield "text", stack[-1], " ", False
            elif tag == "hr":
                yield "break", stack[-1], "", False
            continue
        yield "break", stack[-1], "", False
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        # A block starts: an open paragraph ends, and so does an open item or cell of the same kind.
        if stack[-1].tag == "p" or (stack[-1].tag == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option")):
            stack.pop()
        stack.append(_open(tag, attributes, stack[-1]))
        yield "tag", stack[-1], "", False


def blocks(page: str) -> Iterator[tuple[_Element, str, int]]:
    """Element, text and number of linked characters of every block; character references decoded, spaces joined."""
    parts: list[str] = []
    linked = 0
    where: _Element | None = None
    for kind, element, text, link in walk(page):
        if kind == "text":
            parts.append(text)
            linked += len(text) if link else 0
            where = element
        elif parts and kind == "break":
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                yield where, line, min(linked, len(line))
            parts, linked = [], 0
    if parts and (line := " ".join(html.unescape("".join(parts)).split())):
        yield where, line, min(linked, len(line))


def _key(kind: str, path: str, text: str = "") -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


_ROW = "host string, key long, kind string, path string, lo long, hi long, n long, chars long, linked long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of every token of every page, with the hash of (page, count), and text lengths per path."""
    schema = pa.schema(
        [("host", pa.string()), ("key", pa.int64()), ("kind", pa.string()), ("path", pa.string())]
        + [(c, pa.int64()) for c in ("lo", "hi", "n", "chars", "linked")]
    )
    for batch in batches:
        rows = []
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            page = page or ""
            counts: dict[tuple[str, str, str], int] = {}
            lengths: dict[str, list[int]] = {}
            sizes: dict[tuple[str, str, str], list[int]] = {}
            frames: set[str] = set()
            for kind, element, _, _ in walk(page):
                if kind == "tag":
                    token = ("tag", element.path, "")
                    counts[token] = counts.get(token, 0) + 1
            for element, line, linked in blocks(page):
                token = ("text", element.path, line)
                counts[token] = counts.get(token, 0) + 1
                if not element.firm:
                    for own in (lengths.setdefault(element.path, [0, 0]), sizes.setdefault(token, [0, 0])):
                        own[0] += len(line)
                        own[1] += linked
                    frames.update(f.path for f in element.named())
            digest = xxhash.xxh3_64_hexdigest(page.encode("utf-8", "surrogatepass"))
            rows.append((host, 0, "page", "", 0, 0, 1, 0, 0))
            for (kind, path, text), n in counts.items():
                mixed = xxhash.xxh3_64_intdigest(f"{digest} {n}")
                rows.append((host, _key(kind, path, text), kind, path, mixed & 0x7FFFFFFF, mixed >> 33, n, *sizes.get((kind, path, text), (0, 0))))
            for path, (chars, linked) in lengths.items():
                rows.append((host, _key("length", path), "length", path, 0, 0, 1, chars, linked))
            for path in frames:
                rows.append((host, _key("frame", path), "frame", path, 0, 0, 1, 0, 0))
        columns = list(zip(*rows)) or [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _template(tokens: list, lengths: list, named: list[str], pages: int) -> tuple[list[int], list[str], list[str]]:
    """Constant texts, link slots and frames of a host, from its valid classes, text lengths and named furniture."""
    classes: dict[tuple[int, int], list] = {}
    for t in tokens:
        classes.setdefault((t["lo"], t["hi"]), []).append(t)
    valid = [c for c in classes.values() if len(c) >= MIN_TOKENS]
    root = [t for c in valid for t in c if t["n"] == t["pages"]]
    roots = sorted((t["path"] for t in root if t["kind"] == "tag"), key=len, reverse=True)

    def slot(path: str) -> str:
        """Deepest root tag that leads to a path."""
        return next((r for r in roots if path == r or path.startswith(r + ">")), "")

    nested: dict[str, set[str]] = {}
    for c in valid:
        if c[0]["n"] != c[0]["pages"]:
            slots = {slot(t["path"]) for t in c}
            nested.setdefault(min(slots, key=len), set()).update(t["path"] for t in c)
    links = [p["path"] for p in lengths if p["linked"] * 2 > p["chars"]]
    links += [p for s in nested.values() for p in s if any(p.startswith(x + ">") for x in links)]
    constant = [t for t in root if t["kind"] == "text"]
    if pages < MIN_PAGES:
        return [t["key"] for t in constant], [], []

    menus = set(links)
    varying: dict[str, int] = {}
    for sign, texts in ((1, lengths), (-1, constant)):
        for p in texts:
            if p["path"] not in menus:
                varying[p["path"]] = varying.get(p["path"], 0) + sign * (p["chars"] - p["linked"])
    total = sum(varying.values())
    within = {f: sum(n for p, n in varying.items() if (p + ">").startswith(f + ">")) for f in named}
    return [t["key"] for t in constant], sorted(menus), sorted(f for f, n in within.items() if total and n >= FRAME_SHARE * total)


def _distinct(pages: DataFrame) -> DataFrame:
    """host and html of every different page of a host. Of the html only that of repeated pages is shuffled."""
    named = pages.select("host", "html", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    repeated, n = stage_counted(
        named.groupBy("host", "digest").agg(F.count("*").alias("n")).where("n > 1").select("host", "digest"), "page-copies", F.count("*")
    )
    if not n:
        return pages.select("host", "html")
    repeated = F.broadcast(repeated) if n <= BROADCAST_COPIES else repeated
    once = named.join(repeated, ["host", "digest"], "left_anti").select("host", "html")
    copies = named.join(repeated, ["host", "digest"], "left_semi").groupBy("host", "digest").agg(F.first("html").alias("html"))
    return once.unionByName(copies.select("host", "html"))


def templates(pages: DataFrame) -> DataFrame:
    """host, constant (keys of template texts), links and frames of every host."""
    counted = (
        _distinct(pages)
        .mapInArrow(_tokens, _ROW)
        .groupBy("host", "key", "kind", "path")
        .agg(*[F.sum(c).alias(c) for c in ("lo", "hi", "n", "chars", "linked")], F.count("*").alias("pages"))
    )
    # Few hosts' worth of rows have support enough; texts of single pages end here.
    sizes = F.max(F.when(F.col("kind") == "page", F.col("n")))
    counted = stage(counted.where(f"pages >= {MIN_TOKENS} OR kind IN ('page', 'length', 'frame')"), "page-tokens")
    hosts = counted.groupBy("host").agg(sizes.alias("host_pages"))
    able = counted.join(hosts, "host").where(
        F.col("kind").isin("length", "frame") | ((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= F.col("host_pages") * COVERAGE))
    )
    token = F.struct("key", "kind", "path", "lo", "hi", "n", "pages", "chars", "linked")
    length = F.struct("path", "chars", "linked")
    # Tokens on nearly all pages of a host are at most as many as one page has; paths are a page's structure.
    gathered = able.groupBy("host").agg(
        F.collect_list(F.when(F.col("kind").isin("tag", "text"), token)).alias("tokens"),
        F.collect_list(F.when(F.col("kind") == "length", length)).alias("lengths"),
        F.collect_list(F.when(F.col("kind") == "frame", F.col("path"))).alias("named"),
        F.max("host_pages").alias("pages"),
    )

    def deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [_template(r["tokens"], r["lengths"], r["named"], r["pages"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["host"],
                    pa.array([f[0] for f in found], pa.list_(pa.int64())),
                    pa.array([f[1] for f in found], pa.list_(pa.string())),
                    pa.array([f[2] for f in found], pa.list_(pa.string())),
                ],
                ["host", "constant", "links", "frames"],
            )

    return gathered.mapInArrow(deduce, "host string, constant array<long>, links array<string>, frames array<string>")


def _frames(lines: list[tuple[_Element, str, int]]) -> set[int]:
    """Named furniture of a page (by identity) that is a frame around its text."""
    total = sum(len(line) - linked for _, line, linked in lines)
    inside: dict[int, int] = {}
    headed: set[int] = set()
    found: set[int] = set()
    forms: set[int] = set()
    for element, line, linked in lines:
        for f in element.named():
            inside[id(f)] = inside.get(id(f), 0) + len(line) - linked
            if f.tag in FORM:
                forms.add(id(f))
            # An article around the named element is no evidence for it.
            holds = element.main is not None and element.main is not f and f.main is None
            if holds and (element.main.tag != "article" or f.tag in FORM):
                found.add(id(f))
            if holds or element.tag == "h1":
                headed.add(id(f))
    # An article or main element with text elsewhere tells that the rest is no frame.
    if not total or any(element.main and not element.furniture for element, _, _ in lines):
        return found
    return found | {f for f, n in inside.items() if n >= FRAME_SHARE * total and (f in forms or f in headed)}


def main_text(page: str | None, constant: set[int], links: set[str], frames: set[str]) -> str:
    """Text of the slots that hold the article."""
    slots: list[tuple[_Element, str]] = []
    linked: list[str] = []
    inside: list[tuple[_Element, str]] = []
    lines = [
        b for b in blocks(page or "") if not b[0].firm and not (constant and _key("text", b[0].path, b[1]) in constant)
    ]
    own: set[int] = set()
    if any(element.furniture for element, _, _ in lines):
        own = _frames([b for b in lines if b[0].path not in links])
    for element, line, _ in lines:
        if element.furniture and any(id(f) not in own and f.path not in frames for f in element.named()):
            continue
        if element.path in links:
            if element.main:
                linked.append(line)
            continue
        if element.main:
            inside.append((element, line))
        slots.append((element, line))
    if not slots:
        return "\n".join(linked)
    one = len({id(element.main) for element, _ in inside}) == 1
    if one or 2 * sum(len(line) for _, line in inside) >= sum(len(line) for _, line in slots):
        slots = inside
    return "\n".join(line for _, line in slots)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    named = pages.select("page_id", "url", "html", host.alias("host"))
    known, n = stage_counted(templates(named), "templates", F.count("*"))
    joined = named.join(F.broadcast(known) if n <= BROADCAST_HOSTS else known, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("html", "constant", "links", "frames")))
            texts = [main_text(page, set(c or ()), set(links or ()), set(frames or ())) for page, c, links, frames in rows]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "constant", "links", "frames").mapInArrow(
        run, "page_id long, url string, text string"
    )
