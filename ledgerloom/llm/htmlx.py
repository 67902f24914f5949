"""Main text of web pages, from a template of each host that is deduced from how tokens occur over its pages.

A token is a block element, told apart by its path (names and classes of the blocks around it), or a block of text at
its path. Its occurrence vector over the pages of the host is summed up in 64 bits: the exclusive or of a hash of (page,
count) over the pages that have it. That is a map-side aggregate, so no task ever gathers a host, however many pages it
has. Tokens of a host with one vector form an equivalence class. A class of elements is valid if it stands on enough
pages and holds two tokens or more (the page itself is one); those of its tokens that lie in one element must come round
in one order on every page of the host, or they are none of the template: the pages are read once more to see that.
Valid tokens are nested by their paths into the template, each below the nearest valid one around it; what lies between
them are slots, to which all text belongs that varies.

The template says for each slot whether it is kept. Names, classes and roles of its elements are evidence there (menu,
header, footer, sidebar, notice, advert, form, comments), and so is text that is nearly all links of a list; a slot
below a dropped one is dropped. Elements inside a slot that are too rare for the template are judged by their names.
Text that is itself a token of the template, the same on the pages of the host, is dropped outside ``article`` and
``main``. Scripts and styles are no text. All other slots are extracted, in page order.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.linkage import small, small_lists
from ledgerloom.plans.runtime import drop, ship, stage

#: Text must be on so many pages of the host to be one of its tokens; a class must stand on this share of them.
PAGES, SHARE = 3, 0.5
#: A slot is a menu if this share of its text is in links, and there are so many of them on a page.
LINKED, MENU = 0.9, 3
#: Characters of a path beyond which what is above its last step is written as a digest.
PATH = 400
_FLUSH = 4 << 20

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# fixed values: element names of the HTML standard
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var".split()
)
_SKIP = frozenset("nav aside footer form button select option datalist fieldset input dialog menu head object embed applet audio video canvas".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html body article main section div table ul ol dl td th blockquote aside nav header footer form".split())
# what the names, classes and roles of elements that hold no article text are made of
_BOILER = re.compile(
    r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|menus|header|masthead|footer|contentinfo|sidebar|side|aside|complementary|widgets?|ad|ads|advert|adverts|advertisement|"
    r"advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|dialog|newsletter|subscribe|subscription|"
    r"signup|login|search|form|share|sharing|social|related|recommended|recommendations|breadcrumb|breadcrumbs|pagination|pager|comment|comments|commentlist|respond|"
    r"replies|disqus|discussion|toolbar|skip|hidden)(?:$|[^a-z])"
)
_ARTICLE = frozenset(["article", "main"])


def _digest(*parts: str) -> int:
    h = hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest()
    return int.from_bytes(h, "little", signed=True)


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """(path step, skipped) of an element, from its name, class, id and role; the step of a skipped one says so."""
    if not attributes.strip():
        return name, name in _SKIP
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
    classes = " ".join(found.get("class", "").lower().split())
    marks = f"{classes} {found.get('id', '').lower()} {found.get('role', '').lower()}"
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    boiler = name not in ("html", "body") and name not in _ARTICLE and bool(_BOILER.search(marks))
    step = f"{name}.{classes}" if classes else name
    return f"{step}!" if boiler or hidden else step, name in _SKIP or boiler or hidden


_steps: dict[tuple[str, str], tuple[str, bool]] = {}


def _step(name: str, attributes: str) -> tuple[str, bool]:
    key = (name, attributes)
    if key not in _steps:
        if len(_steps) > 50_000:
            _steps.clear()
        _steps[key] = _label(name, attributes)
    return _steps[key]


class Block:
    """A run of text between block boundaries: path, text, whether it is in an article, characters and number of its links."""

    __slots__ = ("path", "text", "article", "linked", "links")

    def __init__(self, path, text, article, linked, links):
        self.path, self.text, self.article, self.linked, self.links = path, text, article, linked, links


def parse(page: str) -> tuple[list[str], list[Block], dict[str, tuple[str, bool]]]:
    """Paths of the block elements in page order, the blocks of text, and (path above, skipped by its name) of each path.

    The page itself is the empty path.
    """
    stack: list[tuple[str, str, bool]] = [("", "", False)]  # name, path, in an article
    paths: list[str] = [""]
    above: dict[str, tuple[str, bool]] = {}
    blocks: list[Block] = []
    pieces: list[str] = []
    linked, links, in_link = 0, 0, False
    at, n = 0, len(page)

    def flush():
        nonlocal linked, links
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                _, path, article = stack[-1]
                blocks.append(Block(path, text, article, min(linked, len(text)), links))
        linked = links = 0

    def say(raw: str):
        nonlocal linked, links
        if "&" in raw:
            raw = entities.unescape(raw)
        if in_link and not raw.isspace():
            linked, links = linked + len(raw), links + 1
        pieces.append(raw)

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        closing = bool(m[1] or m[4])
        if name in _RAW:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in _INLINE:
            if name == "a":
                in_link = not closing
            continue
        if name == "br" or name == "img" or name == "wbr":
            if name == "br":
                pieces.append(" ")
            continue
        flush()
        if name in _VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name == "p" and stack[k][0] in _SCOPE:
                    break
            continue
        # what a new block closes without saying so
        if stack[-1][0] == "p":
            stack.pop()
        shuts = _CLOSES.get(name)
        if shuts:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in shuts:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPE and stack[k][0] not in shuts:
                    break
        step, skip = _step(name, m[3] if m[2] else m[6])
        _, up, article = stack[-1]
        if name == "header" and not article:
            skip = True
        path = f"{up if len(up) < PATH else f'#{_digest(up):x}'}/{step}"
        paths.append(path)
        above[path] = up, skip
        if not (m[3] or m[6] or "").endswith("/"):
            stack.append((name, path, article or name in _ARTICLE))
    flush()
    return paths, blocks, above


class Template:
    """What is known of a host, as digests: the tokens of its outline, those of them whose slots are dropped, its constant text."""

    def __init__(self, outline, dropped, constant):
        self.outline, self.dropped, self.constant = frozenset(outline), frozenset(dropped), frozenset(constant)

    def drops(self, path: str, above: dict, known: dict[str, bool]) -> bool:
        """Does the text at ``path`` belong to a slot that is dropped?"""
        chain = []
        while path and path not in known:
            chain.append(path)
            path = above[path][0]
        out = known.get(path, False)
        for p in reversed(chain):
            token = _path_token(p)
            out = out or token in self.dropped or (token not in self.outline and above[p][1])
            known[p] = out
        return out


def main_text(page: str | None, template: Template | None = None) -> str:
    """The text of the slots of a page that its template keeps, one line per block; all text without a template."""
    if not page:
        return ""
    _, blocks, above = parse(page)
    if template is not None:
        known: dict[str, bool] = {}
        blocks = [b for b in blocks if not template.drops(b.path, above, known)]
        if template.constant:
            blocks = [b for b in blocks if b.article or _digest("text", b.path, b.text) not in template.constant] or blocks
    return "\n".join(b.text for b in blocks)


def _tokens(batches):
    """Rows (host, html) to (host, token, path, text?, up, pages, vector, place, skipped), added up over a batch."""
    task, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}

        def add(key, path, text, up, vector, place, skipped, sums=sums):
            s = sums.get(key)
            if s is None:
                sums[key] = [path, text, up, 1, vector, place, skipped]
            else:
                s[3] += 1
                s[4] ^= vector
                s[5] += place

        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = page.as_py()
            row += 1
            if not page:
                continue
            paths, blocks, above = parse(page)
            seen: dict[str, list] = {}
            for k, p in enumerate(paths):
                s = seen.setdefault(p, [k, 0])
                s[1] += 1
            texts: dict[int, list] = {}
            for b in blocks:
                t = texts.setdefault(_digest("text", b.path, b.text), [b.path, 0])
                t[1] += 1
            for p, (k, count) in seen.items():
                up, skipped = above.get(p, ("", False))
                add((host, _path_token(p)), p, False, _path_token(up) if p else 0, _vector(task, row, count), k / len(paths), skipped)
            for token, (p, count) in texts.items():
                add((host, token), p, True, _path_token(p), _vector(task, row, count), 0.0, False)
            if len(sums) > 200_000:
                yield _token_rows(sums)
                sums.clear()
        if sums:
            yield _token_rows(sums)


_path_tokens: dict[str, int] = {}


def _path_token(path: str) -> int:
    if path not in _path_tokens:
        if len(_path_tokens) > 50_000:
            _path_tokens.clear()
        _path_tokens[path] = _digest("path", path)
    return _path_tokens[path]


_ROOT = _digest("path", "")


def _vector(task: int, row: int, count: int) -> int:
    x = (task * 0xA0761D6478BD642F ^ row * 0xE7037ED1A0B428DB ^ count * 0x8EBC6AF09C88C6E3) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


_SUMS = "host string, token long, path string, text boolean, up long, pages long, vector long, place double, skipped boolean"


def _token_rows(sums):
    keys, values = list(sums), list(sums.values())
    columns = [[k[0] for k in keys], [k[1] for k in keys], *([v[i] for v in values] for i in range(7))]
    types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _SUMS.split(", ")])


class _Outline:
    """Candidate tokens of a host. Those of a class that lie in one element are a row, and should come in its order."""

    def __init__(self, tokens, rows):
        self.of = dict(zip(tokens, rows, strict=True))  # given in order of place
        self.order: dict[int, list[int]] = {}
        for t, c in self.of.items():
            self.order.setdefault(c, []).append(t)

    def broken(self, paths: list[str]) -> set[int]:
        """Rows that do not come round in their order on a page."""
        met: dict[int, list[int]] = {}
        for p in paths:
            c = self.of.get(t := _path_token(p))
            if c is not None:
                met.setdefault(c, []).append(t)
        return {c for c, found in met.items() if found != self.order[c] * (len(found) // len(self.order[c]))}


_SLOTS = "host string, token long, parent long, broken long, pages long, chars long, linked long, links long"


def _slots(batches):
    """Rows (host, html, tokens, rows) to what the pages say of each token: (host, token, parent, broken, pages, chars, linked, links)."""
    known: dict[str, _Outline] = {}
    for batch in batches:
        sums: dict[tuple[str, int, int], list[int]] = {}
        for k, host in enumerate(batch.column(0).to_pylist()):
            page = batch.column(1)[k].as_py()
            if not page:
                continue
            if host not in known:
                if len(known) > 2_000:
                    known.clear()
                known[host] = _Outline(batch.column(2)[k].as_py(), batch.column(3)[k].as_py())
            outline = known[host]
            paths, blocks, above = parse(page)
            broken = outline.broken(paths)
            slot: dict[str, str | None] = {"": ""}

            def nearest(p, slot=slot, above=above, outline=outline):
                chain = []
                while p not in slot:
                    chain.append(p)
                    if _path_token(p) in outline.of:
                        slot[p] = p
                        break
                    p = above[p][0]
                for q in chain:
                    slot[q] = slot[p]
                return slot[p]

            texts: dict[str, list[int]] = {}
            for b in blocks:
                t = texts.setdefault(nearest(b.path), [0, 0, 0])
                t[0] += len(b.text)
                if not b.article:
                    t[1] += b.linked
                    t[2] += b.links
            for p in dict.fromkeys(paths):
                token = _path_token(p)
                if token in outline.of:
                    up = _path_token(nearest(above[p][0])) if p else 0
                    s = sums.setdefault((host, token, up), [0] * 5)
                    for i, x in enumerate((int(outline.of[token] in broken), 1, *texts.get(p, (0, 0, 0)))):
                        s[i] += x
        if sums:
            columns = [[key[i] for key in sums] for i in range(3)] + [[s[i] for s in sums.values()] for i in range(5)]
            yield pa.record_batch([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=[x.split()[0] for x in _SLOTS.split(", ")])


def _by_host(pages: DataFrame) -> DataFrame:
    html, url = F.col("html").cast("string").alias("html"), F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html, _host_column(url).alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """``(host, tokens array<struct>)``: the template of each host, its size bounded by that of a page of the host.

    A token has its path (of a text, that of its block), its class, the token around it, its mean place on a page, and
    for elements whether the slot is dropped. It is on at least SHARE of the pages, so there are at most 1 / SHARE times
    as many as on a page.
    """
    ship(pages.sparkSession)
    slim = _by_host(pages)
    sums = slim.select("host", "html").mapInArrow(_tokens, _SUMS).groupBy("host", "token").agg(
        F.first("path").alias("path"), F.first("text").alias("text"), F.first("up").alias("up"), F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"),
        F.sum("place").alias("place"), F.max("skipped").alias("skipped"),
    )
    # what is on less than SHARE of the pages can be left out early: the page itself is a token of all of them
    sums = stage(sums.where((F.col("pages") >= PAGES) | ~F.col("text")), "tokens")
    hosts = sums.where(F.col("token") == _ROOT).select("host", F.col("pages").alias("all_pages"))
    frequent = sums.join(small(hosts), "host").where(F.col("pages") >= SHARE * F.col("all_pages"))
    classes = frequent.groupBy("host", "vector", "pages").agg(F.count("*").alias("size"))
    valid = stage(frequent.join(classes.where("size >= 2"), ["host", "vector", "pages"]).withColumn("place", F.col("place") / F.col("pages")), "valid")
    outline = F.sort_array(F.collect_list(F.struct("place", F.length("path").alias("depth"), "token", F.xxhash64("vector", "up").alias("row"))))
    elements = valid.where("not text").groupBy("host").agg(outline.alias("found"))
    elements = elements.select("host", F.col("found.token").alias("tokens"), F.col("found.row").alias("rows"))
    said = slim.select("host", "html").join(small_lists(stage(elements, "outlines"), "tokens"), "host").select("host", "html", "tokens", "rows").mapInArrow(_slots, _SLOTS)
    total = [F.sum(c).alias(c) for c in ("broken", "chars", "linked", "links")]
    checked = said.groupBy("host", "token").agg(F.first("parent").alias("parent"), F.sum("pages").alias("seen"), *total).where("broken = 0")
    menu = (F.col("chars") > 0) & (F.col("linked") >= LINKED * F.col("chars")) & (F.col("links") >= MENU * F.col("seen"))
    slots = valid.where("not text").join(checked, ["host", "token"])
    slots = slots.withColumn("dropped", F.col("skipped") | (menu & ~F.col("path").rlike("/h[1-6][^/]*$")))
    texts = valid.where("text").withColumn("parent", F.lit(None).cast("long")).withColumn("dropped", F.lit(True))
    columns = ["token", "path", "text", "vector", "parent", "place", "dropped"]
    both = slots.select("host", *columns).unionByName(texts.select("host", *columns))
    out = stage(both.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("tokens")), "templates")
    drop(sums, valid)
    return out


def _extract(batches):
    known: dict[str, Template] = {}
    for batch in batches:
        ids, urls, held, texts = batch.column(0), batch.column(1), 0, []
        hosts = batch.column(3).to_pylist()
        at = 0
        for k, page in enumerate(batch.column(2)):
            tokens = batch.column(4)[k]
            if tokens.is_valid and hosts[k] not in known:
                if len(known) > 2_000:
                    known.clear()
                known[hosts[k]] = Template(*(tokens[c].as_py() for c in ("outline", "dropped", "constant")))
            texts.append(main_text(page.as_py(), known[hosts[k]] if tokens.is_valid else None))
            held += len(texts[-1])
            if held > _FLUSH or k + 1 == len(ids):
                n = len(texts)
                yield pa.record_batch([ids.slice(at, n), urls.slice(at, n), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                at, texts, held = at + n, [], 0


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``(page_id, url, text, n_chars)``; n_chars counts code points.

    Blocks are in page order, joined by one line feed; inside a block white space is one space; character references are
    decoded. Null, empty and textless html give an empty text. Null or odd urls make one nameless host. Broken markup is
    read as far as it goes: unclosed elements end with the block around them. Repeated rows come back as often as they
    came in; other columns are not read.
    """
    ship(pages.sparkSession)
    known = templates(pages)
    of = lambda test: F.transform(F.filter("tokens", test), lambda t: t["token"])
    # digests are all that Python needs of a template
    digests = F.struct(of(lambda t: ~t["text"]).alias("outline"), of(lambda t: ~t["text"] & t["dropped"]).alias("dropped"), of(lambda t: t["text"]).alias("constant"))
    slim = known.select("host", digests.alias("template"), F.transform("tokens", lambda t: t["token"]).alias("entries"))
    joined = _by_host(pages).join(small_lists(slim, "entries").drop("entries"), "host", "left")
    rows = joined.select("page_id", "url", "html", "host", "template")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def _host_column(url):
    """Host of a url as crawlers write it, in lower case, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
