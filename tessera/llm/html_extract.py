"""Main text of web pages by wrappers inferred from each host's pages.

A wrapper is a union-free regular expression over tags and texts. A page's token stream is folded (equal neighbouring
groups become a repeated group) and aligned with its host's wrapper: what only one side has becomes optional, texts that
differ become slots, and texts that are the same on all pages stay constant; so do, inside a repeated group, the texts
that are in it on all pages. Constants of an item on more than half of the host's pages are template. Alignment is done
page by page within a task, then between the tasks' wrappers, a bounded number at a time in as many rounds as it takes, so
no task meets all pages or wrappers of a large host. The texts of a page are then read through its host's wrapper: constant
texts are template and go, inside an article too; slots and repeated groups are content. Boilerplate containers are checked
after that: by tag, role, and the words of class and id, of which inside an article only whole ones on containers count. An
article's bounds decide only where the host has too few pages for a wrapper, and a page that is all template is a copy, not
a template, and is kept.

Null pages, URLs and hosts are allowed: a null page has an empty text, a null or odd URL belongs to the host ''. Malformed
and cut-off pages are read as far as they go, in time linear in their length; a tag that the page's end cuts off gives no
text. Repeated rows and ties are alike; empty tables give no rows. Other columns than key, url and html are left out, so
their names do no harm.
"""

from __future__ import annotations

import html as html_module
import json
import re
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import Stages, join_back, map_rows, quoted, slices, table
from tessera.llm.url_filters import parts

#: Wrappers that are aligned in one task at a time, and hosts that a task holds before it hands their wrappers on.
FAN, HELD_HOSTS = 64, 1000
#: A constant is template where it is on more than this share of its host's pages; two pages that share texts may be copies.
CONSTANT_SHARE, CONSTANT_FROM = 0.5, 3
#: Groups of up to so many items are folded at once, longer ones by rising length.
SHORT = 12
#: Alignments of more cells (a bit each) than this are halved until they fit: the same alignment in linear memory.
CELLS = 1 << 28

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^'">]++|"[^"]*"|'[^']*')*+)""")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: Paths longer than this are told by their digest.
PATH_CHARS = 200
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "xmp", "noembed"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
_CLOSES_P = _BLOCKS - {"caption", "body", "head", "html", "option", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "legend"}
_OUT_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "option", "label", "input"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_OUT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "banner", "popup", "modal", "newsletter", "subscribe", "subscription", "share", "sharing", "social", "comment", "comments", "respond", "disqus", "related", "recommended", "widget", "widgets", "toolbar", "pagination", "pager", "login", "signup", "search", "masthead", "topbar", "skip"}
_CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "details"}
#: Class words after these say what a layout has, not what the element is.
_LAYOUT = re.compile(r"(?<!\S)(?:has|with|no|without)[-_]\S*")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _names(attrs: str) -> tuple[str, set[str], set[str], str]:
    """First class, the whole words of class and id, the parts of these, role."""
    found = {}
    for m in _ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    own = (_LAYOUT.sub("", found.get("class", "")), found.get("id", ""))
    words = {w for v in own for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", v).lower()) if w}
    return (found.get("class", "").split() or [""])[0], {w for v in own for w in v.lower().split()}, words, found.get("role", "").lower()


class Text:
    """A block's text with its place: path of open tags, whether in an article, whether in boilerplate."""

    __slots__ = ("article", "out", "parts", "path")

    def __init__(self, path: str, article: bool, out: bool):
        self.path, self.article, self.out, self.parts = path, article, out, []

    def value(self) -> str:
        return " ".join(html_module.unescape("".join(self.parts)).split())


def read(page: str | None) -> tuple[list[str | Text], bool]:
    """The page's tokens (tags and block texts, in order) and whether it has an article."""
    page = page or ""
    tokens: list[str | Text] = []
    # of each open element: tag, path, in an article, out, in a header of an article, out by more than words, in a heading
    stack: list[tuple[str, str, bool, bool, bool, bool, bool]] = []
    outside = ("", "", False, False, False, False, False)
    opened: dict[str, int] = {}
    text: Text | None = None
    found_article, quotes, at, n = False, True, 0, len(page)

    def put(raw: str) -> None:
        nonlocal text
        if text is None:
            if not raw or raw.isspace():
                return
            _, path, article, out, header, _, heading = stack[-1] if stack else outside
            text = Text(path, article, out or header and not heading)
            tokens.append(text)
        text.parts.append(raw)

    def pop_to(k: int) -> None:
        for e in reversed(stack[k:]):
            tokens.append("/" + e[0])
            opened[e[0]] -= 1
        del stack[k:]

    while at < n:
        start = page.find("<", at)
        if start < 0:
            put(page[at:])
            break
        follows = page[start + 1 : start + 2]
        if follows == "!" or follows == "?" or follows == "/" and not page[start + 2 : start + 3].isalpha():
            put(page[at:start])
            end = page.find("-->", start + 4) + 2 if page.startswith("<!--", start) else page.find(">", start)
            at = end + 1 if end > start else n
            continue
        m = (_TAG if quotes else _NAME).match(page, start)
        if m is None:
            put(page[at : start + 1])
            at = start + 1
            continue
        put(page[at:start])
        end = m.end()
        if not quotes or end < n and page[end] != ">":  # a quote that is never closed
            quotes, end = False, page.find(">", start)
        if end < 0 or end >= n:  # the page ends within the tag
            break
        closes, tag, attrs, at = m[1], m[2].lower(), page[min(m.end(2), end) : end], end + 1
        if tag in _RAW:
            if not closes and not attrs.endswith("/"):
                last = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                at = last.end() if last else n
            continue
        if tag in _BLOCKS:
            text = None
        elif tag == "br" and text is not None:
            text.parts.append("\n")
        if closes:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag in _VOID:
            tokens.append(tag)
            continue
        ends = {"p", "li"} if tag == "li" else {"p"} if tag in _CLOSES_P else ()
        if any(opened.get(e) for e in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in _BLOCKS:
                    break
        name, whole, words, role = _names(attrs) if attrs else ("", set(), set(), "")
        _, path, article, out, header, hard, heading = stack[-1] if stack else outside
        hard = hard or tag in _OUT_TAGS or role in _OUT_ROLES or (tag == "header" and not article)
        if tag == "main" and not hard:  # a page has one: what it stands in is layout
            out = False
        if article:
            worded = tag in _CONTAINERS and bool(whole & _OUT_WORDS)
        else:
            worded = tag not in ("html", "body") and bool(words & _OUT_WORDS)
        out = out or hard or worded
        header = header or (tag == "header" and article)
        if not article and not out and (tag in ("article", "main") or role in ("article", "main")):
            article = found_article = True
        own = f"{tag}.{name}" if name else tag
        if not attrs.endswith("/"):
            path = f"{path}/{own}" if path else own
            if len(path) > PATH_CHARS:
                path = f"~{zlib.crc32(path.encode('utf-8', 'surrogatepass')):08x}{len(stack)}"
            stack.append((tag, path, article, out, header, hard, heading or tag in _HEADINGS))
            opened[tag] = opened.get(tag, 0) + 1
        tokens.append(own if stack else tag)
    return tokens, found_article


def _hash(value: str) -> int:
    return zlib.crc32(value.encode("utf-8", "surrogatepass")) + 1


#: A wrapper's item: [key, text, optional, pages]. Keys: a tag, "#path", or "(a b)+". Text: None for a tag; a text's hash, or
#: 0 for a slot; for a group the "hash key" of all texts that are in it on each of its pages.
Item = list


def _same(s: int | list[str] | None, t: int | list[str] | None) -> int | list[str] | None:
    """The text of an item that is s on some pages and t on others."""
    if isinstance(s, list):
        return s if s == t else sorted(set(s) & set(t))
    return None if s is None else s if s == t else 0


def _group(key: str, items: list[Item]) -> Item:
    """One item for neighbouring ones. A text counts only where it is on as many pages as the group."""
    pages = max(i[3] for i in items)
    texts = set()
    for k, text, _, n in items:
        if text and n == pages:
            texts.update(text if isinstance(text, list) else [f"{text} {k}"])
    return [key, sorted(texts), all(i[2] for i in items), pages]


def items_of(tokens: list[str | Text]) -> list[Item]:
    return [[t, None, False, 1] if isinstance(t, str) else ["#" + t.path, _hash(t.value()), False, 1] for t in tokens]


def _first(body: str) -> str:
    """The first key of a group's keys."""
    if not body.startswith("("):
        return body.split(" ", 1)[0]
    depth = 0
    for m in re.finditer(r"(?:(?<=\s)|(?<=\()|^)\(|\)\+(?=[\s)]|$)", body):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return body[: m.end()]
    return body


def fold(items: list[Item], known: frozenset[str] = frozenset()) -> list[Item]:
    """Makes neighbouring equal groups of any length, or single ones that the wrapper knows as repeated, a repeated group.

    Short groups are folded first, so that the records of a longer one are equal whatever is repeated in them.
    """
    bodies: dict[str, list[str]] = {}
    for k in known:
        bodies.setdefault(_first(k[1:-2]), []).append(k[1:-2])
    limit = SHORT
    while True:
        out, i, longer = [], 0, 0
        keys = [x[0] for x in items]
        n = len(keys)
        pairs = list(zip(keys, [*keys[1:], ""], strict=False))
        places: dict[tuple[str, str], list[int]] = {}
        for k in range(n - 1, -1, -1):
            places.setdefault(pairs[k], []).append(k)
        while i < n:
            first, size, repeat = keys[i], 0, 0
            if not first.startswith("(") and i + 1 < n and first == keys[i + 1]:
                size = 1
            else:
                near = places[pairs[i]]  # falling; places passed by are dropped
                while near and near[-1] <= i:
                    near.pop()
                for k in reversed(near):
                    d = k - i
                    if k + d > n:
                        break
                    if d > 1 and keys[k - 1] == keys[k + d - 1] and keys[i:k] == keys[k : k + d]:
                        if d <= limit:
                            size = d
                        else:
                            longer = min(longer or d, d)
                        break
            if size:
                repeat = i + 2 * size
                while keys[repeat : repeat + size] == keys[i : i + size]:
                    repeat += size
            for body in bodies.get(first, ()):
                k, at = i, 0
                while k < n and body.startswith(keys[k], at) and body[at + len(keys[k]) :][:1] in ("", " "):
                    at += len(keys[k]) + 1
                    k += 1
                    if at > len(body):
                        if (k - i > 1 or not first.startswith("(")) and (not size or k - i < size):
                            size, repeat = k - i, k
                        break
            if size:
                out.append(_group(f"({' '.join(keys[i : i + size])})+", items[i:repeat]))
                i = repeat
            else:
                out.append(items[i])
                i += 1
        if [x[0] for x in out] == keys:
            if not longer:
                return out
            limit = longer
        items = out


def _rows(p: list[str], q: list[str]):
    """After each of p: a number whose bit j is 0 where the longest common sequence with q grows at j (Hyyrö)."""
    full, masks = (1 << len(q)) - 1, {}
    for j, y in enumerate(q):
        masks[y] = masks.get(y, 0) | 1 << j
    v = full
    for x in p:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(p: list[str], q: list[str]) -> np.ndarray:
    """Lengths of the longest common sequences of p and each start of q."""
    v = (1 << len(q)) - 1
    for v in _rows(p, q):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(q) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(q)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(p: list[str], q: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence."""
    if not p or not q:
        return []
    if len(p) * len(q) > CELLS and len(p) > 1:
        half = len(p) // 2
        cut = int((_lengths(p[:half], q) + _lengths(p[half:][::-1], q[::-1])[::-1]).argmax())
        return common(p[:half], q[:cut]) + [(half + i, cut + j) for i, j in common(p[half:], q[cut:])]
    rows = [(1 << len(q)) - 1, *_rows(p, q)]
    found, i, j = [], len(p), len(q)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper of both: common items in order; what one side lacks is optional; differing texts are slots."""
    x, y = [i[0] for i in a], [i[0] for i in b]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    p, q = x[head : len(x) - tail], y[head : len(y) - tail]
    pairs: list[tuple[int | None, int | None]] = [(k, k) for k in range(head)]
    i = j = 0
    for m, n in [*common(p, q), (len(p), len(q))]:
        pairs += [(head + k, None) for k in range(i, m)] + [(None, head + k) for k in range(j, n)]
        if m < len(p):
            pairs.append((head + m, head + n))
        i, j = m + 1, n + 1
    pairs += [(len(x) - tail + k, len(y) - tail + k) for k in range(tail)]
    out = []
    for i, j in pairs:
        if i is None or j is None:
            key, text, _, pages = a[i] if j is None else b[j]
            out.append([key, text, True, pages])
        else:
            (key, s, o, m), (_, t, r, k) = a[i], b[j]
            out.append([key, _same(s, t), o or r, m + k])
    return out


def repeated(wrapper: list[Item]) -> frozenset[str]:
    return frozenset(i[0] for i in wrapper if i[0].startswith("("))


class Inference:
    """A host's wrapper while its pages come in; pages of a structure seen before only turn constants into slots."""

    def __init__(self):
        self.wrapper: list[Item] | None = None
        self.places: OrderedDict[tuple, list[int]] = OrderedDict()

    def add(self, page: list[Item]) -> None:
        if self.wrapper is None:
            self.wrapper = [list(i) for i in page]
            return
        known = repeated(self.wrapper)
        page = fold(page, known)
        form = tuple(i[0] for i in page)
        if (places := self.places.get(form)) is not None:
            self.places.move_to_end(form)
            for k, i in zip(places, page, strict=True):
                mine = self.wrapper[k]
                mine[3] += 1
                mine[1] = _same(mine[1], i[1])
            return
        merged = align(fold(self.wrapper, repeated(page)), page)
        if [i[0] for i in merged] != [i[0] for i in self.wrapper]:
            self.places.clear()
        self.wrapper = merged
        keys, places, k = [i[0] for i in merged], [], 0
        for f in form:  # the page's items stand in the wrapper in their order
            while k < len(keys) and keys[k] != f:
                k += 1
            if k == len(keys):
                return
            places.append(k)
            k += 1
        self.places[form] = places
        if len(self.places) > 256:
            self.places.popitem(last=False)


def _page_wrappers(batches):
    """One wrapper of each host of a task, or of each thousand hosts of it."""
    hosts: dict[str, Inference] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([json.dumps(w.wrapper) for w in hosts.values()], pa.string())], names=["host", "wrapper"])

    for batch in batches:
        for part in slices(batch, "html"):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                hosts.setdefault(host, Inference()).add(fold(items_of(read(page)[0])))
            if len(hosts) >= HELD_HOSTS:
                yield out()
                hosts = {}
    if hosts:
        yield out()


def _merged(pdf):
    import pandas as pd

    wrapper = None
    for text in sorted(pdf["wrapper"]):
        new = json.loads(text)
        if wrapper is None:
            wrapper = new
        else:
            wrapper, new = fold(wrapper, repeated(new)), fold(new, repeated(wrapper))
            wrapper = align(wrapper, new)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(wrapper)]})


def infer(pages: DataFrame, stages: Stages) -> DataFrame:
    """host and wrapper (JSON items) of all hosts. pages: host, html.

    Wrappers of a host are aligned in groups of about FAN, again and again until one is left.
    """
    found, turn = stages.write(pages.select("host", "html").mapInArrow(_page_wrappers, "host string, wrapper string"), "parts"), 0
    done = None
    while True:
        counts, size = stages.measured(found.groupBy("host").agg(F.count("*").alias("k")), "counts", chars=F.coalesce(F.sum(F.length("host")), F.lit(0)), rows=F.coalesce(F.sum("k"), F.lit(0)), most=F.max("k"))
        counted = join_back(found, (counts.select("host", "k", F.struct("k").alias("v")), size), "host", "k", "v").select("host", "wrapper", "v.k")
        single = counted.filter("k = 1").select("host", "wrapper")
        done = single if done is None else done.union(single)
        if (size["most"] or 1) == 1:
            return done
        salt = F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id(), F.lit(turn)), F.ceil(F.col("k") / FAN))
        many = counted.filter("k > 1").withColumn("salt", salt)
        found, turn = stages.write(many.groupBy("host", "salt").applyInPandas(_merged, "host string, wrapper string"), f"merged{turn}"), turn + 1


def pages_of(wrapper: str | None) -> int:
    """The pages that a wrapper is made of, by its most frequent item."""
    return max((i[3] for i in json.loads(wrapper or "[]")), default=0)


def place_of(key: str, value: int) -> int:
    """A text's place and hash as one number."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{value} {key}".encode("utf-8", "surrogatepass"))


def constants(wrapper: str | None) -> set[int]:
    """Places and hashes of the texts that are the same on all of a host's pages that have them, and on most pages."""
    items = json.loads(wrapper or "[]")
    least = CONSTANT_SHARE * pages_of(wrapper)
    found = set()
    for key, text, _, pages in items:
        if text and pages >= CONSTANT_FROM and pages > least:
            found.update(place_of(k, int(h)) for h, k in (x.split(" ", 1) for x in text) if k) if isinstance(text, list) else found.add(place_of(key, text))
    return found


def main_text(page: str | None, template: set[int], known: bool = False) -> str:
    """The texts that the template does not have. known: the host has pages enough for one, so an article's bounds decide nothing."""
    tokens, has_article = read(page)
    kept = [(t, v) for t in tokens if not isinstance(t, str) and not t.out and (known or t.article or not has_article) and (v := t.value())]
    own = [v for t, v in kept if place_of("#" + t.path, _hash(v)) not in template] if template else [v for _, v in kept]
    return "\n".join(own or [v for t, v in kept if t.article])


def _templates():
    """Of each wrapper: its constants, ascending, and whether it is made of pages enough."""

    def run(batch: pa.RecordBatch) -> dict:
        wrappers = batch.column("wrapper").to_pylist()
        places = [np.sort(np.fromiter(constants(w), np.uint64)).tobytes() for w in wrappers]
        return {"host": batch.column("host"), "places": places, "known": [pages_of(w) >= CONSTANT_FROM for w in wrappers], "k": [pages_of(w) for w in wrappers]}

    return run


def _extract():
    memo: OrderedDict[bytes, set[int]] = OrderedDict()

    def run(batch: pa.RecordBatch) -> dict:
        texts = []
        for page, places, known in zip(*(batch.column(c).to_pylist() for c in ("html", "places", "known")), strict=True):
            if places not in memo:
                memo[places] = set(np.frombuffer(places or b"", np.uint64).tolist())
                if len(memo) > 1000:
                    memo.popitem(last=False)
            texts.append(main_text(page, memo[places], bool(known)))
        return {"_key": batch.column("_key"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return run


def html_extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page."""
    stages = Stages(pages.sparkSession, "wrappers")
    own = F.col(quoted(url))
    pages = pages.select(F.col(quoted(key)).alias("_key"), own.alias("url"), parts(own)[0].alias("host"), F.col(quoted(html)).alias("html"))
    templates = map_rows(infer(pages, stages), _templates, "host string, places binary, known boolean, k long", sized="wrapper")
    chars = F.coalesce(F.sum(F.length("template.places") + F.length("host")), F.lit(0))
    templates, size = stages.measured(templates.select("host", "k", F.struct("places", "known").alias("template")), "templates", chars=chars, rows=F.coalesce(F.sum("k"), F.lit(0)))
    joined = join_back(pages, (templates, size), "host", "k", "template").select("_key", "url", "html", "template.places", "template.known")
    kind = pages.schema["_key"].dataType.simpleString()
    return map_rows(joined, _extract, f"_key {kind}, url string, text string, n_chars long", sized="html").withColumnRenamed("_key", key)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))
