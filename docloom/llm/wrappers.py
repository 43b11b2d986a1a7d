"""HTML extraction by union-free regular expressions inferred for each host.

A page is a stream of tags and text. Its own expression comes from folding: neighbouring stretches with the same tags
are aligned and become one repeated group, and what only one of them has becomes optional. Expressions of pages of one
host are aligned in turn in the same way; text that differs becomes a slot. The host's wrapper so tells fixed template
from slots, and where the slots of the article are; a page then yields the text under those places.
"""

from __future__ import annotations

import bisect
import html as html_lib
import json
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .url_rules import host_of

#: HTML's own classes of elements. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: With the elements of MathML, and object, whose content is text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose mfenced semantics annotation".split())
#: Raw text to HTML: without an end tag, it goes to the end of the page.
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
#: Left out with all their content; one that is not closed (before the next of its kind) is taken as no element.
SKIPPED = frozenset("button select svg template".split())
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}), "tbody": frozenset({"thead", "tbody", "tr", "td", "th"})}
KEEPS_P = frozenset({"td", "th", "body", "html"})
#: What is never main text, by element and by words in class, id or role.
OUT_TAGS = frozenset("head nav header footer aside form menu dialog search".split())
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu sidebar aside footer header masthead breadcrumb breadcrumbs pagination pager comment comments reply replies disqus respond cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login complementary contentinfo".split())
#: Words that only hint at it: of such an element the blocks go that are mostly links.
HINT_WORDS = frozenset("share sharing social related recommended widget toolbar alert tags".split())
IN_WORDS = frozenset("article articlebody content post entry story main body text".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: A class name with one of these says how the page is laid out, not what the element is ("no-sidebar", "comments-open").
MODIFIERS = frozenset("no not with without has is open opened closed hide hidden show shown enabled disabled active".split())
#: Of the words above, those that a page's layout may be named for as well: they leave out nothing if that leaves nothing
#: of a page with so much plain text.
LAYOUT_WORDS = frozenset("nav navigation navbar menu sidebar aside footer header masthead banner notice notices promo promotion complementary contentinfo".split())
LEAST_TEXT = 200
_MAX_PERIOD = 6
#: Sequences whose product of lengths is above this are aligned between anchors only.
MOST_CELLS = 250_000
#: Text that so many pages of a host have at one place, all of them, is text of the template; of fewer words it may as
#: well be a heading that articles share ("Summary"), so it stays.
TEMPLATE_PAGES, TEMPLATE_WORDS = 4, 4
#: Elements nested deeper belong to the expression's element at this depth; their text stays, and what is left out stays out.
MAX_DEPTH = 200


def signature(tag: str, attributes: str) -> str:
    """The element and the words in its class, id and role; a name with a modifier is one word."""
    if not attributes.strip():
        return tag
    words = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = _WORD.findall(name)
            words.update(parts if MODIFIERS.isdisjoint(parts) else ["-".join(parts)])
    return " ".join([tag, *sorted(words)])


def is_out(sig: str, soft: bool = False) -> bool:
    """Whether the element is never main text; soft: words of the layout are passed over."""
    tag, *words = sig.split(" ")
    return tag in OUT_TAGS or (tag not in ("html", "body", "article", "main") and any(w in OUT_WORDS and not (soft and w in LAYOUT_WORDS) for w in words))


def _left_out(path: tuple[str, ...], n: int, soft: bool) -> bool:
    """Whether something below the place leaves the block out. Headings in an article's own header are main text."""
    for k in range(n, len(path)):
        if is_out(path[k], soft):
            headed = _tag(path[k]) == "header" and any(_tag(p) == "article" for p in path[:k]) and any(_tag(p) in _HEADINGS for p in path[k + 1 :])
            if not headed or any(is_out(p, soft) for p in path[k + 1 :]):
                return True
            return False
    return False


class Node:
    """A group of the expression: its open tag's signature ('' for a bare group), parts, text slot and multiplicity."""

    __slots__ = ("sig", "parts", "text", "plain", "linked", "many", "maybe", "pages", "shared")

    def __init__(self, sig, parts=(), text=None, plain=0, linked=0, many=False, maybe=False, pages=1, shared=()):
        self.sig, self.parts, self.text, self.plain, self.linked, self.many, self.maybe = sig, list(parts), text, plain, linked, many, maybe
        self.pages, self.shared = pages, set(shared)  # pages that have the group, and the hashes of texts that all of them have in it

    def dump(self):
        return [self.sig, [p.dump() for p in self.parts], self.text, self.plain, self.linked, self.many, self.maybe, self.pages, sorted(self.shared)]

    @classmethod
    def load(cls, x):
        return cls(x[0], [cls.load(p) for p in x[1]], *x[2:])


#: A text slot: '' no text, else a hash of the text that all have, or this.
VARIES = "*"


def parse(page: str) -> tuple[Node, list[tuple[tuple[str, ...], str, bool]]]:
    """The page as nested tags, and its blocks in order: (signatures of the open elements, raw text, mostly links)."""
    root = Node("")
    stack, path, blocks = [("", root, ())], (), []
    text, link, plain, linked, open_ended = [], 0, 0, 0, set()

    def end_block():
        nonlocal text, plain, linked
        if text:
            raw = "".join(text)
            if not raw.isspace():
                blocks.append((path, raw, 0 < plain <= 2 * linked))
                node = stack[-1][1]
                value = xxhash.xxh32_hexdigest(_clean(raw))
                node.text = value if node.text in (None, value) else VARIES
                if raw.strip().count(" ") >= TEMPLATE_WORDS - 1:
                    node.shared.add(value)
                node.plain += plain
                node.linked += linked
            text, plain, linked = [], 0, 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                text.append(s)
                k = len(s.strip())
                plain += k
                linked += k if link else 0
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/") and tag not in open_ended:
                end = re.compile(rf"<(/?){tag}(?![^\s/>])[^>]*>", re.I).search(page, at)
                if end is None:
                    open_ended.add(tag)
                elif end[1]:
                    at = end.end()
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            elif tag in ("br", "img"):
                text.append(" ")
            continue
        end_block()
        link = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    path = stack[-1][2]
                    break
        elif tag in VOID:
            pass
        else:
            shut = CLOSES.get(tag, frozenset({"p"}))
            i = len(stack) - 1
            while i > 0 and stack[i][0] in shut:
                i -= 1
            del stack[i + 1 :]
            path = stack[-1][2]
            sig = signature(tag, attributes)
            if len(stack) <= MAX_DEPTH:
                node = Node(sig)
                stack[-1][1].parts.append(node)
                inner = (*path, sig)
            else:
                node, inner = stack[-1][1], (*path, sig) if len(path) <= MAX_DEPTH and is_out(sig) else path
            if not attributes.endswith("/"):
                stack.append((tag, node, inner))
                path = inner
    end_block()
    return root, blocks


def merge(a: Node, b: Node, one_page: bool = False) -> Node:
    """The expression that fits whatever one of two fits; of two stretches of one page or of different pages."""
    text = a.text if a.text == b.text else VARIES
    pages, shared = (max(a.pages, b.pages), a.shared | b.shared) if one_page else (a.pages + b.pages, a.shared & b.shared)
    return Node(a.sig, align(a.parts, b.parts, one_page), text, a.plain + b.plain, a.linked + b.linked, a.many or b.many, a.maybe or b.maybe, pages, shared)


def matched(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence of two lists of signatures; '' matches nothing. Above MOST_CELLS: the longest
    sequence of signatures that are single in both, and the same again between these; what has no such anchor is left."""
    a = 0
    while a < min(len(x), len(y)) and x[a] == y[a] and x[a]:
        a += 1
    e = 0
    while e < min(len(x), len(y)) - a and x[-1 - e] == y[-1 - e] and x[-1 - e]:
        e += 1
    head, tail = [(i, i) for i in range(a)], [(len(x) - i, len(y) - i) for i in range(e, 0, -1)]
    u, v = x[a : len(x) - e], y[a : len(y) - e]
    if len(u) * len(v) <= MOST_CELLS:
        best = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
        for i in range(len(u) - 1, -1, -1):
            for j in range(len(v) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if u[i] == v[j] and u[i] else max(best[i + 1][j], best[i][j + 1])
        mid, i, j = [], 0, 0
        while i < len(u) and j < len(v):
            if u[i] == v[j] and u[i]:
                mid.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        once_u, once_v = ({s: i for i, s in enumerate(w) if n[s] == 1 and s} for w, n in ((u, Counter(u)), (v, Counter(v))))
        ends, back, spots = [], {}, []
        for i, j in sorted((i, once_v[s]) for s, i in once_u.items() if s in once_v):
            k = bisect.bisect_left(ends, j)
            ends[k:], spots[k:] = [j, *ends[k + 1 :]], [(i, j), *spots[k + 1 :]]
            back[i, j] = spots[k - 1] if k else None
        anchors, at = [], spots[-1] if spots else None
        while at:
            anchors.append(at)
            at = back[at]
        mid, i0, j0 = [], 0, 0
        for i, j in [*anchors[::-1], *([(len(u), len(v))] if anchors else [])]:
            mid += [(i0 + p, j0 + q) for p, q in matched(u[i0:i], v[j0:j])]
            if i < len(u):
                mid.append((i, j))
            i0, j0 = i + 1, j + 1
    return [*head, *((a + i, a + j) for i, j in mid), *tail]


def align(x: list[Node], y: list[Node], one_page: bool = False) -> list[Node]:
    """Parts in order: those of both, and as optional those of one."""
    pairs = matched([p.sig for p in x], [p.sig for p in y])
    if len(pairs) == len(x) == len(y):
        return [merge(p, q, one_page) for p, q in zip(x, y)]
    out, i, j = [], 0, 0
    for a, b in [*pairs, (len(x), len(y))]:
        for p in [*x[i:a], *y[j:b]]:
            p.maybe = True
            out.append(p)
        if a < len(x):
            out.append(merge(x[a], y[b], one_page))
        i, j = a + 1, b + 1
    return fold(out, one_page)


def fold(parts: list[Node], one_page: bool = True) -> list[Node]:
    """Neighbouring stretches of the same tags become one repeated group."""
    for k in range(1, _MAX_PERIOD + 1):
        out: list[Node] = []
        for p in parts:
            out.append(p)
            if len(out) >= 2 * k and all(out[-k + i].sig == out[-2 * k + i].sig and out[-k + i].sig for i in range(k)):
                last = out[-k:]
                del out[-k:]
                for i, q in enumerate(last):
                    g = merge(out[-k + i], q, True) if one_page else _beside(out[-k + i], q)
                    g.many = True
                    out[-k + i] = g
        parts = out
    return parts


def _beside(a: Node, b: Node) -> Node:
    """Groups that different pages brought into one place: whether a page had both is not known, so neither's texts
    count as every page's unless both have them."""
    g = merge(a, b, True)
    g.shared, g.pages = a.shared & b.shared, max(a.pages, b.pages)
    return g


def fold_all(node: Node) -> Node:
    node.parts = fold([fold_all(p) for p in node.parts])
    return node


def _tag(sig: str) -> str:
    return sig.split(" ", 1)[0]


def _hinted(sig: str) -> bool:
    return not HINT_WORDS.isdisjoint(sig.split(" ")[1:])


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def read_rules(root: Node) -> dict:
    """What an expression says of the main text: places (paths of signatures) and the hashes of texts of the template.

    The weight of a group is the plain text of its slots, without links; text that is the same on all pages is no slot
    (unless there is one page, or nothing varies). From the root the way goes down while one group has four fifths of
    the weight, beside varying headings, which are places too; it ends at an article or main element. Where several
    groups share the weight, those made or named for articles are taken if they have half of it, else all.
    """
    slots_only, soft = root.pages > 1, False

    def own(node):
        if slots_only and node.text not in (VARIES, None):
            return 0
        return max(0, node.plain - 2 * node.linked)

    def weight(node):
        w = own(node) + sum(weight(p) for p in node.parts if not is_out(p.sig, soft))
        return w / 2 if _hinted(node.sig) else w

    if not weight(root):
        slots_only = False
    if not weight(root):
        soft = True
        soft = weight(root) >= LEAST_TEXT
    node_group, path, extra = [root], [], []
    while True:
        whole, kids = sum(map(weight, node_group)), {}
        for node in node_group:
            for p in node.parts:
                if not is_out(p.sig, soft):
                    kids.setdefault(p.sig, []).append(p)
        heavy = {sig: sum(map(weight, g)) for sig, g in kids.items()}
        here = _tag(path[-1]) if path else ""
        if here in ("article", "main") or not whole or not heavy:
            break
        main = next((sig for sig in heavy if (_tag(sig) == "main" or "articlebody" in sig.split(" ")[1:]) and 3 * heavy[sig] >= whole), None)
        best = main or max(heavy, key=lambda sig: (heavy[sig], _tag(sig) == "article", not IN_WORDS.isdisjoint(sig.split(" ")[1:]), sig))
        if not main and (5 * heavy[best] < 4 * whole or not any(p.parts for p in kids[best])):
            break
        extra += [[*path, sig] for sig in kids if _tag(sig) in _HEADINGS and heavy[sig] and sig != best]
        path, node_group = [*path, best], kids[best]
    places = [path]
    if path == [] or _tag(path[-1]) not in ("article", "main"):
        meant = [sig for sig in heavy if _tag(sig) in ("article", "main") or _tag(sig) in ("div", "section", "td") and not IN_WORDS.isdisjoint(sig.split(" ")[1:])]
        if meant and 2 * sum(heavy[sig] for sig in meant) >= whole > 0:
            places = [[*path, sig] for sig in kids if sig in meant or _tag(sig) in _HEADINGS and heavy[sig]]
    fixed, todo = set(), [root]
    while todo:
        node = todo.pop()
        if node.pages >= TEMPLATE_PAGES and 5 * node.pages >= 4 * root.pages:
            fixed |= node.shared
        todo += node.parts
    return {"places": [*extra, *places], "fixed": sorted(fixed), "soft": soft}


def _clean(raw: str) -> str:
    return " ".join(html_lib.unescape(raw).split())


def take(blocks, rules: dict) -> str | None:
    """The text under the places, in page order, without what its element leaves out and links that its element's name
    hints at; texts of the template go too, if they are the smaller part of it."""
    places, fixed, got = [tuple(x) for x in rules["places"]], set(rules["fixed"]), []
    for path, raw, links in blocks:
        n = max((len(x) for x in places if path[: len(x)] == x), default=-1)
        if n >= 0 and not _left_out(path, n, rules["soft"]) and not (links and any(map(_hinted, path[n:]))) and (c := _clean(raw)):
            got.append(c)
    own = [c for c in got if xxhash.xxh32_hexdigest(c) not in fixed] if fixed else got
    if 2 * sum(map(len, own)) < sum(map(len, got)):
        own = got
    return "\n".join(own) if own else None


def _learn(batches):
    hosts: dict[str, Node] = {}

    def flush():
        names = list(hosts)
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([json.dumps(hosts[h].dump()) for h in names], pa.string())], names=["host", "wrapper"])
        hosts.clear()
        return out

    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1)):
            if page.is_valid:
                own = fold_all(parse(page.as_py())[0])
                hosts[host] = merge(hosts[host], own) if host in hosts else own
        if len(hosts) > 2000:
            yield flush()
    yield flush()


def _unite(key, t):
    out = None
    for w in sorted(t["wrapper"].to_pylist()):
        node = Node.load(json.loads(w))
        out = node if out is None else merge(out, node)
    return pa.table({"host": [t["host"][0].as_py()], "wrapper": [json.dumps(out.dump())]})


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): one expression a host. Tasks align their own pages, then the expressions of tasks are aligned,
    first in salted groups, so no task gets more than a share of a host's."""
    given = pages.where(F.col(html_col).isNotNull()).select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    schema = "host string, wrapper string"
    parts = given.mapInArrow(_learn, schema)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(32))).groupBy("host", "salt").applyInArrow(_unite, schema)
    return salted.groupBy("host").applyInArrow(_unite, schema)


def _places(batches):
    for b in batches:
        found = [json.dumps(read_rules(Node.load(json.loads(w)))) for w in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["host", "places"])


def _extract(batches):
    known: dict[str, dict] = {}
    for b in batches:
        texts = []
        for page, places in zip(b.column(2), b.column(3).to_pylist()):
            text = ""
            if page.is_valid:
                root, blocks = parse(page.as_py())
                if places and places not in known:
                    known[places] = json.loads(places)
                text = take(blocks, known[places]) if places else None
                if text is None:
                    text = take(blocks, read_rules(fold_all(root))) or ""
                if len(known) > 5000:
                    known.clear()
            texts.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text (blocks joined by a line break), n_chars (code points).

    Elements named for menus, headers, sidebars and the like by a whole word of their class, id or role are left out,
    unless the word comes with a modifier or nothing else is left of a page with LEAST_TEXT characters of text. A heading
    in an article's own header is main text, the rest of that header is not. From TEMPLATE_PAGES pages of a host on, text
    that all of them have at one place goes, so the same page may give less on a host with more pages; places that weigh
    the same are taken by name. Null and empty html give an empty text; a null url or one without a host belongs to the host ''; a page that its
    host's wrapper does not fit is read by its own expression; pages of any length are read whole; repeated pages stay
    repeated; an empty table gives an empty result; other columns are not read. The rules rest on sums over a host's
    pages and on texts that all of them have, so tasks may align them in any order; only optional groups that stand in
    another order on other pages can make a difference.
    """
    places = materialize(infer_wrappers(pages, url_col, html_col).mapInArrow(_places, "host string, places string"))
    asked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = asked.join(places, "host", "left").select("page_id", "url", "html", "places")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op3_wrappers": op3_wrappers}
ORACLES: dict[str, str] = {}
