"""Main text of web pages by wrappers: union-free regular expressions over the token streams of a host's pages.

A page is a stream of block tags and text runs. Equal neighbours, and groups of up to PERIOD tags that stand again and again, become
repeated groups; the streams of one host are then aligned with one another, level by level: what only some pages have becomes
optional, what differs in text is a text slot. Over all pages of the host it is counted how many have a slot, how much text and how
much of it in links, and whether it is the same everywhere, which tells the article's slots from the template's. A page is then
aligned with its host's wrapper and the text of the article's slots is taken from it.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import discard, materialise

#: Longest group of different tags that is recognised when it stands several times in a row.
PERIOD = 6
#: Elements that are nested deeper are attached to the one at this depth; their text stays where it is.
DEPTH = 64
#: Bytes of a table by host that are broadcast; a larger one is joined by host and salt.
BROADCAST_BYTES = 16 << 20
SALTS = 32

# fixed values: HTML's elements by what they mean for reading
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
BLOCK = frozenset(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th blockquote pre figure figcaption address details summary fieldset legend center search"
    " nav header footer aside form button select option optgroup datalist dialog template svg math canvas object audio video map menu picture progress meter".split()
)
TAG_KINDS = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "search": "form", "button": "form", "select": "form", "datalist": "form", "fieldset": "form", "dialog": "notice", "template": "code",
    "svg": "code", "math": "math", "canvas": "code", "object": "code", "audio": "code", "video": "code", "map": "code", "head": "code", "progress": "form", "meter": "form",
}
ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "alert": "notice", "alertdialog": "notice", "dialog": "notice", "main": "main"}
#: Words of classes and ids that name what is not the article, and those that name it.
WORDS = {
    word: kind
    for kind, words in {
        "advert": "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners",
        "notice": "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription paywall",
        "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager skip",
        "aside": "sidebar sidebars widget widgets related recommended recommendations share sharing social",
        "footer": "footer",
        "header": "header masthead topbar",
        "comments": "comment comments disqus respond reply replies",
        "form": "login signup",
    }.items()
    for word in words.split()
}
ARTICLE_WORDS = frozenset("article post entry content story".split())
NEGATIONS = frozenset("no not has have with without is hide show".split())
#: Which open elements a start tag ends, up to which element.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}
NO_P = BLOCK - {"html", "head", "body", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup", "option", "optgroup", "button", "select", "svg", "math", "canvas", "object", "audio", "video", "map", "picture", "template", "progress", "meter", "datalist"}
P_SCOPE = frozenset({"td", "th", "caption", "button", "object", "table"})
KEEPS = {"main", "article"}  # elements in which a header belongs to the article

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(1 << 14)
def kind(tag: str, attributes: str) -> str:
    """What an element is by its tag, role, classes and id: "!kind" by tag or role, "~kind" by a word, "+" an article by a word."""
    if tag in TAG_KINDS:
        return "!" + TAG_KINDS[tag]
    if not attributes or attributes.isspace():
        return ""
    values = {}
    for name, *value in ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), "".join(value))
    if "hidden" in values or HIDDEN.search(values.get("style", "")):
        return "!code"
    role = ROLES.get(values.get("role", "").strip().lower())
    if role:
        return "!" + role
    if tag in ("html", "body", "main"):
        return ""
    words = [w.lower() for key in ("class", "id") for w in [*NAME_WORD.findall(entities.unescape(values.get(key, ""))), ""]]
    for before, word in zip(["", *words], words):
        if word in WORDS and before not in NEGATIONS:
            return "~" + WORDS[word]
    return "+" if ARTICLE_WORDS.intersection(words) and tag not in INLINE else ""


class Node:
    """An element, a group of neighbours (label in brackets), or a text run (#). texts: (number in the page, text, characters in links)."""

    __slots__ = ("kids", "label", "optional", "repeated", "texts")

    def __init__(self, label, kids=None, repeated=False, optional=False, texts=None):
        self.label, self.kids, self.repeated, self.optional, self.texts = label, kids if kids is not None else [], repeated, optional, texts


def parse(page: str) -> Node:
    """The page's elements and text runs. Inline elements are no nodes, but those that a word of theirs says to leave out."""
    root = Node("")
    stack: list[tuple[str, Node]] = [("", root)]
    run: list[str] = []
    linked, link, count, broken, muted = 0, False, 0, False, []
    opened: dict[str, int] = defaultdict(int)  # so that no search of the stack is in vain

    def flush():
        nonlocal linked, count
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                stack[-1][1].kids.append(Node("#", texts=[(count, text, min(linked, len(text)))]))
                count += 1
        linked = 0

    def close(upto: int):
        nonlocal link
        flush()
        for tag, _ in stack[upto:]:
            opened[tag] -= 1
        del stack[upto:]
        link = False

    pos, n = 0, len(page)
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos and not muted:
            run.append(page[pos:at])
            if link:
                linked += at - pos
        if at == n:
            break
        follows = page[at + 1 : at + 2]
        if not (follows.isalpha() and follows.isascii()) and follows not in ("/", "!", "?"):
            if not muted:
                run.append("<")
            pos = at + 1
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            pos = n if end < 0 else end + 3
            continue
        match = None if broken or follows in "!?" else TAG.match(page, at)
        if match is None:
            end = page.find(">", at)
            if end < 0:
                if not muted and follows not in "!?":
                    run.append(page[at:])  # no tag, for nothing ends it
                break
            if follows in "!?" or not page[at + 1 : at + 3].strip("/")[:1].isalpha():
                pos = end + 1
                continue
            broken = True  # quotes that do not close: from here on tags end at the next bracket
            inner = page[at + 1 : end]
            slash = inner.startswith("/")
            tag, _, attributes = inner.lstrip("/").partition(" ")
            tag = tag.rstrip("/").lower()
            pos = end + 1
        else:
            slash, tag, attributes = match[1] == "/", match[2].lower(), match[3]
            pos = match.end()
        if tag in RAW and not slash:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
            pos = n if end is None else (page.find(">", end.end()) + 1 or n)
            continue
        if tag == "br" or tag == "hr":
            if not muted:
                run.append("\n")
            if tag == "hr" and not muted:
                flush()
            continue
        if tag in VOID:
            continue
        if tag not in BLOCK:
            if muted:
                if tag == muted[0]:
                    muted += [tag] if not slash else []
                    if slash:
                        muted.pop()
            elif tag == "a":
                link = not slash and "href" in attributes
            if not muted and not slash and not attributes.endswith("/") and kind(tag, attributes)[:1] in ("!", "~"):
                muted = [tag]
            continue
        muted = []
        if slash:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                flush()
            continue
        flush()
        if opened["p"] and tag in NO_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in P_SCOPE:
                    break
        if tag in ENDS:
            ended, scope = ENDS[tag]
            first = None
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ended) else ():
                if stack[k][0] in scope:
                    break
                if stack[k][0] in ended:
                    first = k
            if first:
                close(first)
        node = Node(tag + kind(tag, attributes))
        stack[-1][1].kids.append(node)
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        opened[tag] += 1
        stack.append((tag, node if len(stack) < DEPTH else stack[-1][1]))
    flush()
    return root


# ---------------------------------------------------------------- wrappers


def merge_nodes(a: Node, b: Node, repeated: bool) -> Node:
    """One expression for two of one label; repeated if they stand next to one another."""
    texts = None if a.texts is None and b.texts is None else [*(a.texts or []), *(b.texts or [])]
    return Node(a.label, merge_kids(a.kids, b.kids) if a.kids or b.kids else [], repeated or a.repeated or b.repeated, a.optional and b.optional, texts)


def joined(items: list[Node]) -> list[Node]:
    out: list[Node] = []
    for node in items:
        if out and out[-1].label == node.label:
            out[-1] = merge_nodes(out[-1], node, True)
        else:
            out.append(node)
    return out


def grouped(items: list[Node], labels: list[str]) -> Node:
    return Node(f"({' '.join(labels)})", items)


def fold(items: list[Node]) -> list[Node]:
    """Neighbours of one label as one repeated node, and runs of equal groups as one repeated group."""
    items = joined(items)
    for period in range(2, PERIOD + 1):
        labels, out, k = [x.label for x in items], [], 0
        while k < len(items):
            body = labels[k : k + period]
            if len(body) == period and labels[k + period : k + 2 * period] == body:
                out.append(grouped(items[k : k + period], body))
                k += period
                while labels[k : k + period] == body:
                    out.append(grouped(items[k : k + period], body))
                    k += period
            else:
                out.append(items[k])
                k += 1
        if len(out) < len(items):
            items = joined(out)
    return items


def folded(node: Node) -> Node:
    return Node(node.label, fold([folded(k) if k.kids else k for k in node.kids]), False, False, node.texts)


def regroup(items: list[Node], other: list[Node]) -> list[Node]:
    """Items with the groups that the other side knows, where they stand once here."""
    for group in (x for x in other if x.label.startswith("(")):
        body = [k.label for k in group.kids]
        labels, out, k = [x.label for x in items], [], 0
        while k < len(items):
            if labels[k : k + len(body)] == body:
                out.append(grouped(items[k : k + len(body)], body))
                k += len(body)
            else:
                out.append(items[k])
                k += 1
        items = joined(out) if len(out) < len(items) else items
    return items


def align(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places."""
    places = defaultdict(list)
    for j in range(len(y) - 1, -1, -1):
        places[y[j]].append(j)
    ends: list[int] = []  # last place in y of the best sequence of each length
    chain: list[tuple] = []
    for i, label in enumerate(x):
        for j in places.get(label, ()):
            k = bisect_left(ends, j)
            link = (i, j, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    out, link = [], chain[-1] if chain else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def merge_kids(x: list[Node], y: list[Node]) -> list[Node]:
    """Alignment of two streams: matches are merged, the rest becomes optional."""
    if [n.label for n in x] == [n.label for n in y]:
        return fold([merge_nodes(a, b, False) for a, b in zip(x, y)])
    x, y = regroup(x, y), regroup(y, x)
    out, i, j = [], 0, 0
    for a, b in [*align([n.label for n in x], [n.label for n in y]), (len(x), len(y))]:
        for node in (*x[i:a], *y[j:b]):
            out.append(Node(node.label, node.kids, node.repeated, True, node.texts))
        if a < len(x):
            out.append(merge_nodes(x[a], y[b], False))
        i, j = a + 1, b + 1
    return fold(out)


def dump(node: Node) -> str:
    def plain(x):
        return [x.label, x.repeated + 2 * x.optional, *map(plain, x.kids)]

    return json.dumps(plain(node), separators=(",", ":"), ensure_ascii=False)


def load(text: str) -> Node:
    def node(x):
        return Node(x[0], [node(k) for k in x[2:]], bool(x[1] & 1), bool(x[1] & 2))

    return node(json.loads(text))


def slots(page: Node, wrapper: Node) -> list[tuple[str | None, tuple[str, ...], list]]:
    """The page's texts by slot of the wrapper: (number, labels above, texts). What the wrapper does not know has number None."""
    out: list = []

    def unknown(node, labels):
        if node.texts is not None:
            out.append((None, labels, node.texts))
        for kid in node.kids:
            unknown(kid, labels if node.label.startswith("(") else (*labels, node.label))

    def walk(node, rule, number, labels):
        if node.texts is not None:
            out.append((number, labels, node.texts))
            return
        inside = labels if node.label.startswith("(") else (*labels, node.label)
        kids = regroup(node.kids, rule.kids)
        known = dict(align([k.label for k in kids], [k.label for k in rule.kids]))
        for k, kid in enumerate(kids):
            if k in known:
                walk(kid, rule.kids[known[k]], f"{number}.{known[k]}", inside)
            else:
                unknown(kid, inside)

    walk(page, wrapper, "", ())
    return out


# ---------------------------------------------------------------- what a slot is


def left_out(labels: tuple[str, ...], dismissed: frozenset[str] = frozenset()) -> bool:
    """Whether a text stands in a menu, header, footer and so on. A header within the article is the article's."""
    inside = False
    for label in labels:
        if "!" in label or ("~" in label and label not in dismissed):
            what = re.split("[!~]", label)[1]
            if what not in ("main", "math") and not (what == "header" and inside):
                return True
        inside = inside or label in KEEPS or label.endswith(("!main", "+"))
    return False


def article_of(labels: tuple[str, ...], mode: str) -> bool:
    if mode == "main":
        return any(x == "main" or x.endswith("!main") for x in labels)
    if mode == "article":
        return any(x == "article" or x == "article+" for x in labels)
    if mode == "named":
        return any(x.endswith("+") for x in labels)
    return True


def slot_labels(wrapper: Node) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}

    def walk(node, number, labels):
        if node.label == "#":
            out[number] = labels
        inside = labels if node.label.startswith("(") else (*labels, node.label)
        for k, kid in enumerate(node.kids):
            walk(kid, f"{number}.{k}", inside)

    walk(wrapper, "", ())
    return out


def decide(wrapper: Node, stats: list[dict]) -> dict:
    """Which slots hold the article. stats: per slot its pages, characters, characters in links, and whether one text fills it
    everywhere."""
    labels = slot_labels(wrapper)
    stats = [s for s in stats if s["slot"] in labels]
    chars = lambda which: sum(s["chars"] for s in which)
    path = lambda s: labels[s["slot"]]
    # a class name that would leave out most of the text and the page's heading is no hint
    shown = [s for s in stats if not left_out(path(s), frozenset(x for x in path(s) if "~" in x))]
    hints = {x for s in shown for x in path(s) if "~" in x}
    dismissed = frozenset(h for h in hints if any(h in path(s) and ("h1" in path(s) or "main" in path(s)) for s in shown) and chars(s for s in shown if h in path(s)) > 0.6 * chars(shown))
    rest = [s for s in stats if not left_out(path(s), dismissed)]
    mode = next((m for m in ("main", "article", "named") if 2 * chars(s for s in rest if article_of(path(s), m)) >= chars(rest) * (m == "named") and any(article_of(path(s), m) for s in rest)), "page")
    kept = [s for s in rest if article_of(path(s), mode)]
    if mode == "page":
        # no element says where the article is: text that all pages share is the template's, lists of links are menus
        varies = any(not s["same"] for s in kept)
        kept = [s for s in kept if "h1" in path(s) or not (varies and s["same"] and s["pages"] > 1 or 2 * s["links"] > s["chars"])]
    return {"keep": sorted(s["slot"] for s in kept), "mode": mode, "dismissed": sorted(dismissed)}


@lru_cache(512)
def _wrapper(text: str) -> Node:
    return load(text)


@lru_cache(512)
def _rule(text: str) -> tuple[Node, frozenset, str, frozenset]:
    rule = json.loads(text)
    return load(rule["wrapper"]), frozenset(rule["keep"]), rule["mode"], frozenset(rule["dismissed"])


def main_text(page: str | None, rule: str) -> str:
    """The article's text in a page, given its host's rule."""
    wrapper, keep, mode, dismissed = _rule(rule)
    found = []
    for number, labels, texts in slots(folded(parse(page or "")), wrapper):
        if number in keep or (number is None and article_of(labels, mode) and not left_out(labels, dismissed)):
            found += texts
    return " ".join(text for _, text, _ in sorted(found))


# ---------------------------------------------------------------- kernels


def _skeletons(batches):
    for batch in batches:
        pages = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([dump(folded(parse(p or ""))) for p in pages], pa.string())], ["host", "wrapper"])


def _merge(batches):
    """Rows sorted by host (and salt) to one wrapper for each."""
    key, held, out = None, None, []
    for batch in batches:
        for host, salt, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if key == (host, salt):
                held = merge_nodes(held, load(text), False)
            else:
                if key is not None:
                    out.append((*key, dump(held)))
                key, held = (host, salt), load(text)
        if len(out) >= 256:
            yield _merged(out)
            out = []
    if key is not None:
        out.append((*key, dump(held)))
    if out:
        yield _merged(out)


def _merged(rows):
    host, salt, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(salt, pa.int32()), pa.array(text, pa.string())], ["host", "salt", "wrapper"])


def _slot_rows(batches):
    for batch in batches:
        out = []
        for host, page, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            for number, _, texts in slots(folded(parse(page or "")), _wrapper(text)):
                if number is not None:
                    whole = " ".join(t for _, t, _ in sorted(texts))
                    out.append((host, number, zlib.crc32(whole.encode("utf-8", "surrogatepass")), len(whole), sum(n for _, _, n in texts)))
        host, number, crc, size, links = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(number, pa.string()), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(links, pa.int64())], ["host", "slot", "crc", "chars", "links"])


def _rules(batches):
    for batch in batches:
        out = []
        for host, text, stats in zip(*(batch.column(c).to_pylist() for c in range(3))):
            out.append((host, json.dumps({"wrapper": text} | decide(load(text), stats or []), ensure_ascii=False)))
        host, rule = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(rule, pa.string())], ["host", "rule"])


def _texts(batches):
    for batch in batches:
        texts = [main_text(p, r) for p, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


# ---------------------------------------------------------------- jobs


def host_of(url):
    """Lower-case host of an address, without user and port; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def by_host(pages: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pages with the value of their host: broadcast if its bytes are counted under the bound, else joined by host and salt, so that
    no host is one task."""
    size = table.agg(F.sum(F.octet_length(value) + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(table), "host")
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"]).drop("salt")


def _merged_by(rows: DataFrame) -> DataFrame:
    dealt = rows.select("host", "salt", "wrapper").repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
    return arrow_map(dealt, _merge, "host string, salt int, wrapper string")


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper: the expression of all pages (host, html) of each host. Equal streams meet once, however many pages have them;
    the different ones of a host are merged by salts first."""
    streams = arrow_map(pages.select("host", "html"), _skeletons, "host string, wrapper string").distinct()
    salted = streams.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int"))
    return _merged_by(_merged_by(salted).withColumn("salt", F.lit(0))).drop("salt")


def rules(pages: DataFrame) -> DataFrame:
    """host, rule: wrapper and slots of the article, as JSON, from all pages (page_id, url, host, html)."""
    wrappers = materialise(infer(pages), "wrappers")
    found = arrow_map(by_host(pages, wrappers, "wrapper").select("host", "html", "wrapper"), _slot_rows, "host string, slot string, crc long, chars long, links long")
    stats = found.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), (F.min("crc") == F.max("crc")).alias("same"))
    lists = stats.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "chars", "links", "same")).alias("stats"))
    out = materialise(arrow_map(wrappers.join(lists, "host", "left").select("host", "wrapper", "stats"), _rules, "host string, rule string"), "host-rules")
    discard(wrappers)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty page has an empty text, and so has one without an article. Pages without an address, or with one that names no host,
    count as those of one host. Repeated rows and rows without a page_id are pages of their own. Very long pages are read whole, in
    time linear in their tags. A table without pages gives no rows. Columns other than page_id, url and html are not read.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    return arrow_map(by_host(rows, rules(rows), "rule").select("page_id", "url", "html", "rule"), _texts, "page_id long, url string, text string, n_chars long")
