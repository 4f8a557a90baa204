"""Main text of web pages by a site style tree: pages of a host are merged, and branches that carry little are removed.

Every page is parsed into its block elements; inline elements are part of their block's text. The elements of all pages
of a host that have the same chain of tags and classes are one node of the host's style tree. A node's presentation
importance is the entropy of the child sequences (styles) it has, by the logarithm of their number of uses; a branch's
content importance is one minus the entropy of the pages that hold its text by that of all pages of the node. As in Yi, Liu and Li
(2003) the importance of a node with l styles is (1 - 0.9^l) presentation + 0.9^l content, that of a leaf its content.
A branch of a page is removed if its importance is at most `threshold` and it stands on at least `least_share` of the
node's pages. Copies of an article must not make it look like a template, so pages are counted by a min-hash class of
their longest block: text that only copies and near copies of one page share has little entropy. What is removed must
have the entropy of at least 2.5 pages evenly, and of the fourth root of the node's pages, beyond what near copies have that
fall into other classes by chance.

Some roles have importance 0 whatever their entropy: elements that by tag, ARIA role, class or id are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or reader comments, and what stands outside <article> or
<main> where these hold at least half of the text.

Spark: a page becomes rows of 64-bit hashes (node, style, branch, class), one per element; counts are taken by two
groupings each, so that the nodes of a large host are added up where they are read. Branches to be removed are looked up
by the rows, salted, and pages are told apart by a hash of url and html. Only pages that lose a branch move; all others
are cut where they are read.

Defined cases: null html is empty; null urls or urls without a host are a host of their own; a host of fewer than three
different pages loses nothing by entropy; equal rows give equal rows; an empty table gives an empty result; other columns
are ignored. A page is parsed whole, in one task.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, flagged, released, stored

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is no markup; what follows an open one belongs to it.
RAW = frozenset("script style title textarea noscript template iframe svg canvas object audio video select".split())
OUT = RAW | frozenset("nav aside footer form menu dialog button fieldset datalist option".split())
#: Open elements that a start tag closes, up to the nearest of the elements named last.
CLOSES = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADING_LEVELS = {f"h{k}": k for k in range(1, 7)}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Words of a class or id that name a role.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted banner "
    "nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs sidebar sidebars sidenav footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription signup login signin search searchbox searchform form "
    "comment comments respond reply replies disqus share sharing sharebar social related recommended recommendations "
    "popup popups modal overlay widget widgets pagination pager paging copyright disclaimer announcement skiplink teaser teasers trending feedback".split()
)
#: Stems of words that are written as one, such as cookiebanner or topnav.
STEMS = re.compile(r"(?:cookie|advert|sponsor|newsletter|comments?(?!ar)|sidebar|footer|navbar|breadcrumb|subscri|disqus)\w*|\w+(?:nav|footer|sidebar|comments|banner|menu)")
OF_HEADERS = frozenset("header masthead banner topbar siteheader pageheader".split())
#: What a block of reader comments is headed by.
COMMENT_HEADS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments|responses|replies|kommentare|commentaires|comentarios|leave a (?:comment|reply))\b", re.I)
#: Words beside those that say that a class speaks of the article itself or only of its layout.
OF_ARTICLES = frozenset("article post entry content story body title".split())
LAYOUT = frozenset("with has no without".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(maxsize=1 << 14)
def described(tag: str, attributes: str) -> tuple[str, str]:
    """The key of an element in the tree, and its role.

    Roles: "out" goes; "soft" goes unless it holds the article or its title; "header" and "head", by tag and by class, go
    unless they hold a heading inside an article, "head" also stays if it holds the article; "article"; "main"; or "".
    """
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    classes, role = found.get("class", ""), found.get("role", "").lower()
    key = f"{tag}.{' '.join(sorted(classes.split()))}"
    if (tag in OUT and tag != "form") or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower() or role in ROLES - {"form", "banner"}:
        return key, "out"
    # headings are named after what they say
    for name in classes.split() if tag in HEADINGS else [*classes.split(), found.get("id", "")]:
        words = {w.lower() for w in _NAME.findall(name)}
        if words & OF_HEADERS and not words & OF_ARTICLES:
            return key, "head"
        if (words & WORDS - OF_HEADERS or any(map(STEMS.fullmatch, words - OF_HEADERS))) and not words & LAYOUT:
            return key, "soft"
    if tag == "form" or role == "form":
        return key, "soft"
    if tag == "header" or role == "banner":
        return key, "header"
    if tag == "article" or found.get("itemprop", "").lower() == "articlebody":
        return key, "article"
    return key, "main" if tag == "main" or role == "main" else ""


class Node:
    """A block element: what it holds are strings and nodes in page order."""

    __slots__ = ("tag", "key", "role", "held", "text", "heading", "article", "links", "linked")

    def __init__(self, tag: str, key: str, role: str):
        self.tag, self.key, self.role, self.held, self.text = tag, key, role, [], ""
        # its highest heading, whether it holds an article, the links in it and the characters of their texts
        self.heading, self.article, self.links, self.linked = 9, False, 0, 0


def _close(stack: list[Node], tag: str) -> None:
    """Closes what the start of a block element ends: an open paragraph, or the like of it in a list or table."""
    closes, within = CLOSES.get(tag, ({"p"}, None))
    for k in range(len(stack) - 1, 0, -1):
        open_tag = stack[k].tag
        if open_tag in closes:
            del stack[k:]
            if within is None:
                return
        elif open_tag not in INLINE and (within is None or open_tag in within):
            return


def parse(page: str) -> Node:
    """The tree of a page's block elements, without comments and elements that hold no markup."""
    root = Node("", "", "")
    stack, at, link = [root], 0, False

    def say(text: str) -> None:
        if text:
            text = entities.unescape(text) if "&" in text else text
            stack[-1].held.append(text)
            if link:
                stack[-1].linked += len("".join(text.split()))

    while (m := _TOKEN.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            link = link and tag != "a"
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
        elif tag in RAW:
            shut = re.compile(rf"</{tag}\s*+[^>]*+>", re.I).search(page, at)
            at = shut.end() if shut else len(page) if tag in ("script", "style", "title", "textarea") else at
        elif tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].held.append(" ")
        elif tag not in ("html", "head", "body"):
            key, role = described(tag, m[3])
            if tag == "a":
                link = True
                stack[-1].links += 1
            if tag not in INLINE:
                _close(stack, tag)
            elif role not in ("out", "soft"):
                continue
            stack[-1].held.append(Node(tag, key, role))
            stack.append(stack[-1].held[-1])
    say(page[at:])
    return root


def _goes(x: Node, inside: bool) -> bool:
    """Whether a weighed branch goes by its role. inside: it stands in an article or main element."""
    titled = inside and x.heading < 9
    # a list of links outside the article is a menu
    menu = not inside and not x.article and x.role not in ("article", "main") and x.links > 1 and 10 * x.linked >= 9 * len("".join(x.text.split()))
    comments = 1 < x.heading < 9 and x.tag not in HEADINGS and not x.article and COMMENT_HEADS.match(x.text) is not None
    return menu or comments or (x.role == "header" and not titled) or (x.role == "head" and not (titled or x.article)) or (x.role == "soft" and not (x.article or x.heading == 1))


def _weigh(node: Node, inside: bool) -> None:
    """Removes branches by their roles, bottom up, and sums up the others."""
    held, texts, run = [], [], []
    inside = inside or node.role in ("article", "main")
    node.heading = HEADING_LEVELS.get(node.tag, 9)
    for x in node.held:
        if isinstance(x, str):
            run.append(x)
        else:
            if x.role == "out":
                continue
            _weigh(x, inside)
            if _goes(x, inside):
                continue
            if x.tag in INLINE:
                run.append(x.text)
            else:
                texts += [" ".join("".join(run).split()), x.text]
                run = []
            node.heading, node.article = min(node.heading, x.heading), node.article or x.article or x.role in ("article", "main")
            node.links, node.linked = node.links + x.links, node.linked + x.linked
        held.append(x)
    node.held = held
    node.text = "".join(run) if node.tag in INLINE else " ".join(filter(None, [*texts, " ".join("".join(run).split())]))


def _with_role(node: Node, role: str) -> list[Node]:
    """The topmost branches of a role, in page order."""
    found = []
    for x in node.held:
        if not isinstance(x, str):
            found += [x] if x.role == role else _with_role(x, role)
    return found


def article_of(page: str) -> list[Node]:
    """The branches of a page that remain by their roles, in page order."""
    root = parse(page)
    _weigh(root, False)
    for role in ("article", "main"):
        found = _with_role(root, role)
        if found and 2 * sum(len(x.text) for x in found) >= len(root.text):
            return found
    return [root]


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _branches(host: str, found: list[Node], drop: frozenset[int] = frozenset()) -> tuple[list[tuple[int, int, int, bool]], str]:
    """(node, style, branch, is a leaf) of all branches with text, those of `drop` left out, and the text that remains."""
    rows, kept = [], []

    def walk(node: Node, path: str) -> None:
        blocks = [x for x in node.held if not isinstance(x, str) and x.tag not in INLINE]
        key = f"{path}>{node.key}"
        branch = _hash(host, key, node.text)
        if branch in drop:
            return
        rows.append((_hash(host, key), _hash("|".join(x.key for x in blocks)), branch, not blocks))
        if not blocks:
            kept.append(node.text)
            return
        run = []
        for x in [*node.held, None]:
            if x is None or not isinstance(x, str) and x.tag not in INLINE:
                own, run = " ".join("".join(run).split()), []
                if own:
                    own_branch = _hash(host, key, "#text", own)
                    rows.append((_hash(host, key, "#text"), 0, own_branch, True))
                    if own_branch not in drop:
                        kept.append(own)
                if x is not None and x.text:
                    walk(x, key)
            else:
                run.append(x if isinstance(x, str) else x.text)

    for x in found:
        if x.text:
            walk(x, "")
    return rows, " ".join(kept)


def _class_of(blocks: list[str]) -> int:
    """Min-hash of the longest block: over the 16 bytes from the start of each of its words."""
    longest = max(blocks, key=lambda x: (len(x), x)).encode("utf-8", "surrogatepass")
    padded = np.frombuffer(longest + b" " * 16, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(padded[:-16] == 32) + 1))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 16)[np.minimum(starts, len(longest))]
    halves = np.ascontiguousarray(windows).view("<u8")
    with np.errstate(over="ignore"):
        mixed = (halves[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (halves[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return int(mixed.min().astype(np.int64))


def _leaves(found: list[Node]) -> Iterator[str]:
    for x in found:
        blocks = [y for y in x.held if not isinstance(y, str) and y.tag not in INLINE]
        if not blocks:
            yield x.text
        else:
            yield from _leaves(blocks)


def _with_host(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), F.xxhash64(url, "html").alias("page"), F.coalesce("html", F.lit("")).alias("html"))


def style_rows(pages: DataFrame) -> DataFrame:
    """(page, node, style, branch, class, leaf, first): one row per different branch of a page; first: the first of its node there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, host, html in zip(*(c.to_pylist() for c in batch.columns)):
                found = article_of(html)
                branches, text = _branches(host, found)
                if not text:
                    continue
                kind = _class_of([x for x in _leaves(found) if x] or [text])
                seen = set()
                for node, style, branch, leaf in dict.fromkeys(branches):
                    out.append((page, node, style, branch, kind, leaf, node not in seen))
                    seen.add(node)
            if out:
                types = [pa.int64()] * 5 + [pa.bool_()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["page", "node", "style", "branch", "class", "leaf", "first"])

    return _with_host(pages).select("page", "host", "html").mapInArrow(rows, "page long, node long, style long, branch long, class long, leaf boolean, first boolean")


def _entropy(n: str = "n"):
    return F.log(F.sum(n)) - F.sum(F.col(n) * F.log(F.col(n))) / F.sum(n)


#: Copies of the smaller side of a join whose keys may be hot.
SALTS = 32


def low_branches(rows: DataFrame, threshold: float = 0.5, least_share: float = 0.5) -> DataFrame:
    """(branch, importance): branches that are to be removed from pages. rows: as style_rows, stored."""
    styles = rows.groupBy("node", "style").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("long")).alias("firsts"))
    nodes = styles.groupBy("node").agg(F.sum("firsts").alias("pages"), F.count("*").alias("styles"), F.try_divide(_entropy(), F.log(F.sum("n"))).alias("presentation"))
    spread = rows.groupBy("node", "branch", "leaf", "class").agg(F.count("*").alias("n"))
    spread = spread.groupBy("node", "branch", "leaf").agg(F.sum("n").alias("on"), _entropy().alias("entropy"))
    classes = rows.where("first").groupBy("node", "class").agg(F.count("*").alias("n")).groupBy("node").agg(_entropy().alias("highest"))
    content = 1 - F.try_divide(F.col("entropy"), F.col("highest"))
    fade = F.pow(F.lit(0.9), F.col("styles"))
    importance = F.when(F.col("leaf"), content).otherwise((1 - fade) * F.coalesce("presentation", F.lit(1.0)) + fade * content)
    found = spread.where(F.exp("entropy") > 2.5).join(nodes, "node").join(classes, "node").withColumn("importance", importance)
    found = found.where((F.col("on") >= least_share * F.col("pages")) & (F.exp("entropy") > F.pow("pages", F.lit(0.25))))
    return found.where(F.col("importance") <= threshold).select("branch", "importance")


def extract_main_text(pages: DataFrame, threshold: float = 0.5, least_share: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""
    rows = stored(style_rows(pages), "page-styles")
    # a branch, and copies of a page, may stand on a third of all rows: they are dealt to so many copies of the other side
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    met = rows.select("page", "branch", dealt).join(low_branches(rows, threshold, least_share).select("branch", salts), ["branch", "salt"])
    losing = stored(met.groupBy(F.col("page").alias("losing")).agg(F.collect_set("branch").alias("drop")), "page-losses")
    released(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page_id, url, *rest = batch.columns
            texts = [_branches(host, article_of(html), frozenset(drop or ()))[1] for host, html, drop in zip(*(c.to_pylist() for c in rest))]
            yield pa.RecordBatch.from_arrays([page_id, url, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    doubtful = flagged(_with_host(pages), F.col("page"), losing)
    whole = doubtful.where("NOT quire__maybe").select("page_id", "url", "host", "html", F.lit(None).cast("array<long>").alias("drop"))
    less = doubtful.where("quire__maybe").select("*", dealt).join(losing.select(F.col("losing").alias("page"), "drop", salts), ["page", "salt"], "left")
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return whole.unionByName(less.select(*whole.columns)).mapInArrow(cut, f"{kinds}, text string, n_chars long")
