"""The site style tree: odd markup, templates without telling names, copies, and entropies against a plain version."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quire.llm import queries
from quire.llm.site_style import extract_main_text, low_branches, style_rows

SCHEMA = "page_id long, url string, html string, page long, drop string, host string, salt int"
RNG = random.Random(3)


def prose(n, rng=RNG):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def table(spark, pages):
    return spark.createDataFrame([(i, u, h, 1, "d", "h", 2) for i, u, h in pages], SCHEMA).repartition(3)


def texts(spark, pages, **options):
    found = extract_main_text(table(spark, pages), **options).collect()
    assert len(found) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in found)
    return {r["page_id"]: r["text"] for r in found}


ODD = {
    "<p>a <b>b</b>c<br>d<p>e": "a bc d e",
    "<nav>menu</nav><header>top</header><p>x</p><footer>foot</footer><aside>side</aside>": "x",
    "<article><header><h1>T</h1></header><p>x<footer>tags</footer></article>": "T x",
    "<div class='cookie-notice'>c</div><div id=sidebar>s</div><div class=\"ad\">a</div>y": "y",
    "<div class='content with-sidebar'><p>kept</p></div>": "kept",
    "<div class=content><h1>T</h1><p>x</p><section class=comments><article class=comment><p>first!</article></section></div>": "T x",
    "<script>if (a<b) document.write('<p>x</p>')</script><style>p{}</style><title>t</title>body": "body",
    "<p title='a>b'>q</p><p title=\"c>d\">r": "q r",
    "a &lt;b&gt; &amp;amp; &#65;&#x42; &nbsp; &copy z": "a <b> &amp; AB © z",
    "1 < 2 and 3 > 2 <p>x</p>": "1 < 2 and 3 > 2 x",
    "<!-- c <p>no</p> -->yes<!-- open": "yes",
    "<form action=x>Name <input name=n><select><option>a</select></form>text": "text",
    "<form id=all><h1>T</h1><p>x</p></form>": "T x",
    "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><p>See <a href=3>this</a> page</p>": "See this page",
    "<article><p>x</p><ul><li><a href=1>Source</a></li><li><a href=2>Other</a></li></ul></article>": "x Source Other",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a b c",
    "<p>x <span class=share>Share</span> y</p>": "x y",
    "<div hidden>h</div><div style='display: none'>n</div>v": "v",
    "<article>short</article><div>" + "much longer text " * 5 + "</div>": "short " + " ".join(["much longer text"] * 5),
    "<article>the whole long article</article><div>teaser</div>": "the whole long article",
    "<div><div></p></div></section>text</b>": "text",
    "<div id=header>Site</div><div id=mainContent><h2>T</h2><p>x</p></div><div class=cookiebanner>c</div><div class=topnav>n</div><div id=siteFooter>f</div>": "T x",
    "<article><h1>T</h1><p>x</p></article><section><h3>3 Comments</h3><p>so long a comment that it outweighs the article by far</p></section>": "T x",
    "<p>x</p><section><h2>Commentary on law</h2><p>y</p></section>": "x Commentary on law y",
    "<div class=post><div class=post-header><h1>T</h1></div><p>x</p></div>": "T x",
    "<p": "<p",
    "": "",
}


def test_odd_markup(spark):
    pages = [(k, f"http://h{k}.org/", x) for k, x in enumerate(ODD)]
    found = texts(spark, pages)
    assert {k: found[k] for k, _, _ in pages} == dict(enumerate(ODD.values()))


def site(host, n, body, start=0):
    return [(start + k, f"https://{host}/{k}", f"<html><body>{body(k)}</body></html>") for k in range(n)]


def test_unnamed_templates(spark):
    """What stands on the pages of a host goes, wherever it stands; what only copies share stays."""
    rng = random.Random(5)
    own = [[prose(40, rng), prose(30, rng), ("Be.", "Is.", "At.")[k % 3]] for k in range(400)]
    notice = "All content is protected and may not be sold"
    shown = lambda k: "".join(f"<p>{x}</p>" for x in own[k])
    inside = site("a.org", 20, lambda k: f"<div class=k1><span>{notice}</span></div><div class=k2><h2>Title {k}</h2>{shown(k)}<p>{notice}.</p></div>")
    few = site("b.org", 2, lambda k: f"<div class=k1>{notice}</div><div class=k2>{shown(k)}</div>", 100)
    # 30 copies of one article, and 30 near copies of another, among ten pages of their own, under one template
    base = prose(200, rng).split()
    edited = lambda k: " ".join(w if (i + k) % 70 else f"edit{k}" for i, w in enumerate(base))
    same = prose(200, rng)
    copies = site("c.org", 70, lambda k: f"<div class=k1>{notice}</div><div class=k2><p>{same if k < 30 else edited(k) if k < 60 else own[k][0]}</p><p>Shared by near copies {min(k, 30) if k < 60 else k}</p></div>", 200)
    found = texts(spark, inside + few + copies)
    for k in range(20):
        assert found[k] == " ".join([f"Title {k}", *own[k]])
    for k in range(2):
        assert found[100 + k] == " ".join([notice, *own[k]])
    for k in range(70):
        want = same if k < 30 else edited(k) if k < 60 else own[k][0]
        assert found[200 + k].removeprefix(notice + " ") == f"{want} Shared by near copies {min(k, 30) if k < 60 else k}"
    assert all(notice not in found[200 + k] for k in range(70))


def test_nulls_and_repeats(spark):
    page = "<p>the text of a page</p>"
    rows = [(1, None, page), (1, None, page), (None, "no host", page), (2, "http://x.org", None), (None, None, None), (3, "://", " \n ")]
    found = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extract_main_text(table(spark, rows)).collect())
    said = "the text of a page"
    assert found == Counter([(1, None, said, 18)] * 2 + [(None, "no host", said, 18), (2, "http://x.org", "", 0), (None, None, "", 0), (3, "://", "", 0)])
    assert extract_main_text(table(spark, rows).limit(0)).count() == 0


def test_importance_brute(spark):
    rng = random.Random(8)
    bits = [prose(3, rng) for _ in range(4)]
    pages = [x for h in range(3) for x in site(f"h{h}.org", 12, lambda k: "".join(f"<div class=c{rng.randrange(3)}><p>{rng.choice(bits)}</p>{'<p>' + prose(9, rng) + '</p>' if rng.random() < 0.5 else ''}</div>" for _ in range(3)), 100 * h)]
    rows = style_rows(table(spark, pages)).cache()
    found = {r["branch"]: r["importance"] for r in low_branches(rows, threshold=0.9, least_share=0.2).collect()}
    styles, firsts, spread = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for r in rows.collect():
        styles[r["node"]][r["style"]] += 1
        firsts[r["node"]][r["class"]] += r["first"]
        spread[r["node"], r["branch"], r["leaf"]][r["class"]] += 1
    entropy = lambda c: -sum(n / c.total() * math.log(n / c.total()) for n in c.values() if n)
    wanted = {}
    for (node, branch, leaf), classes in spread.items():
        h, m, s = entropy(classes), firsts[node].total(), styles[node]
        if math.exp(h) <= max(2.5, m**0.25) or classes.total() < 0.2 * m:
            continue
        content = 1 - h / entropy(firsts[node])
        fade = 0.9 ** len(s)
        importance = content if leaf else (1 - fade) * entropy(s) / math.log(s.total()) + fade * content
        if importance <= 0.9:
            wanted[branch] = importance
    assert wanted and found.keys() == wanted.keys() and all(found[k] == pytest.approx(v) for k, v in wanted.items())


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    found = {r["page_id"]: r["text"] for r in queries.QUERIES["op11_site_style"](spark, folder).collect()}
    for r in pages:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert found[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
