"""The site style tree and site quality against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlode.llm import site_quality, site_tree

from .nasty import CLASHING, empty, frame, words

# the tree of a page


@pytest.mark.parametrize(
    ("page", "shape"),
    [
        ("<p>a<p>b", "[p[#text] p[#text]]"),
        ("<p><b>a<p>c</b>d", "[p[b[#text]] p[#text #text]]"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "[ul[li[#text] li[#text ul[li[#text]]] li[#text]]]"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "[table[tr[td[#text] td[#text]] tr[td[#text]]]]"),
        ("</div>a<br>b<img src=x>", "[#text br #text img[#media]]"),
        ("<script>var a='<p>';</script><style>p{}</style><!-- <p> -->x", "[#text]"),
        ("<a href='u'>t</a>", "[a[#link #text]]"),
        ("<!-- never ends <p>a", ""),
        ("a < b <3", "[#text]"),
        ("<div title=\"a>b\" class='z'>x</div>", "[div[#text]]"),
        ("<div title=\"open>x", "[div[#text]]"),
        ("", ""),
        ("  \n ", ""),
    ],
)
def test_trees(page, shape):
    def show(n):
        return n.tag + ("[" + " ".join(map(show, n.kids)) + "]" if n.kids else "")

    assert show(site_tree.parse(page)).removeprefix("#page") == shape


def test_deep_elements_close_themselves():
    keys = set()
    for deep in (1, 20, 28):
        page = "<div>" * 20 + "<div>" * deep + "x" + "</div>" * deep + "<footer>all rights</footer>" + "</div>" * 20 + "<nav>n</nav>"
        root = site_tree.parse(page)
        assert [k.tag for k in root.kids] == ["div", "nav"]
        found = list(site_tree.nodes(root, "h"))
        assert max(x[4] for x in found) == 20 + deep + 1
        own = site_tree.item(site_tree.Node("#text", "#text", "all rights"), 0)
        keys |= {x[0] for x in found if x[1] == own}
    assert len(keys) == 1


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "<li></li>" * 20_000, "<li><ul>" + "<b>" * 20_000 + "<li></li>" * 20_000])
def test_items_in_deep_pages_take_little_time(page):
    test_hostile_pages_take_little_time(page)


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "<" * 50_000, "<a '" * 30_000, "</p>" * 50_000, "<!--" * 50_000, "<script>" * 20_000, "<li>" * 20_000, "x" * 500_000, '<a b="' * 20_000])
def test_hostile_pages_take_little_time(page):
    import time

    began = time.perf_counter()
    root = site_tree.parse(page)
    site_tree.render(root, "h", frozenset())
    list(site_tree.nodes(root, "h"))
    assert time.perf_counter() - began < 5


# importance, by the definition


def brute(pages, threshold, gamma=site_tree.GAMMA):
    """{page: (text, removed, lost)} by trees of dictionaries."""
    hosts = defaultdict(list)
    for host, html in dict.fromkeys(pages):
        if html is not None:
            hosts[host].append(site_tree.parse(html))
    low = set()
    for host, roots in hosts.items():

        def visit(path, nodes):
            """Composite importance of the element at a path from its occurrences, and the greatest within."""
            m = len(nodes)
            leaf = nodes[0].content is not None
            kinds = Counter(site_tree.item(n, 0) for n in nodes)
            own = 1.0 if m == 1 else -sum(c / m * math.log(c / m, m) for c in kinds.values())
            top = 0.0
            if leaf:
                value = own
            else:
                inner = 0.0
                for style, c in kinds.items():
                    members = [n for n in nodes if site_tree.item(n, 0) == style]
                    kids = [visit((*path, style, i), [n.kids[i] for n in members]) for i in range(len(members[0].kids))]
                    top = max([top, 1.0 if c == 1 else 0.0, *(t for _, t in kids)])
                    inner += c / m * (1.0 if c == 1 else sum(v for v, _ in kids) / len(kids) if kids else 0.0)
                value = (1 - gamma ** len(kinds)) * own + gamma ** len(kinds) * inner
            if m == 1:
                value = 1.0
            top = max(top, value)
            if top < threshold and m > 1:
                low.add((host, path))
            return value, top

        if roots:
            visit((), roots)

    def texts(host, path, n, dead, out):
        if not dead and (host, path) in low and n.tag not in ("#page", "html", "body"):
            dead = True
            out[1] += 1
        if n.content is not None:
            if n.tag == "#text":
                if dead:
                    out[2] += len(n.content)
                else:
                    out[0].append(n.content)
            return
        own = site_tree.item(n, 0)
        edge = n.tag in site_tree._LINES and not dead
        out[0] += ["\n"] * edge
        for i, k in enumerate(n.kids):
            texts(host, (*path, own, i), k, dead, out)
        out[0] += ["\n"] * edge

    result = []
    for host, html in pages:
        if html is None:
            result.append((host, None, 0, 0))
            continue
        out = [[], 0, 0]
        texts(host, (), site_tree.parse(html), False, out)
        lines = [" ".join(x.split()) for x in "".join(x if x == "\n" else x.replace("\n", " ") for x in out[0]).split("\n")]
        result.append((host, "\n".join(x for x in lines if x), out[1], out[2]))
    return result


def site(seed=3):
    draw = random.Random(seed)
    pages = []
    for i in range(14):
        host = f"h{i % 2}.example"
        body = "".join(f"<p>{words(draw, 8)}</p>" for _ in range(draw.randint(1, 4)))
        side = "<div class=ad>Buy now &amp; save</div>" if draw.random() < 0.7 else ""
        pages.append((f"https://{host}/p/{i}", f"<html><head><title>{words(draw, 3)}</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>{side}<article><h1>{words(draw, 3)}</h1>{body}</article><footer>All rights reserved {2000 + i}</footer></body></html>"))
    return pages


def pages_frame(spark, data):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(data)], "page_id long, url string, html string")
    return df.withColumns({c: F.lit("x") for c in (*CLASHING, "node", "text", "removed")})


@pytest.mark.parametrize("limit", [site_tree.BROADCAST_NODES, 0])
def test_extraction_is_that_of_brute_force(spark, limit):
    data = site() + [("https://h0.example/null", None), ("https://h0.example/empty", ""), (None, "<p>lone"), ("not a url", "<p>lone</p>"), ("http://one.example/", "<nav>Home</nav><p>Text")]
    data += data[:2]  # repeated rows
    want = brute([(("" if not u or "://" not in u else u.split("/")[2]), h) for u, h in data], site_tree.THRESHOLD)
    got = site_tree.extract(pages_frame(spark, data), broadcast_nodes=limit).orderBy("page_id").collect()
    assert [(r["host"], r["text"], r["removed"], r["lost"]) for r in got] == want
    assert "Home" not in got[0]["text"] and "rights reserved" not in got[0]["text"] and got[0]["removed"] >= 2
    assert "Home" in got[18]["text"]  # a host of one page loses nothing


def test_no_pages(spark):
    assert site_tree.extract(pages_frame(spark, []).limit(0)).collect() == []
    assert [r["text"] for r in site_tree.extract(pages_frame(spark, [("http://a.example/", None)])).collect()] == [None]


# quality


def labelled(seed=2, n=240):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = draw.random() < (0.8 if i % 4 == 0 else 0.1)
        text = words(draw, draw.randint(30, 90))
        if bad:
            text = " ".join(w.upper() + "!!!" if draw.random() < 0.7 else w + "$$$" for w in text.split())
        docs.append((i, text, "aa" if i % 2 else "bb", f"s{i % 4}", 1))
        if i % 3:
            labels.append((i, int(not bad), 0))
    return docs, labels, {d[0]: int("!" not in d[1]) for d in docs}


def test_quality_of_held_out_documents(spark):
    docs, labels, truth = labelled()
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("host", F.lit("clash"))
    out = {r["doc_id"]: r for r in site_quality.site_quality(df, lab).collect()}
    held = [i for i in truth if i % 3 == 0]
    assert np.mean([out[i]["kept"] == bool(truth[i]) for i in held]) >= 0.97
    rate = {r["host"]: r["host_rate"] for r in out.values()}
    assert rate["s0"] < 0.5 < min(rate["s1"], rate["s2"], rate["s3"])


def test_posteriors_are_those_of_the_definition(spark):
    draw = random.Random(7)
    rows = [(i, draw.choice(["h0", "h1", "h2", "h3", None]), draw.choice(["x", "y", None]), draw.gauss(0, 2), draw.choice([None, None, 0.0, 1.0])) for i in range(200)]
    rows += [(200 + i, "small", "x", 3.0, None) for i in range(2)]
    out = {r["doc_id"]: r for r in site_quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double, good double")).collect()}
    good = {r[0]: r[4] if r[4] is not None else 1 / (1 + math.exp(-r[3])) for r in rows}

    def group(key):
        n, k = Counter(), Counter()
        for r in rows:
            n[key(r)] += 1
            k[key(r)] += good[r[0]]
        return n, k

    def strength(n, k, around):
        seen = sum((k[g] - n[g] * around[g]) ** 2 for g in n if n[g] > 1)
        free = sum(n[g] * around[g] * (1 - around[g]) for g in n if n[g] > 1)
        more = sum(n[g] * around[g] * (1 - around[g]) * (n[g] - 1) for g in n if n[g] > 1)
        r = min(1.0, max(1 / site_quality.STRONGEST, (seen - free) / more))
        return 1 / r - 1 if r < 1 else 0.01

    hn, hk = group(lambda r: r[1])
    pn, pk = group(lambda r: (r[1], r[2]))
    rate = sum(good.values()) / len(good)
    s = strength(hn, hk, {g: rate for g in hn})
    host = {g: (hk[g] + s * rate) / (hn[g] + s) for g in hn}
    t = strength(pn, pk, {g: host[g[0]] for g in pn})
    for r in rows:
        g = r[1], r[2]
        prior = min(1 - 1e-6, max(1e-6, (pk[g] - good[r[0]] + t * host[r[1]]) / (pn[g] - 1 + t)))
        q = 1 / (1 + math.exp(-(r[3] + math.log(prior / (1 - prior)))))
        assert out[r[0]]["host_rate"] == pytest.approx(host[r[1]], abs=2e-6)
        assert out[r[0]]["path_rate"] == pytest.approx((pk[g] + t * host[r[1]]) / (pn[g] + t), abs=2e-6)
        assert out[r[0]]["quality"] == pytest.approx(q, abs=2e-6) and out[r[0]]["kept"] == (out[r[0]]["quality"] >= 0.5)


def test_quality_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = site_quality.site_quality(frame(spark), none).collect()
    assert len(out) == frame(spark).count() and {r["quality"] for r in out} == {0.5}
    some = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 0, 1), (2, None, 0), (None, 1, 0), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert site_quality.site_quality(frame(spark), some).count() == frame(spark).count()
    assert site_quality.site_quality(empty(spark), some).collect() == []


def test_measures_of_empty_texts():
    import pyarrow as pa

    m = site_quality.measures(pa.array(["", None, "a a b!", "é É 9\n"]))
    assert np.isfinite(m).all() and (m[:2] == 0).all()
    assert m[2][site_quality.MEASURES.index("exclaims")] == pytest.approx(1 / 4)


# independent of the parser: trees of the standard library's


def independent(pages, threshold, gamma=site_tree.GAMMA):
    """The words that stay of every page of one host; pages are well-formed."""
    from html.parser import HTMLParser

    class Builder(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack = [["#page", [], None]]

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            node = [f"{tag}.{' '.join(sorted((a.get('class') or '').split()))}#{a.get('id') or ''}", [], None]
            self.stack[-1][1].append(node)
            self.stack.append(node)
            if "href" in a and tag == "a":
                node[1].append(["#link", [], a["href"]])

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            if data.strip():
                self.stack[-1][1].append(["#text", [], data])

    roots = []
    for page in pages:
        b = Builder()
        b.feed(page)
        b.close()
        roots.append(b.stack[0])
    low = set()

    def held(n):
        if n[2] is None:
            return tuple(k[0] for k in n[1])
        return "".join("0" if c.isdigit() and (i == 0 or not n[2][i - 1].isdigit()) else "" if c.isdigit() else c for i, c in enumerate(n[2])).lower().split()

    def score(group):
        """Composite importance of one node from its occurrences, by entropy in natural logarithms, and the greatest within."""
        styles = defaultdict(list)
        for n in group:
            styles[str(held(n))].append(n)
        m = len(group)
        if m == 1:
            return 1.0, 1.0
        own = sum(len(g) / m * (math.log(m) - math.log(len(g))) for g in styles.values()) / math.log(m)
        total, within = own, [0.0]
        if group[0][2] is None:
            inner = 0.0
            for g in styles.values():
                kids = [score([n[1][i] for n in g]) for i in range(len(g[0][1]))]
                within += [1.0] if len(g) == 1 else [t for _, t in kids]
                inner += len(g) / m * (1.0 if len(g) == 1 else sum(v for v, _ in kids) / len(kids) if kids else 0.0)
            damp = gamma ** len(styles)
            total = own - damp * own + damp * inner
        if max(total, *within) < threshold:
            low.update(map(id, group))
        return total, max(total, *within)

    score(roots)

    def words_of(n):
        if id(n) in low and n[0] not in ("#page", "html.#", "body.#"):
            return []
        return n[2].split() if n[0] == "#text" else [w for k in n[1] for w in words_of(k)]

    return [words_of(r) for r in roots]


def test_extraction_is_that_of_another_parser(spark):
    draw = random.Random(41)
    pages = []
    for i in range(24):
        side = '<div class="ad box"><b>Buy now</b> and save</div>' if draw.random() < 0.6 else ""
        menu = "".join(f"<li><a href='/{x}'>{x} page</a></li>" for x in ("home", "about", "news")[: draw.randint(2, 3)])
        body = "".join(f"<p>{words(draw, 8)}</p>" for _ in range(draw.randint(1, 4)))
        pages.append(f"<html><head><title>{words(draw, 3)}</title></head><body><nav id='top'><ul>{menu}</ul></nav>{side}<article><h1>{words(draw, 3)}</h1>{body}</article><footer>Rights reserved {2000 + i}</footer></body></html>")
    for threshold in (0.1, 0.3, 0.6):
        got = {r["page_id"]: r["text"].split() for r in site_tree.extract(pages_frame(spark, [(f"http://one.example/{i}", p) for i, p in enumerate(pages)]), threshold).collect()}
        want = independent(pages, threshold)
        assert [got[i] for i in range(len(pages))] == want
        assert threshold > 0.5 or any("reserved" not in w for w in want)


def test_deep_and_long_pages_are_extracted(spark):
    draw = random.Random(42)
    long = words(draw, 30_000)
    pages = [f"<body>{'<div>' * 40}<p>{words(draw, 9)} {i}</p>{'</div>' * 40}<footer>same foot</footer></body>" for i in range(6)] + [f"<body><p>{long}</p><footer>same foot</footer></body>"] * 2
    out = {r["page_id"]: r for r in site_tree.extract(pages_frame(spark, [(f"http://one.example/{i}", p) for i, p in enumerate(pages)])).collect()}
    assert all("same foot" not in out[i]["text"] for i in range(6)) and len({out[i]["text"] for i in range(6)}) == 6
    assert all(len(out[i]["text"].split()) >= 30_000 for i in (6, 7))


def test_quality_with_labels_of_one_class_only(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    rows_ = site_quality.site_quality(docs, labels).collect()
    assert {r["evidence"] for r in rows_} == {0.0} and all(0 < r["quality"] < 1 for r in rows_)
