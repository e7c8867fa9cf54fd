import html
import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from tallyfold.llm import html_text as op

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>menu<li>two</ul></nav><!-- <p>hidden</p> -->
<div class='cookie-notice'><p>We use cookies</p></div><form><p>sign up</p></form>
<article class="post"><header><h1>Title &lt;1&gt;</h1></header><p>One <b>bold</b>word&nbsp;and
  <a href="/x?a=1>2">link</a>.<br>After<p>Two &#233; a < b<div class="share-buttons">share</div><div class="ad">buy</div>
<aside>side</aside><section id="comments"><p>first!</p></section><ul><li>x</li><li>y</li></ul></article>
<div id="sidebar">s</div><footer>&copy; us</footer></body></html>"""


def test_markup():
    zones = op.page_blocks(PAGE)
    assert [t for z, t in zones if z == op.ARTICLE] == ["Title <1>", "One boldword and link. After", "Two é a < b", "x", "y"]
    assert not [t for z, t in zones if z == op.OPEN]
    assert {"menu", "two", "We use cookies", "sign up", "share", "buy", "side", "first!", "s", "© us", "Site"} == {t for z, t in zones if z == op.CHROME}


def test_broken_markup():
    for page in ["", "<", "<p", "<a href='x", "</p></div>", "<script>x", "<!--", "<b><i>t", "x" * 10, "<p>" * 5000 + "deep", "<a b='" * 2000]:
        op.page_blocks(page)
    assert op.page_blocks("<p>a<p>b</div></p>c") == [(op.OPEN, "a"), (op.OPEN, "b"), (op.OPEN, "c")]
    assert op.page_blocks("<div class='wrap has-sidebar no_ads'><main id=m>a</main></div>") == [(op.ARTICLE, "a")]
    assert op.page_blocks("<article>a <span class=ad>buy <b>now</b></span> b</article>") == [(2, "buy now"), (0, "a b")]


def test_articles_of_the_table(spark, sf_dir):
    pages = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    got = {r.page_id: r for r in op.digest_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    assert len(got) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[p["page_id"]].text == "\n".join(b for b in blocks if b) and got[p["page_id"]].url == p["url"]
        assert got[p["page_id"]].n_chars == len(got[p["page_id"]].text)


def plain(pages):
    """Pages (host, [(zone, block)]) without windows of RUN tokens that stand on enough of a host's pages."""
    streams = [[w for _, t in blocks for w in t.split()] for _, blocks in pages]
    own = [op.signature([z for z, _ in blocks], [t for _, t in blocks]) for _, blocks in pages]
    votes = Counter((host, sig) for (host, _), sig in zip(pages, own))
    total = Counter(host for host, _ in votes)
    holders = defaultdict(float)
    for (host, _), tokens, sig in zip(pages, streams, own):
        for window in {tuple(tokens[j : j + op.RUN]) for j in range(len(tokens) - op.RUN + 1)}:
            holders[host, window] += 1 / votes[host, sig]
    out = []
    for (host, blocks), tokens in zip(pages, streams):
        gone = set()
        for j in range(len(tokens) - op.RUN + 1):
            if holders[host, tuple(tokens[j : j + op.RUN])] >= max(op.LEAST_PAGES, op.SHARE * total[host]) - 1e-6:
                gone |= set(range(j, j + op.RUN))
        at, kept = 0, []
        for z, t in blocks:
            words = t.split()
            kept.append((z, [w for k, w in enumerate(words, at) if k not in gone]))
            at += len(words)
        n = {zone: sum(len(w) for z, w in kept if z == zone) for zone in (op.ARTICLE, op.OPEN)}
        zones = {op.ARTICLE} if n[op.ARTICLE] and 2 * n[op.ARTICLE] >= n[op.OPEN] else {op.ARTICLE, op.OPEN}
        out.append("\n".join(" ".join(w) for z, w in kept if z in zones and w))
    return out


def test_host_boilerplate_against_brute_force(spark):
    pick = random.Random(4)
    word = lambda: pick.choice("abcdefgh") + pick.choice("xyz") + pick.choice("uvw")
    say = lambda n: " ".join(word() for _ in range(n))
    common = [say(n) for n in (6, 10, 14, 40)]
    pages = []
    for _ in range(90):
        blocks = [(pick.choice([op.OPEN, op.OPEN, op.ARTICLE, op.CHROME]), pick.choice(
            [pick.choice(common), say(pick.choice([3, 30])), say(5) + " " + " ".join(common[3].split()[5:30]) + " " + say(4)])) for _ in range(5)]
        pages.append((pick.choice(["a.com", "a.com", "b.org", "c.net"]), blocks))
    pages += pages[:3] * 4  # copies are one page as evidence
    mark = {op.OPEN: "div", op.ARTICLE: "article", op.CHROME: "nav"}
    rows = [(i, f"https://user@{h.upper()}:80/p/{i}", "".join(f"<{mark[z]}>{b}</{mark[z]}>" for z, b in blocks)) for i, (h, blocks) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in op.digest_rows(df).collect()}
    want = dict(enumerate(plain(pages)))
    assert got == want and any(len(want[i].split()) < sum(len(b.split()) for z, b in blocks if z != op.CHROME) for i, (_, blocks) in enumerate(pages))


def test_articles_lose_repeats_of_the_host_and_keep_what_copies_share(spark):
    pick = random.Random(8)
    say = lambda n: " ".join(f"w{pick.randrange(10**6)}" for _ in range(n))
    notice, syndicated = "please support our newsroom with a small gift today and read on for free", say(60)
    own = [say(50) for _ in range(12)]
    bodies = own[:10] + [syndicated + " " + say(2), syndicated + " " + say(2)]
    rows = [(i, "http://h.org/x", f"<main><p>{notice}</p><p>{b}</p></main>") for i, b in enumerate(bodies)]
    rows += [(20 + i, "http://two.org/x", f"<main><p>{notice}</p><p>{own[10]}</p></main>") for i in range(2)]  # too few pages to tell
    rows.append((30, "http://h.org/y", f"<div class=teaser><article>short teaser</article></div><div><p>{own[11]}</p></div>"))
    got = {r.page_id: r.text for r in op.digest_rows(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(12)} == dict(enumerate(bodies))
    assert got[20] == got[21] == notice + "\n" + own[10]
    assert got[30] == "short teaser\n" + own[11]


def test_inline_zones_and_hidden_text():
    blocks = op.page_blocks("<article><p>One <span class=ad>Buy <span>now</span> cheap</span> and two</p><p hidden>no</p><p style='display: none'>nor</p>"
                            "<p aria-hidden=false>yes</p></article><p>end <b class=ad>x")
    assert blocks == [(op.CHROME, "Buy now cheap"), (op.ARTICLE, "One and two"), (op.ARTICLE, "yes"), (op.CHROME, "x"), (op.OPEN, "end")]


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, "http://h/x", PAGE, "c"), (1, "http://h/x", PAGE, "c"), (2, None, None, "c"), (None, "x", "", None), (3, "http://h/y", "<p>" + "word " * 200000, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, zones string")
    got = op.digest_rows(df).collect()
    size = len("Title <1>\nOne boldword and link. After\nTwo é a < b\nx\ny")
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, size), (1, size), (2, 0), (3, 999999)]
    assert op.digest_rows(df.limit(0)).count() == 0
