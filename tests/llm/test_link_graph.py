"""Link-graph filter: rules, links, flow against a plain loop, odd rows, no Python in the plan."""

import contextlib
import io
import random
import re
from collections import Counter, defaultdict

from drawstat.llm import link_graph as lg

SCHEMA = "page_id bigint, url string, html string, host string, rule string, mass int"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def named(html):
    return {split("x://" + h)[0] for h in re.findall(lg.LINK, html or "")}


def brute(pages, rules, steps=lg.STEPS):
    """Rules one by one, mass as dictionaries."""
    rows, seeds, links = [], {True: Counter(), False: Counter()}, Counter()
    for page, url, html in pages:
        host, path = split(url)
        fits = [(len(h + p), len(h), not allow, h + p) for h, p, allow in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        rows.append((page, host, path, best))
        if best:
            seeds[not best[2]][host] += lg.UNIT
        links.update((host, other) for other in named(html) if host and host != other)
    score = {}
    for allow in (True, False):
        out = defaultdict(list)
        for (a, b), n in links.items():
            out[a if allow else b].append((b if allow else a, n))
        moving, total = dict(seeds[allow]), Counter(seeds[allow])
        for _ in range(steps):
            following = Counter()
            for host, mass in moving.items():
                for to, n in out[host]:
                    following[to] += mass * 85 // 100 * n // sum(k for _, k in out[host])
            moving = {h: m for h, m in following.items() if m}
            total.update(moving)
        score[allow] = total
    return sorted(
        ((page, host, path, best and best[3], "block" if (best[2] if best else score[False][host] > score[True][host]) else "allow",
          score[True][host], score[False][host]) for page, host, path, best in rows), key=str)


def judged(spark, pages, rules=lg.RULES):
    rows = spark.createDataFrame([(*p, "x", "y", 1) for p in pages], SCHEMA)
    return lg.judge(rows.repartition(5), rules)


def web(n=400):
    rng = random.Random(3)
    hosts = [f"{s}{h}.{d}" for h in "abcdefgh" for s in ("", "www.") for d in ("example.org", "example.com", "other.net", "info")]
    pages = []
    for i in range(n):
        host = "hot.example.com" if i % 3 == 0 else rng.choice(hosts)
        links = "".join(f'<a class="c" HREF={q}{s}//{rng.choice(hosts).upper()}/x{q}>t</a><a href="/local">u</a>'
                        for q, s in [rng.choice([('"', "http:"), ("'", "https:"), ("", ""), ('"', "")]) for _ in range(rng.randrange(4))])
        pages.append((i, f"HTTP://{host}/{rng.choice(['en/1', 'en/2', 'fr/3', 'de/4', 'es/5', ''])}{rng.choice(['', '?q=://a.org/', '#f'])}", links))
    return pages


def test_flow_equals_plain_loop(spark):
    pages = web() + web()[:20]  # rows that repeat
    assert sorted(map(tuple, judged(spark, pages).collect()), key=str) == brute(pages, lg.RULES)
    verdicts = {r.verdict for r in judged(spark, pages).filter("rule IS NULL AND trust + distrust > 0").collect()}
    assert verdicts == {"allow", "block"}  # the flow decides both ways


def test_distrust_walks_backwards_and_trust_forwards(spark):
    pages = [(1, "http://a.com/de/1", '<a href="http://c.net/">'), (2, "http://b.net/", '<a href="http://a.com/">'), (3, "http://c.net/", None),
             (4, "http://d.com/fr/1", '<a href="//c.net/x">'), (5, "http://e.net", "")]
    rows = {r.page_id: r for r in judged(spark, pages).collect()}
    assert rows[2].verdict == "block" and (rows[2].trust, rows[2].distrust) == (0, 850_000)
    assert rows[3].verdict == "allow" and (rows[3].trust, rows[3].distrust) == (850_000, 0)
    assert rows[5].verdict == "allow" and rows[5].rule is None and rows[5].path == ""
    assert (rows[1].rule, rows[1].verdict, rows[4].rule, rows[4].verdict) == ("com/de/", "block", "com/fr/", "allow")


def test_longest_rule_and_subdomains(spark):
    urls = ["http://example.org/es/1", "https://m.Example.ORG/en/12?x", "http://example.org/en/2", "http://notexample.org/es/1", "http://org/x", "http://com.net/fr/",
            "http://example.org", "http://example.org?/es/", "no scheme", None, "", "http:///es/", "a://b://c.org/", "http://ÉX.org/É#://z.com/de/", "http://org/\nx"]
    pages = [(i, u, None) for i, u in enumerate(urls)] + [(None, urls[0], None)]
    assert sorted(map(tuple, judged(spark, pages).collect()), key=str) == brute(pages, lg.RULES)


def test_odd_tables(spark):
    assert judged(spark, []).count() == 0
    assert [r.verdict for r in judged(spark, [(1, "http://a.com/de/", "x" * 2_000_000 + '<a href="http://b.com/">' * 3)], []).collect()] == ["allow"]
    ties = [("a.org", "/x", True), ("a.org", "/x", False), ("org", "/x", True)]
    assert [(r.rule, r.verdict) for r in judged(spark, [(1, "http://a.org/x", None)], ties).collect()] == [("a.org/x", "block")]
    long_host = "http://" + "a." * 20_000 + "org/"
    assert [r.rule for r in judged(spark, [(1, long_host, None)]).collect()] == ["org/"]


def test_no_python_in_the_plan(spark):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        judged(spark, web(20)).explain("formatted")
    assert not re.search("Python|Arrow|Pandas", text.getvalue())
    assert not re.search("CartesianProduct|NestedLoop", text.getvalue())
