"""Rules, links and propagation against a plain restatement."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import host_trust as h
from frameloom.llm.queries import RULES

KINDS = "page_id bigint, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


URLS = [
    "https://a.example.org/es/1", "http://Example.ORG/en/12", "https://x.org/en/1", "x://notorg/", "ftp://org/", "https://org",
    "https://b.com/fr/x?y", "https://b.com/de/#z", "https://b.com/en/", "//b.com/fr/", "", None, "https://b.com?u=://org/", "a\n://c.com/de/q",
    "https://example.org/es", "https://w.net/fr/",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], KINDS).withColumn("host", F.lit("mine"))
    rows = h.judge(df, RULES).collect()
    assert len(rows) == len(URLS)
    for row in rows:
        host, path = split(row.url)
        rule = rule_of(host, path)
        assert (row.host, row.path) == (host, path)
        assert row.rule == (rule.text if rule else None)
        if rule:
            assert row.verdict == rule.verdict


def brute(pages):
    seen, links = defaultdict(Counter), Counter()
    for _, url, html in pages:
        host, path = split(url)
        rule = rule_of(host, path)
        seen[host][rule.verdict if rule else None] += 1
        for target in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]*)""", html or ""):
            if host and target and target.lower() != host:
                links[host, target.lower()] += 1
    hosts = set(seen) | {x for pair in links for x in pair}
    share = lambda x, v: seen[x][v] / max(1, seen[x]["allow"] + seen[x]["block"])
    seed = {x: (share(x, "allow"), share(x, "block")) for x in hosts}
    out, into = Counter(), Counter()
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    rank = dict(seed)
    for _ in range(h.ROUNDS if links else 0):
        trust, distrust = Counter(), Counter()
        for (a, b), n in links.items():
            trust[b] += rank[a][0] * n / out[a]
            distrust[a] += rank[b][1] * n / into[b]
        new = {x: tuple((1 - h.DAMPING) * seed[x][k] + h.DAMPING * (trust, distrust)[k][x] for k in (0, 1)) for x in hosts}
        change = max(abs(new[x][k] - rank[x][k]) for x in hosts for k in (0, 1))
        rank = new
        if change <= h.CHANGE:
            break
    return rank


def test_trust_and_distrust_spread_over_links(spark):
    link = lambda *hosts: "".join(f'<a href="https://{x}/p">t</a>' for x in hosts)
    pages = [
        (1, "https://good.org/en/", link("near.net", "near.net", "far.net")),
        (2, "https://near.net/", link("far.net", "NEAR.net") + '<img src=//pic.net/x.png><a href="/self">'),
        (3, "https://bad.com/de/1", None),
        (4, "https://linker.net/", link("bad.com", "bad.com")),
        (5, "https://linker.net/", link("bad.com")),
        (6, "https://alone.net/", "no links"),
        (7, None, link("good.org")),
        (8, "https://bad.com/en/", ""),
        (6, "https://alone.net/", "no links"),
    ]
    rows = h.judge(spark.createDataFrame(pages, KINDS), RULES).collect()
    rank = brute(pages)
    assert len(rows) == len(pages)
    for row in rows:
        trust, distrust = rank[row.host]
        assert (row.trust, row.distrust) == pytest.approx((trust, distrust))
        if row.rule is None:
            assert row.verdict == ("block" if distrust > trust + h.MARGIN else "allow")
    verdicts = {row.url: row.verdict for row in rows}
    assert verdicts["https://near.net/"] == "allow" and verdicts["https://linker.net/"] == "block"
    assert verdicts["https://bad.com/en/"] == "block" and verdicts["https://alone.net/"] == "allow"


def test_empty_table(spark):
    assert h.judge(spark.createDataFrame([], KINDS), RULES).count() == 0


def solved(seed, links):
    """Trust and distrust of every host, by solving the equations of both."""
    hosts = sorted(set(seed) | {x for pair in links for x in pair})
    at, found = {x: i for i, x in enumerate(hosts)}, []
    for kind in (0, 1):
        matrix, sums = np.eye(len(hosts)), Counter()
        for pair, n in links.items():
            sums[pair[kind]] += n
        for pair, n in links.items():
            matrix[at[pair[1 - kind]], at[pair[kind]]] -= h.DAMPING * n / sums[pair[kind]]
        found.append(np.linalg.solve(matrix, [(1 - h.DAMPING) * seed.get(x, (0, 0))[kind] for x in hosts]))
    return {x: (found[0][i], found[1][i]) for x, i in at.items()}


def test_chains_are_followed_to_their_end_behind_a_large_hub(spark):
    hub, length = 20_000, 24  # 0.85 / 20,000 is what a linker gets
    chain = [f"c{i}" for i in range(length)]
    links = {(f"l{i}", "bad"): 1 for i in range(hub)} | {("c0", "l0"): 1} | dict.fromkeys(zip(chain[1:], chain, strict=False), 1)
    links |= {("good", "x"): 2, ("x", "y"): 1, ("y", "x"): 3, ("y", "z"): 1, ("z", "bad2"): 1}  # a ring, in a part of its own
    seed = {"bad": (0.0, 1.0), "good": (1.0, 0.0), "bad2": (0.0, 0.7)}
    seeds = spark.createDataFrame([(x, *both) for x, both in seed.items()], "host string, trust_seed double, distrust_seed double")
    table = spark.createDataFrame([(*pair, n) for pair, n in links.items()], "source string, target string, count bigint")
    got = {row.host: (row.trust, row.distrust) for row in h.propagate(seeds, table).collect()}
    few = {pair: n for pair, n in links.items() if not re.match("l[1-9]", pair[0])}
    weights = solved({x: v for x, v in seed.items() if x != "bad"} | {"l0": (0.0, 0.85 * 1.0 / hub)}, {p: n for p, n in few.items() if p[1] != "bad"})
    assert len(got) == len({x for pair in links for x in pair})
    for host, both in weights.items():
        assert got[host] == pytest.approx(both, rel=1e-4, abs=1e-30)
    assert all(got[host][1] > got[host][0] for host in ["bad", "l0", "l19999", *chain])
