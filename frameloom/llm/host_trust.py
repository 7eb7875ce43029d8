"""URL filters with trust and distrust that spread over links between hosts.

A rule allows or blocks a host with all its subdomains below a path; of the rules that
fit a url the longest decides. Where none fits, the host does. Hosts with allowed pages
are seeds of trust, hosts with blocked pages seeds of distrust, each by its share of the
ruled pages. Trust follows links by personalised PageRank: a host passes it on over its
links, by their number. Distrust goes the other way: who links to a distrusted host gets
part of its distrust. A host is blocked if its distrust exceeds its trust by more than
`MARGIN`, else allowed; hosts that neither reaches are allowed.

Links are the absolute addresses in `href` and `src`; others stay on their host and
change nothing. A null url, and one without `://`, has an empty host and path. Null
html has no links. Repeated pages count as often as they are there. An empty table
gives an empty result. Columns that have the name of an output are replaced.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.session import Scratch, settle

log = logging.getLogger(__name__)

DAMPING = 0.85
#: The log tells how far trust has spread after each so many rounds; nothing ends there.
ROUNDS = 20
#: Rounds end when no host's trust or distrust changes by a larger part of itself, and what
#: may still come cannot turn a verdict; or when it is a part that doubles hardly hold.
CHANGE, EXACT = 1e-6, 1e-12
MARGIN = 0.0

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]*)"
KINDS = ("trust", "distrust")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """`pages` with `host`, `path`, and the `rule` and its `ruled` verdict, or null."""
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for one in sorted(rules, key=lambda r: (len(r.text), r.verdict, r.text)):  # the longest is asked first
        within = (F.col("host") == one.host) | F.col("host").endswith(f".{one.host}")
        fits = within & F.col("path").startswith(one.path)
        rule, verdict = F.when(fits, F.lit(one.text)).otherwise(rule), F.when(fits, F.lit(one.verdict)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


def host_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """`source`, `target` and the number of links between different hosts."""
    links = pages.select(host_of(F.col(url)).alias("source"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("target"))
    links = links.withColumn("target", F.translate("target", CAPITALS, SMALL))
    return links.filter("source != target and source != '' and target != ''").groupBy("source", "target").count()


def seeds(ruled: DataFrame) -> DataFrame:
    """Each host with its seeds of trust and distrust, the shares of its ruled pages."""
    share = F.count("ruled")
    return ruled.groupBy("host").agg(
        F.coalesce(F.count_if(F.col("ruled") == "allow") / F.nullif(share, F.lit(0)), F.lit(0.0)).alias("trust_seed"),
        F.coalesce(F.count_if(F.col("ruled") == "block") / F.nullif(share, F.lit(0)), F.lit(0.0)).alias("distrust_seed"),
    )


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """`host`, `trust` and `distrust` of every host that is a seed or in a link.

    Round n adds what arrives over paths of n links, so scores only grow. A host that is
    reached for the first time has changed by all it has, so rounds go on while any is.
    """
    links = settle(links, "links")
    out = links.groupBy("source").agg(F.sum("count").alias("out"))
    into = links.groupBy("target").agg(F.sum("count").alias("into"))
    weighted = settle(
        links.join(out, "source").join(into, "target").select(
            "source", "target", (F.col("count") / F.col("out")).alias("forward"), (F.col("count") / F.col("into")).alias("backward")
        ),
        "weighted",
    )
    named = links.select(F.explode(F.array("source", "target")).alias("host")).distinct()
    hosts = settle(seeds.join(named, "host", "full").na.fill(0.0, ["trust_seed", "distrust_seed"]), "hosts")
    ranks = hosts.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    if links.isEmpty():
        return ranks
    totals = hosts.agg(F.sum("trust_seed"), F.sum("distrust_seed")).first()
    first = [((1 - DAMPING) * F.col(f"{kind}_seed")).alias(name.format(kind)) for name in ("{}", "{}_change") for kind in KINDS]
    ranks = hosts.select("host", *first)
    written = None
    for number in count(1):
        moving = ranks.filter("trust_change > 0 or distrust_change > 0").select("host", "trust_change", "distrust_change")
        forward = weighted.join(moving, F.col("source") == F.col("host")).select(
            F.col("target").alias("to"), (F.col("trust_change") * F.col("forward")).alias("trust_in"), F.lit(0.0).alias("distrust_in")
        )
        backward = weighted.join(moving, F.col("target") == F.col("host")).select(
            F.col("source").alias("to"), F.lit(0.0).alias("trust_in"), (F.col("distrust_change") * F.col("backward")).alias("distrust_in")
        )
        got = forward.unionByName(backward).groupBy("to").agg(F.sum("trust_in").alias("trust_in"), F.sum("distrust_in").alias("distrust_in"))
        more = {kind: DAMPING * F.coalesce(f"{kind}_in", F.lit(0.0)) for kind in KINDS}
        new = ranks.join(got, F.col("host") == F.col("to"), "left").select(
            "host",
            *[(F.col(kind) + more[kind]).alias(kind) for kind in KINDS],
            *[more[kind].alias(f"{kind}_change") for kind in KINDS],
        )
        work = Scratch(links.sparkSession, "ranks")
        ranks = work(new, "round")
        largest, unsure = ranks.agg(
            F.max(F.greatest(*[F.when(F.col(kind) > 0, F.col(f"{kind}_change") / F.col(kind)).otherwise(0.0) for kind in KINDS])),
            F.count_if(_open(DAMPING ** (number + 1) * max(totals))),
        ).first()
        if written:
            written.__exit__()
        written = work
        if largest <= EXACT or (largest <= CHANGE and not unsure):
            break
        if number % ROUNDS == 0:
            log.info("round %d of trust: the largest relative change is %g, %d hosts are not decided", number, largest, unsure)
    return ranks.select("host", *KINDS)


def _open(rest: float) -> Column:
    """Whether a host's verdict may turn if its trust and its distrust grow by at most `rest` yet.

    Once no host is reached for the first time, a host that only one kind reaches is decided.
    """
    both = (F.least("trust", "distrust") > 0) | F.lit(MARGIN != 0)
    return both & (F.abs(F.col("distrust") - F.col("trust") - MARGIN) <= rest)


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html") -> DataFrame:
    """`pages` with `host`, `path`, `rule`, `verdict`, and the host's `trust` and `distrust`."""
    marked = ruled(pages, rules, url)
    ranks = settle(propagate(seeds(marked), host_links(pages, html, url)), "trust")
    ranks = ranks.select(F.col("host").alias("_host"), F.col("trust").alias("_trust"), F.col("distrust").alias("_distrust"))
    own = F.when(F.col("_distrust") > F.col("_trust") + MARGIN, "block").otherwise("allow")
    joined = marked.join(ranks, F.col("host") == F.col("_host"), "left")
    return joined.withColumns(
        {"verdict": F.coalesce("ruled", own), "trust": F.col("_trust"), "distrust": F.col("_distrust")}
    ).drop("ruled", "_host", "_trust", "_distrust")
