"""URL filters: rules on host and path, then trust and distrust that spread over the link graph of hosts.

Rules that fit a url decide it, the longest first. For the others, hosts whose pages the rules allow seed a personalised PageRank along links, and
hosts whose pages they block seed one along reversed links (whoever links to a blocked host is suspect). A host's seed is
the share of its pages so ruled. Ranks are scaled back by the sum of the seeds, so a host without links keeps its share,
and a host is blocked when its distrust exceeds both THRESHOLD and its trust.

Defined results: a null url or one without `://` has an empty host and path and no rule; an empty host is a host like any other, so its pages
are allowed unless it gathers distrust; null html has no links; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
THRESHOLD = 0.5
#: Ranks are done when no host's score can move by more, however many rounds would follow.
CLOSE = 1e-4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: str) -> str:
    return f"translate(if(instr({url}, '://') > 0, regexp_extract(substring({url}, instr({url}, '://') + 3), '^[^/?#]*', 0), ''), '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return f"if(instr({url}, '://') > 0, regexp_extract(substring({url}, instr({url}, '://') + 3), '^[^/?#]*([^?#]*)', 1), '')"


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule and ruling to rows with a url."""
    a = pages.withColumn("url", F.coalesce("url", F.lit(""))).selectExpr("* except (url)", f"{_host('url')} as host", f"{_path('url')} as path")
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, f"{host}{path}").otherwise(rule), F.when(fits, verdict).otherwise(ruling)
    return a.withColumns({"rule": rule, "ruling": ruling})


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from absolute references in the html."""
    found = pages.selectExpr(f"{_host('url')} as src", r"""explode(regexp_extract_all(html, r'(?i)\bhref\s*=\s*["\x27]?((?:https?:)?//[^"\x27\s>]+)', 1)) as ref""")
    ref = "if(ref like '//%', concat('http:', ref), ref)"
    return found.selectExpr("src", f"{_host(ref)} as dst").where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(hosts: DataFrame, edges: DataFrame, seed: str) -> DataFrame:
    """(host, score): personalised PageRank from the column `seed` of hosts along edges, scaled so that a host without links keeps its seed.

    Mass at hosts without outgoing links goes back to the seeds.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all_n"))
    weights = stored(edges.join(out, "src").selectExpr("src", "dst", "n / all_n as w"), "rank-weights")
    total = hosts.agg(F.sum(seed)).first()[0] or 0.0
    if not total or not weights.limit(1).count():
        return hosts.selectExpr("host", f"double({seed}) as score")
    base = stored(hosts.selectExpr("host as h", f"{seed} / {total!r}D as s"), "rank-seeds")
    ranks = base.selectExpr("h", "s", "s as rank")
    while True:
        flow = weights.join(ranks.selectExpr("h as src", "rank"), "src").groupBy("dst").agg(F.sum(F.expr("w * rank")).alias("got"))
        moved = stored(base.join(flow, F.expr("h = dst"), "left").selectExpr("h", "s", f"{DAMPING} * coalesce(got, 0D) as got"), "rank-flow")
        # What was not passed on, the jumps and the dangling mass, returns to the seeds.
        back = 1.0 - (moved.agg(F.sum("got")).first()[0] or 0.0)
        after = moved.selectExpr("h", "s", f"got + s * {back!r}D as rank")
        change = after.join(ranks.selectExpr("h as h0", "rank as r0"), F.expr("h = h0")).agg(F.sum(F.expr("abs(rank - r0)"))).first()[0]
        ranks = after
        # The changes of all hosts together shrink by DAMPING a round at least, so this bounds, in units of scores, what all rounds to come can do to one host.
        if change * total * DAMPING / (1 - DAMPING) < CLOSE:
            break
    return ranks.selectExpr("h as host", f"rank * {total!r}D as score")


def host_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(host, trust, distrust, blocked) for every host of pages and links."""
    edges = stored(links(pages), "host-links")
    seen = ruled(pages.select("url"), rules).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("ruling = 'allow'")).alias("good"), F.count_if(F.expr("ruling = 'block'")).alias("bad"))
    linked = edges.select(F.col("src").alias("host")).unionAll(edges.select(F.col("dst").alias("host"))).distinct()
    hosts = seen.join(linked, "host", "full").selectExpr("host", "coalesce(good / n, 0D) as good", "coalesce(bad / n, 0D) as bad")
    hosts = stored(hosts, "hosts")
    trust = spread(hosts, edges, "good").withColumnRenamed("score", "trust")
    distrust = spread(hosts, edges.selectExpr("dst as src", "src as dst", "n"), "bad").withColumnRenamed("score", "distrust")
    return trust.join(distrust, "host").withColumn("blocked", F.expr(f"distrust > {THRESHOLD} and distrust > trust"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page."""
    hosts = stored(host_verdicts(pages, rules), "host-verdicts").selectExpr("host as of_host", "blocked")
    a = ruled(pages.select("page_id", "url"), rules).join(hosts, F.expr("host = of_host"), "left")
    return a.selectExpr("page_id", "host", "path", "rule", "coalesce(ruling, if(coalesce(blocked, false), 'block', 'allow')) as verdict")
