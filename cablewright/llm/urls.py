"""URL verdicts from rules, and for the rest from link-graph propagation.

Hosts are the nodes. A link from a page to another host is an edge, counted once for each
occurrence; relative links stay within their host and make none. Trust is a personalised PageRank from
the hosts whose pages rules allow; distrust is one over the reversed edges from the hosts
whose pages rules block. A host is blocked where its distrust exceeds its trust by the
share `margin` of it: ranks shrink as seeds grow in number, so no fixed amount would do.

Only DataFrame functions are used, so all of it runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import lower_ascii, saved

#: Fixed values of the contract: (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first '://' up to '/', '?' or '#', A-Z lower-cased) and path (then up to '?' or '#'); both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits; of equally long ones the first in the text's order."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 12, alpha: float = 0.85) -> DataFrame:
    """Personalised PageRank: a row (kind, host, rank) for each kind of seeds and host reached.

    edges: kind, src, dst, w (summed by pair already); seeds: kind, host, w. A host without
    edges returns its rank to the seeds. Each third round is written to the shared folder.
    """
    share = edges.groupBy("kind", "src").agg(F.sum("w").alias("out"))
    edges = saved(edges.join(share, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("w") / F.col("out")).alias("p")), "links")
    total = seeds.groupBy("kind").agg(F.sum("w").alias("total"))
    start = saved(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("w") / F.col("total")).alias("s")), "seeds")  # two rows in total
    rank = start.select("kind", "host", F.col("s").alias("rank"))
    for k in range(rounds):
        moved = rank.join(edges, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("p")).alias("m"))
        # What is moved sums to 1 less the rank of hosts without edges; that part goes to the seeds.
        kept = moved.groupBy("kind").agg(F.sum("m").alias("kept"))
        back = start.join(F.broadcast(kept), "kind", "left").select("kind", "host", (F.col("s") * (1 - alpha * F.coalesce("kept", F.lit(0.0)))).alias("m"))
        rank = moved.select("kind", "host", (F.col("m") * alpha).alias("m")).unionByName(back).groupBy("kind", "host").agg(F.sum("m").alias("rank"))
        if k % 3 == 2 or k == rounds - 1:
            rank = saved(rank, "rank")
    return rank


def url_verdicts(pages: DataFrame, rules=RULES, margin: float = 1e-9, rounds: int = 12) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every page, with the host's trust and distrust.

    A null url, or one without '://', has an empty host, which takes no part in the graph and
    is allowed. Null html has no links. A host that neither kind of seed reaches is allowed.
    Repeated pages count each time, as do repeated links. An empty table gives an empty result;
    other columns are ignored.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    judged = pages.select("page_id", "host", "path", _rule(F.col("host"), F.col("path"), rules).alias("rule"))
    verdict = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])
    judged = judged.withColumn("by_rule", verdict[F.col("rule")])
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", lower_ascii(F.col("dst")).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    graph = saved(links, "graph")
    edges = graph.withColumn("kind", F.lit("trust")).unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.lit("distrust").alias("kind")))
    seeds = judged.filter("by_rule IS NOT NULL AND host <> ''").groupBy(F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").cast("double").alias("w"))
    rank = propagate(edges, seeds, rounds)
    by_host = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))
    out = judged.join(by_host, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust > trust * (1 + margin), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
