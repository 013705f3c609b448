"""URL filters: rules first, then trust and distrust spread over the links between hosts. DataFrame functions only.

Rules are (host, path) pairs; one fits its host and all subdomains where the url's path starts with the rule's, and the longest that
fits wins. For urls that no rule fits, hosts are judged: personalised PageRank spreads trust along links from hosts with allowed
urls, reversed PageRank spreads distrust against the links from hosts with blocked urls, and a host is blocked whose share of
distrust in both reaches the threshold. Hosts that neither reaches are allowed.

The graph has a node for each host and an edge for each linked pair, summed before they meet; every few rounds are written to the
shared folder. They go on until no host's trust or distrust grew by more than a small part of itself: a host reached for the first time grows by all of it, so every host within reach of a seed gets its share, however long the chain. Links too deep for that raise an error. Where a hot host's pages meet its verdict both sides come from files, so that adaptive execution can split them.

Defined results: a null url or one without `://` has empty host and path, fits no rule, and is allowed unless distrust reaches the
empty host; null html has no links; links within a host and relative ones don't count; urls repeated give rows repeated; an empty
table gives an empty one; only the columns named are read, so that others can't clash.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import drop, stage

#: (verdict, host, path)
Rule = tuple[str, str, str]
DAMPING, THRESHOLD = 0.85, 0.5
#: Rounds of the SQL, which can't test for convergence; judge() doesn't stop there.
ROUNDS = 8
#: Rounds from one test to the next, the largest part of itself by which any host may have grown in these at the end, rounds after which an
#: unsettled graph is an error, and the least weight that still leaves room for some products in a double.
AT_ONCE, TOLERANCE, MOST_ROUNDS, LEAST = 8, 1e-8, 4000, 1e-200
_ABSOLUTE = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'>\s]+)"""


def _lower(x: Column) -> Column:
    return F.translate(x, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _longest(rules: list[Rule], host: Column, path: Column, value) -> Column:
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in rules]
    order = sorted(range(len(rules)), key=lambda i: len(rules[i][1] + rules[i][2]), reverse=True)
    return F.coalesce(*[F.when(fits[i], F.lit(value(rules[i]))) for i in order], F.lit(None).cast("string"))


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): links from host to host."""
    links = pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_ABSOLUTE), F.lit(1))).alias("dst"))
    return links.select("src", _lower(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(host, trust, distrust), converged, from nodes (host, allowed, blocked: seeds' weights) and edges (src, dst, n)."""
    sums = nodes.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    share = lambda c: F.col(c) / F.lit(float(sums[c])) if sums[c] else F.lit(0.0)
    seeds = stage(nodes.select("host", share("allowed").alias("t0"), share("blocked").alias("b0")), "seeds")
    out = edges.groupBy("src").agg(F.sum("n").alias("n_out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("n_in"))
    weighed = edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("n_out")).alias("forth"), (F.col("n") / F.col("n_in")).alias("back"))
    # Trust goes from src to dst, distrust from dst to src: one row each, so that a round is one join.
    ways = F.array(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("forth").alias("t"), F.lit(0.0).alias("b")), F.struct(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), F.col("back").alias("b")))
    ways = stage(weighed.select(F.inline(ways)), "edges")
    # From the seeds' own part on, sums only grow, round by round, towards their limits.
    state = seeds.select("host", (F.lit(1 - damping) * F.col("t0")).alias("trust"), (F.lit(1 - damping) * F.col("b0")).alias("distrust"))
    if ways.isEmpty():
        return state
    mixed = lambda seed, x: F.lit(1 - damping) * F.col(seed) + F.lit(damping) * F.coalesce(F.col(x), F.lit(0.0))
    grown = lambda c: F.max(F.when(F.col(c) > 0, F.abs(F.col(c) - F.col(f"old_{c}")) / F.col(c)))
    least = lambda c: F.min(F.when(F.col(c) > 0, F.col(c)))
    old = state = stage(state, "state")
    for done in range(AT_ONCE, most_rounds + 1, AT_ONCE):
        for _ in range(AT_ONCE):
            sent = ways.join(state.withColumnRenamed("host", "from"), "from").select(F.col("to").alias("host"), (F.col("trust") * F.col("t")).alias("t"), (F.col("distrust") * F.col("b")).alias("b"))
            came = sent.groupBy("host").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
            state = seeds.join(came, "host", "left").select("host", mixed("t0", "t").alias("trust"), mixed("b0", "b").alias("distrust"))
        state = stage(state, "state", free=True)
        both = state.join(old.select("host", F.col("trust").alias("old_trust"), F.col("distrust").alias("old_distrust")), "host")
        found = both.agg(F.greatest(grown("trust"), grown("distrust")).alias("grown"), F.least(least("trust"), least("distrust")).alias("least")).first()
        drop(old)
        old = state
        if found["least"] is not None and found["least"] < LEAST:
            raise ValueError(f"hosts are linked so deep that their weights leave the range of doubles, in round {done}")
        if (found["grown"] or 0.0) <= tolerance:
            return state
    raise ValueError(f"trust and distrust haven't settled in {most_rounds} rounds")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING) -> DataFrame:
    """One row per page: id, host, path, rule (host and path), verdict (allow or block)."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(
        F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), _longest(rules, host, path, lambda r: r[1] + r[2]).alias("rule"), _longest(rules, host, path, lambda r: r[0]).alias("ruled"),
    )
    edges = stage(host_edges(pages.select(host.alias("host"), F.col(html_col).alias("html"))), "links")
    own = judged.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    linked = reduce(DataFrame.unionByName, [edges.select(F.col(c).alias("host"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("blocked")) for c in ("src", "dst")])
    nodes = stage(own.unionByName(linked).groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")), "nodes")
    state = propagate(nodes, edges, damping)
    both = F.col("trust") + F.col("distrust")
    verdicts = stage(state.select("host", F.when((both > 0) & (F.col("distrust") >= F.lit(threshold) * both), "block").otherwise("allow").alias("by_host")), "verdicts")
    return judged.join(verdicts, "host", "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))
