"""URL filter: rules by host and path, and trust carried along links between hosts.

Hosts of pages that a rule allows are trusted seeds, hosts of pages that a rule
blocks are blocked seeds. Links between hosts are counted in pages. Trust is a
personalised PageRank from the trusted seeds along the links; distrust is one from
the blocked seeds against them (who links to a blocked host is suspect). A host is
blocked if its distrust exceeds its trust times ``ratio``. Rules decide first. Rounds
go on until no verdict can turn; the SQL adds up ``ROUNDS`` of them, after which less
than 1e-14 of the rank is on its way.

All of it is DataFrame expressions. Each round of the ranks is written to the
shared folder. What is joined back to the pages is a row per blocked host; it is
broadcast only below ``BROADCAST_ROWS``, else the join shuffles and adaptive
execution splits a hot host.

Edge cases: a null url or one without ``://`` has empty host and path, no rule, and
is allowed; repeated pages are judged alike; a null html has no links; a host that
neither rank reaches is allowed; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (host, path, verdict): fits the host and its subdomains where the path begins so; the longest wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, RATIO = 0.85, 1.0
#: Rounds of the SQL.
ROUNDS = 200
#: Rank still on its way that no longer counts, near the precision of its sums.
TOLERANCE = 1e-12
BROADCAST_ROWS = 100_000
LINK = r"""href[ \t\r\n\f]*=[ \t\r\n\f]*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'> \t\r\n\f]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null. ``rules`` is a short list and becomes one expression."""
    out = None
    for name, start, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        made = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def host_ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, w) and seeds (host, allowed, blocked).

    Round k adds what arrives over k links, so ranks grow towards PageRank and lack at
    most the last addition times damping / (1 - damping). Rounds end when no host is
    reached anew and that rest can turn no comparison of distrust with ``ratio`` times
    trust, or is below ``TOLERANCE``.
    """
    sums = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    a, b = float(sums.a or 0) or 1.0, float(sums.b or 0) or 1.0
    starts = seeds.select("host", (F.col("allowed") / a).alias("trust"), (F.col("blocked") / b).alias("distrust"))
    outs = edges.groupBy("src").agg(F.sum("w").alias("out_w"))
    ins = edges.groupBy("dst").agg(F.sum("w").alias("in_w"))
    flow = edges.join(outs, "src").join(ins, "dst").select("src", "dst", (F.col("w") / F.col("out_w")).alias("down"), (F.col("w") / F.col("in_w")).alias("up"))
    flow = common.materialize(flow)
    starts = common.materialize(starts)
    if not flow.limit(1).count():
        return starts  # without links the ranks are the seeds
    none = F.lit(0.0)
    now = starts.select("host", *(((1 - damping) * F.col(c)).alias(c) for c in ("trust", "distrust")))
    now = now.withColumn("t", F.col("trust")).withColumn("b", F.col("distrust"))
    while True:
        trust = flow.join(now.select(F.col("host").alias("src"), "t").where("t > 0"), "src").select(F.col("dst").alias("host"), none.alias("trust"), none.alias("distrust"), (damping * F.col("t") * F.col("down")).alias("t"), none.alias("b"))
        distrust = flow.join(now.select(F.col("host").alias("dst"), "b").where("b > 0"), "dst").select(F.col("src").alias("host"), none.alias("trust"), none.alias("distrust"), none.alias("t"), (damping * F.col("b") * F.col("up")).alias("b"))
        held = now.select("host", "trust", "distrust", none.alias("t"), none.alias("b"))
        new = held.unionByName(trust).unionByName(distrust).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("trust", "distrust", "t", "b")))
        fresh = F.expr("(trust = 0 and t > 0) or (distrust = 0 and b > 0)").alias("fresh")
        now = common.materialize(new.select("host", (F.col("trust") + F.col("t")).alias("trust"), (F.col("distrust") + F.col("b")).alias("distrust"), "t", "b", fresh))
        last = now.agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.count_if("fresh").alias("fresh")).first()
        if last.fresh:
            continue
        t, b = (x * damping / (1 - damping) for x in (last.t, last.b))
        blocked, trusted = F.col("distrust"), ratio * F.col("trust")
        turns = ((blocked > trusted) & (F.col("trust") > 0) & (blocked <= trusted + ratio * t)) | ((blocked <= trusted) & (blocked > 0) & (blocked + b > trusted))
        if max(t, b) < TOLERANCE or not now.where(turns).limit(1).count():
            return now.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """(page_id, host, path, rule, verdict, by) for every row of ``pages`` (page_id, url, html)."""
    host, path = split_url(F.col("url"))
    found = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    found = found.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    seeds = found.where("fit is not null").groupBy("host").agg(F.count_if(F.col("fit.verdict") == "allow").alias("allowed"), F.count_if(F.col("fit.verdict") == "block").alias("blocked"))
    links = found.where("host != '' and html is not null").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    edges = links.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    edges, seeds = common.materialize(edges), common.materialize(seeds)
    ranks = host_ranks(edges, seeds, damping, ratio)
    bad = common.materialize(ranks.where(F.col("distrust") > ratio * F.col("trust")).select("host", F.lit(True).alias("bad")))
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    out = found.drop("html").join(bad, "host", "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("fit").isNotNull(), "rule").otherwise("links").alias("by"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


def _oracle() -> str:
    """The same with ``ROUNDS`` rounds."""
    cases = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in cases]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, cases, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, cases, strict=True)) + " END"
    link = LINK.replace("'", "''")
    parts = [
        "u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, html, translate(regexp_extract(rest, '\\A([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '\\A[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"f AS (SELECT *, {rule} AS rule, {verdict} AS fit FROM h)",
        "seeds AS (SELECT host, count(*) FILTER (fit = 'allow') AS al, count(*) FILTER (fit = 'block') AS bl FROM f WHERE rule IS NOT NULL GROUP BY host)",
        "r0 AS (SELECT host, al / greatest(1, sum(al) OVER ()) AS t0, bl / greatest(1, sum(bl) OVER ()) AS b0 FROM seeds)",
        f"l AS (SELECT page_id, host AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS dst FROM f WHERE host <> '')",
        f"e AS (SELECT src, translate(dst, '{_UPPER}', '{_LOWER}') AS d, count(*) AS w FROM l WHERE src <> translate(dst, '{_UPPER}', '{_LOWER}') GROUP BY 1, 2)",
        "w AS (SELECT src, d, w / sum(w) OVER (PARTITION BY src) AS down, w / sum(w) OVER (PARTITION BY d) AS up FROM e)",
        # What arrives over k links, for each k; PageRank is the sum.
        "s AS (SELECT 0 AS k, host, t0 AS t, b0 AS b FROM r0 UNION ALL SELECT k + 1, host, sum(t), sum(b) FROM"
        f" (SELECT s.k, CASE WHEN x.up THEN w.src ELSE w.d END AS host, CASE WHEN x.up THEN 0 ELSE {DAMPING} * s.t * w.down END AS t, CASE WHEN x.up THEN {DAMPING} * s.b * w.up ELSE 0 END AS b"
        f" FROM s CROSS JOIN (VALUES (true), (false)) x(up) JOIN w ON s.host = CASE WHEN x.up THEN w.d ELSE w.src END WHERE s.k < {ROUNDS}) GROUP BY k, host HAVING sum(t) + sum(b) > 0)",
        "n AS (SELECT host, sum(t) AS t, sum(b) AS b FROM s GROUP BY host)",
    ]
    return (
        "WITH RECURSIVE " + ", ".join(parts) + f" SELECT page_id, f.host, path, rule, CASE WHEN rule IS NOT NULL THEN fit WHEN n.b > {RATIO} * n.t THEN 'block' ELSE 'allow' END AS verdict,"
        f" CASE WHEN rule IS NOT NULL THEN 'rule' ELSE 'links' END AS by FROM f LEFT JOIN n ON n.host = f.host"
    )


ORACLE = _oracle()
