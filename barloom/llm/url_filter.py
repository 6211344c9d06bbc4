"""URL filter by rules and by trust and distrust spread over the host graph (DataFrame functions only)."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, renamed

#: Fixed values: (verdict, host, path) rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"


@dataclass(frozen=True)
class Spread:
    """damping: share that follows links. ratio: a host is blocked if its share of distrust exceeds ratio
    times its share of trust. tolerance: largest L1 change of a kind's ranks over three steps at which the
    walk ends. iterations: steps written out in the SQL. most_broadcast: up to so many blocked hosts are broadcast.
    salts: rows of one host are dealt over so many tasks when there are more."""

    damping: float = 0.85
    iterations: int = 10
    ratio: float = 1.0
    tolerance: float = 1e-6
    most_broadcast: int = 200_000
    salts: int = 32


def split_url(url):
    """(host, path): both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Add rule and rule_verdict: the longest rule that fits host (or a parent domain) and path prefix."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts in href attributes of pages (host, html).

    Relative links stay on their host and so make no edge. Counts combine before the shuffle,
    so one busy host costs one row per task and target.
    """
    links = F.filter(F.regexp_extract_all("html", F.lit(HREF), 1), lambda h: h.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    hosts = F.transform(links, lambda h: F.regexp_extract(h, r"^(?:[^/]*:)?//([^/?#]*)", 1))
    return (
        pages.where("host <> ''")
        .select(F.col("host").alias("src"), F.explode(hosts).alias("dst"))
        .select("src", ascii_lower(F.col("dst")).alias("dst"))
        .where("dst <> '' and dst <> src")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("w"))
    )


def spread(edges: DataFrame, seeds: DataFrame, p: Spread) -> DataFrame:
    """Personalised PageRank per kind: edges (kind, src, dst, w), seeds (kind, host, m summing to 1 per kind).

    r = (1-d) seed + d (sum over in-edges of r w/W + rank of hosts without out-edges, put back on the seeds).
    Steps go on until the ranks have settled within the tolerance. As the mass that still moves shrinks by the
    damping with every step, that takes a number of steps that no graph exceeds (some 90 with the defaults); hosts further away
    than that share less than the tolerance between them and count as not reached.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    walk = checkpointed(
        edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("total")).alias("p"))
    )
    seeds = checkpointed(seeds)
    if walk.isEmpty():
        return seeds.select("kind", "host", F.col("m").alias("r"))
    rank = seeds.select("kind", "host", F.col("m").alias("r"))
    sources = walk.select("kind", F.col("src").alias("host")).distinct()
    rank = before = checkpointed(rank)
    for i in itertools.count():
        moved = rank.join(walk.withColumnRenamed("src", "host"), ["kind", "host"]).select(
            "kind", F.col("dst").alias("host"), (F.col("r") * F.col("p") * p.damping).alias("r")
        )
        stuck = rank.join(sources, ["kind", "host"], "left_anti").groupBy("kind").agg(F.sum("r").alias("lost"))
        back = seeds.join(F.broadcast(stuck), "kind", "left").select(  # at most one row per kind: two rows
            "kind", "host", (F.col("m") * (1 - p.damping + p.damping * F.coalesce("lost", F.lit(0.0)))).alias("r")
        )
        rank = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if i % 3 == 2:
            rank = checkpointed(rank)
            both = rank.join(before.withColumnRenamed("r", "was"), ["kind", "host"], "left")
            moves = both.groupBy("kind").agg(F.sum(F.abs(F.col("r") - F.coalesce("was", F.lit(0.0)))).alias("moved"))
            if moves.where(F.col("moved") > p.tolerance).isEmpty():
                return rank
            before = rank


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, p: Spread = Spread()
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_verdict.

    The verdict is the longest fitting rule's; without one, the host's: pages that rules allow seed
    trust, pages they block seed distrust (on reversed links), each page with equal mass, and a host
    is blocked if its distrust exceeds ``ratio`` times its trust. Hosts that neither reaches are
    allowed, as are pages with an empty host. Null or empty html has no links; repeated rows are
    judged alike and each kept; a very long url or html is read whole; columns other than the three named are ignored.
    """
    rows = renamed(pages, page_id=id_col, url=url_col, html=html_col)
    host, path = split_url(F.col("url"))
    rows = with_rule(rows.withColumn("host", host).withColumn("path", path), rules)
    ahead = host_edges(rows.select("host", "html"))
    edges = ahead.select(F.lit("allow").alias("kind"), "src", "dst", "w").unionByName(
        ahead.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    )
    judged = rows.where("rule_verdict is not null and host <> ''").groupBy(F.col("rule_verdict").alias("kind"), "host").count()
    total = judged.groupBy("kind").agg(F.sum("count").alias("total"))
    seeds = judged.join(F.broadcast(total), "kind").select(  # two rows at most
        "kind", "host", (F.col("count") / F.col("total")).alias("m")
    )
    rank = spread(edges, seeds, p)
    mass = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0))
    blocked = (
        rank.groupBy("host").agg(mass("allow").alias("trust"), mass("block").alias("distrust"))
        .where(F.col("distrust") > F.col("trust") * p.ratio)
        .select("host", F.lit("block").alias("spread"))
    )
    blocked = checkpointed(blocked)
    if blocked.count() <= p.most_broadcast:  # a name and a word each
        judged = rows.join(F.broadcast(blocked), "host", "left")
    else:
        salted = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
        judged = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(p.salts)).cast("int")).join(salted, ["host", "salt"], "left")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "spread", F.lit("allow")).alias("verdict"),
        F.coalesce("spread", F.lit("allow")).alias("host_verdict"),
    )


def oracle(rules=RULES, p: Spread = Spread()) -> str:
    """DuckDB SQL for filter_urls over the pages table, with the power steps written out."""
    fits = lambda h, q: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{q}'))"
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"when {fits(h, q)} then '{h + q}'" for _, h, q in order)
    kind = " ".join(f"when {fits(h, q)} then '{k}'" for k, h, q in order)
    steps = "".join(
        f""", r{i + 1} as materialized (
  select kind, host, sum(r) as r from (
    select r.kind, w.dst as host, r.r * w.p * {p.damping}::double as r from r{i} r join walk w on w.kind = r.kind and w.src = r.host
    union all
    select s.kind, s.host, s.m * (1 - {p.damping}::double + {p.damping}::double * coalesce(l.lost, 0)) from seeds s left join
      (select kind, sum(r) as lost from r{i} r where not exists (select 1 from walk w where w.kind = r.kind and w.src = r.host) group by kind) l using (kind)
  ) group by kind, host)"""
        for i in range(p.iterations)
    )
    return f"""
with u as (
  select page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
judged as (select *, case {rule} end as rule, case {kind} end as rule_verdict from u),
links as (select host as src, unnest(regexp_extract_all(html, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) as h from judged where host <> ''),
ahead as (
  select src, dst, count(*)::double as w from
    (select src, translate(regexp_extract(h, '^(?:[^/]*:)?//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst
     from links where regexp_matches(h, '^([A-Za-z][A-Za-z0-9+.-]*:)?//'))
  where dst <> '' and dst <> src group by src, dst),
edges as (select 'allow' as kind, src, dst, w from ahead union all select 'block', dst, src, w from ahead),
walk as materialized (select kind, src, dst, w / sum(w) over (partition by kind, src) as p from edges),
seeds as materialized (
  select kind, host, n / sum(n) over (partition by kind) as m from
    (select rule_verdict as kind, host, count(*)::double as n from judged where rule_verdict is not null and host <> '' group by all)),
r0 as (select kind, host, m as r from seeds){steps},
spread as (select host, coalesce(sum(r) filter (kind = 'allow'), 0) as trust, coalesce(sum(r) filter (kind = 'block'), 0) as distrust from r{p.iterations} group by host)
select page_id, host, path, rule, coalesce(rule_verdict, case when distrust > trust * {p.ratio}::double then 'block' end, 'allow') as verdict,
       case when distrust > trust * {p.ratio}::double then 'block' else 'allow' end as host_verdict
from judged left join spread using (host)"""
