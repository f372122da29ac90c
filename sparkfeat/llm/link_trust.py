"""URL filtering by propagation over the link graph of hosts.

Trust is a personalised PageRank that starts from trusted seeds and follows links; distrust starts
from blocked seeds and follows links backwards, to those who link to bad hosts (Gyongyi et al., 2004;
Krishnan and Raj, 2006).  Both run in the same joins.  Hosts, and the edges between them, are
counted from all pages in one scan; pages never enter the iteration.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_folder, stored, table

TRUSTED, BLOCKED = ("edu", "gov", "example.org"), ("example.net",)
DAMPING, CUT = 0.85, 1.0
#: Rounds of the SQL alone, enough for the fixture, whose ranks stay on the seeds.
ROUNDS = 20
#: What a rank may be away from where it converges: so much, and so much of an even share.
EXACT, SHARE = 1e-10, 1e-3
#: A tag ends at the next sign of one, so that broken pages are scanned once.
LINK = r"<[aA]\s[^<>]*?[hH][rR][eE][fF]\s*=\s*[\"']?([^\"'\s<>]+)"
HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute or protocol-relative URL without leading www.; empty for others."""
    return F.rtrim(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), F.lit("."))


def under(host: Column, suffixes: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for s in suffixes:
        test = test | (host == s) | host.endswith("." + s)
    return test


def host_edges(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hosts, edges): hosts of pages and links, and (src, dst, n) of the links between different hosts."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode_outer(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("link")).where("src <> ''")
    counted = stored(links.select("src", F.coalesce(host_of(F.col("link")), F.lit("")).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n")))
    hosts = counted.select(F.col("src").alias("host")).union(counted.where("dst <> ''").select("dst")).distinct()
    return hosts, counted.where("dst <> '' and dst <> src")


def propagate(pages: DataFrame, trusted: tuple[str, ...] = TRUSTED, blocked: tuple[str, ...] = BLOCKED, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust, n_hosts) of every host of the pages and their links.

    Ranks of hosts without links return to the seeds.  Each round's ranks go to the shared folder;
    the rounds end once all that is still to move, at most ``damping / (1 - damping)`` times what a
    round moved, is far below the cut, or after ``rounds`` if given.  Without seeds all ranks are 0.
    """
    shared_folder(pages.sparkSession)
    hosts, edges = host_edges(pages)
    sides = F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("side")
    seed = F.when(F.col("side") == "trust", under(F.col("host"), trusted) & ~under(F.col("host"), blocked)).otherwise(under(F.col("host"), blocked))
    base = hosts.select("host", sides).withColumn("seed", seed.cast("double"))
    n_seeds = base.groupBy("side").agg(F.sum("seed").alias("seeds"), F.count("*").alias("n_hosts"))
    both = edges.select(F.lit("trust").alias("side"), "src", "dst", "n").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    out = both.groupBy("side", "src").agg(F.sum("n").alias("total"))
    shares = stored(both.join(out, ["side", "src"]).select("side", "src", "dst", (F.col("n") / F.col("total")).alias("share")))
    ends = out.select("side", F.col("src").alias("host"), F.lit(True).alias("linked"))
    base = base.join(F.broadcast(n_seeds), "side").withColumn("seed", F.when(F.col("seeds") > 0, F.col("seed") / F.col("seeds")).otherwise(0.0))
    base = stored(base.join(ends, ["side", "host"], "left").select("side", "host", "seed", "n_hosts", F.coalesce("linked", F.lit(False)).alias("linked")))
    ranks = base.select("side", "host", "linked", F.col("seed").alias("rank"))
    n_hosts = base.agg(F.max("n_hosts")).first()[0] or 1
    still = min(EXACT, SHARE / n_hosts) * (1 - damping) / damping
    for k in itertools.count() if rounds is None else range(rounds):
        came = ranks.join(shares, (ranks.side == shares.side) & (ranks.host == shares.src)).groupBy(shares.side, F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        loose = ranks.groupBy("side").agg(F.sum(F.when(F.col("linked"), 0.0).otherwise(F.col("rank"))).alias("loose"))
        old = ranks.select("side", "host", F.col("rank").alias("old"))
        new = base.join(came, ["side", "host"], "left").join(F.broadcast(loose), "side").join(old, ["side", "host"])
        new = new.select("side", "host", "linked", ((1 - damping) * F.col("seed") + damping * (F.coalesce("came", F.lit(0.0)) + F.col("loose") * F.col("seed"))).alias("rank"), "old")
        new = stored(new)
        moved = max((r["moved"] for r in new.groupBy("side").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved")).collect()), default=0.0)
        if k:
            discard(ranks)
        ranks = new
        ranks._stored_at = new._stored_at
        if not moved or (rounds is None and moved < still):
            break
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("rank"))).alias(name)
    return ranks.join(base.select("side", "host", "n_hosts"), ["side", "host"]).groupBy("host").agg(side("trust"), side("distrust"), F.max("n_hosts").alias("n_hosts"))


def judged(pages: DataFrame, cut: float = CUT, **how) -> DataFrame:
    """(page_id, host, trust, distrust, blocked) of every row of ``pages``.

    A host is blocked where its distrust exceeds its trust and is at least ``cut`` times an even
    share of all distrust.  Pages whose URL is null or names no host have null host and ranks and
    are not blocked; null html has no links; repeated rows stay and their links count each; a null
    page_id stays null; other columns are not read.
    """
    ranks = propagate(pages, **how)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * F.col("n_hosts") >= cut)
    ranks = ranks.select("host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), bad.cast("int").alias("bad"))
    p = pages.select("page_id", F.nullif(host_of(F.col("url")), F.lit("")).alias("host"))
    return p.join(ranks, "host", "left").select("page_id", "host", "trust", "distrust", F.coalesce("bad", F.lit(0)).alias("blocked"))


def op3_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def _sql() -> str:
    host = lambda x: f"rtrim(regexp_extract(lower(trim({x})), '{HOST}', 1), '.')"
    under_sql = lambda names: "(" + " OR ".join(f"host = '{s}' OR host LIKE '%.{s}'" for s in names) + ")"
    link = LINK.replace("'", "''")
    q = f"""
WITH raw AS MATERIALIZED (SELECT {host('url')} AS src, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS link
  FROM (SELECT url, regexp_extract_all(coalesce(html, ''), '{link}', 1) AS l FROM pages) WHERE {host('url')} <> ''),
counted AS MATERIALIZED (SELECT src, coalesce({host('link')}, '') AS dst, count(*) AS n FROM raw GROUP BY ALL),
hosts AS MATERIALIZED (SELECT src AS host FROM counted UNION SELECT dst FROM counted WHERE dst <> ''),
edges AS (SELECT * FROM counted WHERE dst <> '' AND dst <> src),
both_ways AS MATERIALIZED (SELECT 'trust' AS side, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
shares AS MATERIALIZED (SELECT side, src, dst, n / sum(n) OVER (PARTITION BY side, src) AS share FROM both_ways),
marked AS (SELECT host, side, CASE WHEN side = 'trust' THEN {under_sql(TRUSTED)} AND NOT {under_sql(BLOCKED)} ELSE {under_sql(BLOCKED)} END::INT AS s
  FROM hosts, (VALUES ('trust'), ('distrust')) v(side)),
base AS MATERIALIZED (SELECT side, host, coalesce(s / nullif(sum(s) OVER (PARTITION BY side), 0), 0)::DOUBLE AS seed,
  EXISTS (SELECT 1 FROM shares x WHERE x.side = m.side AND x.src = m.host) AS linked FROM marked m),
r0 AS MATERIALIZED (SELECT side, host, linked, seed AS rank FROM base)"""
    for k in range(ROUNDS):
        q += f""",
r{k + 1} AS MATERIALIZED (SELECT b.side, b.host, b.linked, {1 - DAMPING} * b.seed + {DAMPING} * (coalesce(c.came, 0) + l.loose * b.seed) AS rank FROM base b
  JOIN (SELECT side, sum(CASE WHEN linked THEN 0 ELSE rank END) AS loose FROM r{k} GROUP BY side) l ON l.side = b.side
  LEFT JOIN (SELECT r.side, s.dst, sum(r.rank * s.share) AS came FROM r{k} r JOIN shares s ON s.side = r.side AND s.src = r.host GROUP BY ALL) c
  ON c.side = b.side AND c.dst = b.host)"""
    return q + f""",
f AS (SELECT host, max(rank) FILTER (side = 'trust') AS t, max(rank) FILTER (side = 'distrust') AS d, (SELECT count(*) FROM hosts) AS n FROM r{ROUNDS} GROUP BY host)
SELECT p.page_id, p.host, round(t, 9) AS trust, round(d, 9) AS distrust, coalesce((d > t AND d * n >= {CUT})::INT, 0) AS blocked
FROM (SELECT page_id, nullif({host('url')}, '') AS host FROM pages) p LEFT JOIN f ON f.host = p.host"""


QUERIES = {"op3_link_trust": op3_link_trust}
SQL = {"op3_link_trust": _sql()}
