"""URL filters: allow and block rules by host and path, and for urls that no rule fits, link-graph propagation: personalised
PageRank from trusted seeds and reversed distrust from blocked seeds over host edges, thresholded per host. DataFrame functions
only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, stored

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
MARGIN = 1e-9
#: Rounds between two looks at how far the scores still move.
STRIDE = 5
#: Rounds of the SQL, which cannot stop by convergence: beyond them less than 1e-14 of the seeds moves.
SQL_ROUNDS = 200


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: tuple) -> Column:
    """The longest rule (host and path together) that fits columns host and path, as a struct (rule, verdict), or null.

    Of rules of equal length the first in the order of their texts wins; of equal rules, block.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]], r[0] == "block")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and the share w of src's outgoing links, over links to other hosts in the pages' html.

    Links of a page are counted in its row, then over the host: a hot host is pre-aggregated before the shuffle.
    """
    links = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*((?:https?:)?//[^/?#\"'\s>]+)"), F.lit(1))
    targets = pages.select(url_host(F.col("url")).alias("src"), F.explode(links).alias("link"))
    targets = targets.select("src", _ascii_lower(F.regexp_replace("link", r"(?i)^(https?:)?//", "")).alias("dst"))
    counted = targets.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = counted.groupBy("src").agg(F.sum("n").alias("all_n"))
    return counted.join(out, "src").select("src", "dst", (F.col("n") / F.col("all_n")).alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = MARGIN, damping: float = DAMPING) -> DataFrame:
    """(host, score) of score = (1 - damping) * seed + damping * sum(w * score of the sources), each within tolerance of the limit.

    edges: src, dst, w with weights of a source adding up to 1; what reaches a host without links stays there. So all changes of a
    round together are at most damping times those of the round before, and the rest of the series is known: rounds end when it is
    under the tolerance, after a number that grows with the logarithm of the number of seeds. Scores are written every few rounds,
    which cuts the lineage, and only the sum of the changes comes to the driver.
    """
    own = seeds.select("host", (F.lit(1 - damping) * F.col("seed")).alias("score"))

    def moved(scores: DataFrame) -> DataFrame:
        along = edges.join(scores.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (damping * F.col("w") * F.col("score")).alias("score"))
        return along.unionByName(own).groupBy("host").agg(F.sum("score").alias("score"))

    scores = own
    while True:
        read_from = scores
        for _ in range(STRIDE - 1):
            scores = moved(scores)
        before = stored(scores, "host-scores")
        both = moved(before).withColumn("change", F.col("score")).unionByName(before.select("host", F.lit(0.0).alias("score"), (-F.col("score")).alias("change")))
        last = stored(both.groupBy("host").agg(F.sum("score").alias("score"), F.abs(F.sum("change")).alias("change")), "host-scores")
        change = last.agg(F.sum("change")).first()[0] or 0.0
        discard(before, read_from)
        if change * damping / (1 - damping) <= tolerance:
            return last.select("host", "score")
        scores = last.select("host", "score")
        scores._stored_at = last._stored_at  # type: ignore[attr-defined]


def host_scores(pages: DataFrame, judged: DataFrame) -> DataFrame:
    """(host, trust, distrust). judged: host and the verdict of a rule, one row a url.

    A host is a trusted seed if rules allow more of its urls than they block, and a blocked seed the other way round. Trust moves
    along links; distrust moves against them, as a page that links to blocked hosts is suspect.
    A seed weighs 1, whatever the number of seeds: scores are personalised PageRank times that number, and MARGIN is in its units.
    """
    edges = stored(host_edges(pages), "host-edges")
    into = edges.groupBy("dst").agg(F.sum("w").alias("all_w"))
    back = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") / F.col("all_w")).alias("w"))
    votes = judged.where("verdict IS NOT NULL AND host <> ''").groupBy("host").agg(F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(-1)).alias("votes"))
    votes = stored(votes, "host-votes")
    trust = propagate(edges, votes.where("votes > 0").select("host", F.lit(1.0).alias("seed")))
    distrust = propagate(back, votes.where("votes < 0").select("host", F.lit(1.0).alias("seed")))
    both = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row of `pages` (page_id, url, html).

    A fitting rule decides; else the page's host is blocked if its distrust exceeds its trust by more than MARGIN. Hosts without
    either are allowed. Null or odd urls have an empty host and path; null html has no links; repeated rows are judged alike;
    an empty table gives an empty result; extra columns are left out.
    """
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = source.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = parsed.withColumn("_fit", fitting_rule(rules)).select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("verdict"))
    scores = stored(host_scores(source, judged), "host-judged")
    joined = judged.join(scores, "host", "left")
    bad = F.coalesce(F.col("distrust") - F.col("trust") > MARGIN, F.lit(False))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by rule or by its host's trust; nulls and repeats as in judge_urls."""
    return judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _op10_sql() -> str:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p} {v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    sql = f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{upper}', '{lower}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), fitted AS (SELECT *, CASE {cases} END AS fit FROM parsed),
judged AS (SELECT page_id, html, host, path, split_part(fit, ' ', 1) AS rule, split_part(fit, ' ', 2) AS verdict FROM fitted),
links AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '\\bhref\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1, 'i')) AS link FROM judged
), counted AS (
  SELECT src, dst, count(*) AS n FROM (SELECT src, translate(link, '{upper}', '{lower}') AS dst FROM links)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
), edges AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM counted),
back AS MATERIALIZED (SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS w FROM edges),
votes AS MATERIALIZED (SELECT host, sum(CASE WHEN verdict = 'allow' THEN 1 ELSE -1 END) AS votes FROM judged WHERE verdict IS NOT NULL AND host <> '' GROUP BY host)"""
    for name, graph, sign in (("t", "edges", ">"), ("d", "back", "<")):
        own = f"SELECT host, {1 - DAMPING!r}::DOUBLE AS score FROM votes WHERE votes {sign} 0"
        sql += f""",
{name}(k, host, score) AS (
  SELECT 0, host, score FROM ({own}) UNION ALL
  SELECT k + 1, host, sum(score) FROM (
    SELECT s.k, e.dst AS host, {DAMPING} * e.w * s.score AS score FROM {name} s JOIN {graph} e ON e.src = s.host
    UNION ALL SELECT r.k, o.host, o.score FROM (SELECT DISTINCT k FROM {name}) r, ({own}) o
  ) WHERE k < {SQL_ROUNDS} GROUP BY k, host
)"""
    return sql + f"""
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN coalesce(d.score, 0) - coalesce(t.score, 0) > {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN (FROM t WHERE k = {SQL_ROUNDS}) t ON t.host = j.host LEFT JOIN (FROM d WHERE k = {SQL_ROUNDS}) d ON d.host = j.host
"""


OP10_SQL = _op10_sql()
