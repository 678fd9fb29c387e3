"""A bounded breadth-first crawl over page snapshots, and robots rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lavra.config import FORMATS
from lavra.functions.url import in_scope, is_pdf
from lavra.session import Scratch


@dataclass(frozen=True)
class CrawlOptions:
    """Limits of a crawl; invalid ones raise."""

    seed: str
    max_depth: int = 2
    max_pages: int = 500
    same_domain_only: bool = True
    output_format: str = "txt"

    def __post_init__(self) -> None:
        parts = urlsplit(self.seed)
        if parts.scheme not in ("http", "https") or not parts.netloc:
            raise ValueError("the seed must be an absolute http(s) URL")
        if self.max_depth < 0:
            raise ValueError("max_depth must be 0 or more")
        if self.max_pages < 1:
            raise ValueError("max_pages must be 1 or more")
        if self.output_format not in FORMATS:
            raise ValueError("output_format must be txt or md")


def robots_policy(body: str | None, status: int = 200) -> RobotFileParser | None:
    """The policy of a robots.txt: parsed at 200, everything forbidden at 401 and 403, none otherwise."""
    policy = RobotFileParser()
    if status in (401, 403):
        policy.disallow_all = True
        return policy
    if status != 200 or body is None:
        return None
    policy.parse(body.splitlines())
    return policy


def allowed(url: Column, policy: RobotFileParser | None, agent: str = "*") -> Column:
    """Whether the policy, one for the whole crawl, lets ``agent`` fetch each URL."""
    if policy is None:
        return F.lit(True)

    @F.pandas_udf(T.BooleanType())
    def check(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: bool(u) and policy.can_fetch(agent, u))

    return check(url)


def crawl(links: DataFrame, options: CrawlOptions, policy: RobotFileParser | None = None, stop: Callable[[], bool] = lambda: False, progress: Callable[[int, int], None] = lambda depth, pages: None) -> DataFrame:
    """(url, depth, outcome) of every URL the crawl reaches: 'visited', 'pdf', 'blocked', 'missing' or 'over_budget'.

    ``links`` has (src, dst), both normalized; a page exists if it is a src (a NULL dst for one without links). URLs are
    taken by depth, then the rank of the page that leads to them first, then name, as in a queue; only visited pages count against
    ``max_pages``. Each level is one plan: the frontier's links, those in scope, without the ones seen before. ``stop`` is asked between levels; ``progress`` gets depth and pages so far.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "crawl")
    base = (urlsplit(options.seed).hostname or "").lower()
    known = scratch.write(links.select(F.col("src").alias("url")).distinct(), "known")
    frontier = spark.createDataFrame([(options.seed, 0)], "url STRING, parent INT")
    seen, results, pages, depth = frontier.select("url"), None, 0, 0
    while not stop():
        judged = frontier.join(known.withColumn("exists", F.lit(True)), "url", "left").withColumn(
            "outcome",
            F.when(~allowed(F.col("url"), policy), "blocked").when(is_pdf(F.col("url")), "pdf").when(F.col("exists").isNull(), "missing").otherwise("visited"),
        )
        judged = scratch.write(judged.select("url", F.lit(depth).alias("depth"), "outcome", "parent"), f"level{depth}")
        here = judged.where("outcome = 'visited'").count()
        # As many rows as the budget has left at most, so one task ranks them.
        first = judged.where("outcome = 'visited'").orderBy("parent", "url").limit(options.max_pages - pages)
        first = scratch.write(first.select("url", F.row_number().over(Window.orderBy("parent", "url")).alias("rank")), f"ranks{depth}")
        judged = judged.join(first, "url", "left").select(
            "url", "depth", F.when((F.col("outcome") == "visited") & F.col("rank").isNull(), "over_budget").otherwise(F.col("outcome")).alias("outcome")
        )
        results = judged if results is None else results.union(judged)
        pages = min(pages + here, options.max_pages)
        progress(depth, pages)
        if depth >= options.max_depth or pages >= options.max_pages or here == 0:
            break
        found = links.join(first.select(F.col("url").alias("src"), "rank"), "src").select(F.col("dst").alias("url"), "rank")
        found = found.where(in_scope(F.col("url"), F.lit(base), options.same_domain_only)).groupBy("url").agg(F.min("rank").alias("parent")).join(seen, "url", "left_anti")
        depth += 1
        frontier = scratch.write(found, f"frontier{depth}")
        seen = seen.union(frontier.select("url"))
        if frontier.limit(1).count() == 0:
            break
    return results if results is not None else spark.createDataFrame([], "url STRING, depth INT, outcome STRING")


def crawl_counters(results: DataFrame) -> DataFrame:
    """(visited_urls, pdf_urls, failed_urls, blocked_urls) of a crawl; missing pages failed."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return results.agg(n("visited").alias("visited_urls"), n("pdf").alias("pdf_urls"), n("missing").alias("failed_urls"), n("blocked").alias("blocked_urls"))


def changed_panels(items: DataFrame, key: str = "url", order: str = "captured_at", tie: str = "item_id", content: str = "html") -> DataFrame:
    """``items`` with ``changed``: whether a panel's content differs from the one captured before at the same place."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(order, tie))
    return items.withColumn("changed", ~F.coalesce(F.col(content), F.lit("")).eqNullSafe(F.coalesce(before, F.lit(""))))
