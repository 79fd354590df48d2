"""A breadth-first crawl with a stored frontier, which can stop after any round and be resumed.

The web is a table (url, html).  The state is a small table of its own: each url once, with its
depth and whether it is queued, done or missing.  A round takes the queued urls of the least
depth, reads their pages, and queues the links that lead to the same domain and were never
seen, within the depth allowed; then it writes the state anew.  A state without Spark's mark
of completion is not looked at, so a round that dies is done again.

Budgets: ``max_pages`` pages are read at most (those of a round in the order of their urls),
to ``max_depth`` links from the start, in ``max_seconds`` (looked at between rounds).  What
is left then stays queued, and a later run with larger budgets goes on from there.

Urls are canonical: scheme and host in lower case, without fragment, default port, tracking
parameters or slash at the end.  Two rows of the web with one canonical url are one page, with
the links of both.  Links that are no web addresses (mailto:, javascript:) are ignored.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.records import is_download
from docweave.scratch import saved, shared_dir
from docweave.shipping import ship
from docweave.tables import table

QUEUED, DONE, MISSING = "queued", "done", "missing"
STATE = "url string, depth int, state string"
PORTS = {"http": 80, "https": 443}


def canonical(url: str | None, base: str | None = None) -> str | None:
    """One form for all spellings of a web address, None for what is none; relative ones need a base."""
    try:
        parts = urlsplit(urljoin(base or "", (url or "").strip()))
        port = parts.port
    except ValueError:
        return None
    scheme, host = parts.scheme.lower(), (parts.hostname or "").lower()
    if scheme not in PORTS or not host:
        return None
    where = host if port in (None, PORTS[scheme]) else f"{host}:{port}"
    query = urlencode([(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_")])
    return urlunsplit((scheme, where, parts.path.rstrip("/"), query, ""))


@F.pandas_udf(T.StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    return url.map(canonical)


@F.pandas_udf(T.ArrayType(T.StringType()))
def linked(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    """The canonical targets of a page's links."""
    return pd.Series([sorted({t for h in hs if (t := canonical(h, b))}) for b, hs in zip(base, hrefs, strict=True)])


def domain(url):
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


class Crawl:
    """A crawl's state in a folder; ``run`` goes on from its newest round."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rounds(self) -> int:
        """The number of the newest complete state, -1 for none."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(conf)
        if not files.exists(root):
            return -1
        numbers = [int(s.getPath().getName()[1:]) for s in files.listStatus(root)]
        return max((n for n in numbers if files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/r{n}/_SUCCESS"))), default=-1)

    def state(self) -> DataFrame:
        n = self.rounds()
        return self.spark.createDataFrame([], STATE) if n < 0 else self.spark.read.schema(STATE).parquet(f"{self.path}/r{n}")

    def _write(self, state: DataFrame, number: int) -> None:
        state.select("url", "depth", "state").write.mode("overwrite").parquet(f"{self.path}/r{number}")

    def start(self, urls: DataFrame) -> None:
        if self.rounds() < 0:
            first = urls.select(canonical_url("url").alias("url")).where("url IS NOT NULL").distinct()
            self._write(first.select("url", F.lit(0).alias("depth"), F.lit(QUEUED).alias("state")), 0)

    def step(self, web: DataFrame, max_depth: int, max_pages: int) -> bool:
        """One round; False if nothing is left to do within the budgets.  web is (url, html), urls canonical."""
        number, state = self.rounds(), self.state()
        about = state.agg(F.count_if(F.col("state") == DONE).alias("done"), F.min(F.when(F.col("state") == QUEUED, F.col("depth"))).alias("depth")).first()
        if about.depth is None or about.done >= max_pages:
            return False
        frontier = state.where((F.col("state") == QUEUED) & (F.col("depth") == about.depth)).select("url")
        there = web.join(frontier, "url", "left_semi")
        chosen = saved(there.select("url").distinct().orderBy("url").limit(max_pages - about.done), "chosen")
        missing = frontier.join(web.select("url").distinct(), "url", "left_anti")
        known = state.select("url")
        if about.depth < max_depth:
            hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
            targets = there.join(chosen, "url", "left_semi").select(F.col("url").alias("page"), F.explode(linked("url", hrefs)).alias("url"))
            targets = targets.where(domain(F.col("page")) == domain(F.col("url"))).where(~is_download(F.col("url"))).select("url").distinct()
            found = targets.join(known, "url", "left_anti").select("url", F.lit(about.depth + 1).alias("depth"), F.lit(QUEUED).alias("state"))
        else:
            found = self.spark.createDataFrame([], STATE)
        seen = chosen.select("url", F.lit(DONE).alias("_now")).unionAll(missing.select("url", F.lit(MISSING).alias("_now")))
        after = state.join(seen, "url", "left").select("url", "depth", F.coalesce("_now", "state").alias("state")).unionByName(found)
        self._write(after, number + 1)
        return True

    def run(self, web: DataFrame, max_depth: int = 3, max_pages: int = 1000, max_seconds: float = 3600, max_rounds: int | None = None) -> DataFrame:
        """(url, depth) of the pages read so far."""
        began, rounds = time.monotonic(), 0
        while time.monotonic() - began < max_seconds and (max_rounds is None or rounds < max_rounds) and self.step(web, max_depth, max_pages):
            rounds += 1
        return self.state().where(F.col("state") == DONE).select("url", "depth")


def pages_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as three sites: a page's address is the first word of its heading, and its links lead to such words or to the next site."""
    site = F.concat(F.lit("https://site"), (F.col("page_id") % 3).cast("string"), F.lit(".example/"))
    other = F.concat(F.lit('<a href="https://SITE'), ((F.col("page_id") + 1) % 3).cast("string"), F.lit('.example:443/the#top">next</a>'))
    word = F.lower(F.regexp_extract("html", "<h1>([A-Za-z0-9]+)", 1))
    return table(spark, sf_dir, "pages").select(canonical_url(F.concat(site, word)).alias("url"), F.concat(F.lower("html"), other).alias("html"))


def q_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of each site from the page of its first heading, stopped after one round and resumed."""
    ship(spark)
    web = saved(pages_web(spark, sf_dir), "web")
    crawl = Crawl(spark, f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}")
    starts = web.groupBy(domain(F.col("url"))).agg(F.min("url").alias("url")).select("url")
    crawl.start(starts)
    crawl.run(web, max_depth=3, max_pages=60, max_rounds=1)
    return crawl.run(web, max_depth=3, max_pages=60)


SQL = """
WITH RECURSIVE web AS (
  SELECT 'https://site' || page_id % 3 || '.example' AS site, lower(regexp_extract(html, '<h1>([A-Za-z0-9]+)', 1)) AS word, lower(html) AS html FROM pages
), named AS (
  SELECT site, site || CASE WHEN word = '' THEN '' ELSE '/' || word END AS url, html FROM web
), links AS (
  SELECT DISTINCT url AS page, rtrim(site || regexp_replace(regexp_replace(href, '#.*$', ''), '\\?.*$', ''), '/') AS url FROM (
    SELECT site, url, unnest(regexp_extract_all(html, '<a\\b[^>]*?href="([^"]*)"', 1)) AS href FROM named) h
), starts AS (
  SELECT min(url) AS url FROM named GROUP BY site
), walk(url, depth) AS (
  SELECT url, 0 FROM starts UNION SELECT l.url, w.depth + 1 FROM walk w JOIN links l ON l.page = w.url WHERE w.depth < 3 AND l.url IN (SELECT url FROM named)
)
SELECT url, depth FROM (SELECT url, min(depth)::INTEGER AS depth, row_number() OVER (ORDER BY min(depth), url) AS n FROM walk GROUP BY url) x WHERE n <= 60
"""

QUERIES = {"resumable_crawl": q_crawl}
ORACLES = {"resumable_crawl": SQL}
