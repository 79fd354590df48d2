"""URL filters: a trie over reversed host labels and path segments.

A rule (verdict, host, path) fits its host and all subdomains where the url's
path starts with the rule's.  The longest fitting rule wins, counted in
characters of host and path; of equal ones the longer host, then block.  A url
that no rule fits gets ``default``.

The rules are compiled once into nested dicts and broadcast; a list whose text exceeds ``TRIE_BYTES`` is refused here and belongs in
``judge_by_join``, which looks the same rules up by a join and needs no bound.

Null urls and urls without ``://`` have an empty host and path and so fit no
rule.  Rows, repeated ones too, are judged one by one; empty tables give empty
results; further columns pass through unless named host, path, rule or verdict,
which are replaced.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import unused

TRIE_BYTES = 64 << 20
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


class Trie:
    """hosts: nested by label from the right; each may hold paths, nested by segment.

    A path node's ends map the start of the next segment to (verdict, rule).
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {"next": {}, "paths": None}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks: {verdict}")
            host = host.lower()
            node = self.root
            for label in reversed(host.split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            at = node["paths"] = node["paths"] or {"next": {}, "ends": {}}
            *whole, last = path.split("/")
            for segment in whole:
                at = at["next"].setdefault(segment, {"next": {}, "ends": {}})
            if at["ends"].get(last, ("",))[0] != "block":  # of equal rules block wins
                at["ends"][last] = (verdict, host + path)

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the winner."""
        best, won = (-1, -1), (None, None)
        if not host:
            return won
        node, depth = self.root, 0
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node, depth = node["next"].get(label), depth + 1
            if node is None:
                break
            at = node["paths"]
            for segment in segments:
                if at is None:
                    break
                if at["ends"]:
                    for k in range(len(segment) + 1):
                        if end := at["ends"].get(segment[:k]):
                            verdict, rule = end
                            if (len(rule), depth) > best:
                                best, won = (len(rule), depth), (rule, verdict)
                at = at["next"].get(segment)
        return won


def judge(df: DataFrame, rules: Iterable[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict."""
    rules = list(rules)
    if sum(len(h) + len(p) for _, h, p in rules) > TRIE_BYTES:
        raise ValueError("too many rules for a broadcast trie; use judge_by_join")
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def fitting(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        longest = trie.value.longest
        return pd.DataFrame([longest(h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"], index=host.index)

    host, path = host_and_path(F.col(url_col))
    won = unused(df, "_won")
    out = df.withColumns({"host": host, "path": path}).withColumn(won, fitting("host", "path"))
    return out.withColumns({"rule": F.col(won)["rule"], "verdict": F.coalesce(F.col(won)["verdict"], F.lit(default))}).drop(won)


def judge_by_join(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """As judge, for a table (verdict, host, path) of any size.

    Distinct (host, path) pairs are looked up under each host suffix and path
    prefix; a plain equi-join, so a hot host is one pair per distinct path.
    """
    host, path = host_and_path(F.col(url_col))
    out = df.withColumns({"host": host, "path": path})
    asked = out.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    asked = asked.withColumn("_labels", F.explode(F.sequence(F.lit(1), F.size(labels))))
    asked = asked.withColumn("_host", F.array_join(F.slice(labels, -F.col("_labels"), F.col("_labels")), "."))
    asked = asked.withColumn("_end", F.explode(F.sequence(F.lit(0), F.length("path")))).withColumn("_path", F.substring("path", F.lit(1), F.col("_end")))
    known = rules.select(F.lower("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    fits = asked.join(known, ["_host", "_path"])
    rank = F.struct((F.length("_host") + F.col("_end")).alias("a"), F.col("_labels").alias("b"), (F.col("_verdict") == "block").alias("c"))
    name = unused(df, "_won")
    won = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("verdict")), rank).alias(name))
    out = out.drop("rule", "verdict").join(won, ["host", "path"], "left")
    return out.withColumns({"rule": F.col(name)["rule"], "verdict": F.coalesce(F.col(name)["verdict"], F.lit(default))}).drop(name)
