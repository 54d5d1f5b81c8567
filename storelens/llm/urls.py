"""URL filters with redirect equivalence.

URLs that redirect to one another or name one another as canonical are one
resource.  Rules decide single URLs; a block then spreads over the connected
component to every alias that no rule of its own fits.  A URL's own rule always
comes first, so an explicit allow is never overridden by a blocked alias.

Links are read by the tag scanner of ``markup``, in one pass over the page:
comments and scripts hold none, character references are decoded.

Nulls: a null URL has an empty host and path, fits no rule and has no alias.  A
null or empty html has no links.  Repeated URLs are one node, repeated rows are
each judged.  Of rules of one length the first listed wins.  Extra columns are
kept; they must not carry the output names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.components import connected_components
from storelens.llm.markup import Page, attributes


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def own_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; the first listed wins a tie."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def absolute(target: Column, base: Column) -> Column:
    """Resolves a link against the page's URL: absolute, scheme-relative, root-relative or sibling."""
    target = F.trim(target)
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*[^?#]*/)", 1)
    return (
        F.when(target.isNull() | (target == "") | target.startswith("#"), None)
        .when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), target))
    )


_REFRESH = re.compile(r"""\s*+[0-9.]*+\s*+[;,]?\s*+url\s*+=\s*+["']?([^"'\s;]++)""", re.IGNORECASE)


def named_links(html: str) -> list[str]:
    """Targets of the page's canonical links and refresh marks, in page order; those in comments and scripts are none."""
    out = []
    for tag in Page(html).tags():
        if tag.closing or tag.name not in ("link", "meta"):
            continue
        has = attributes(tag.attributes)
        if tag.name == "link" and "canonical" in has.get("rel", "").lower().split():
            out.append(has.get("href", ""))
        elif tag.name == "meta" and has.get("http-equiv", "").strip().lower() == "refresh":
            found = _REFRESH.match(has.get("content", ""))
            out.append(found[1] if found else "")
    return [target for target in out if target.strip()]


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): the page's URL and each canonical or refresh target its html names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [named_links(value.as_py()) for value in batch.column(1)]
            owner = pa.array([i for i, targets in enumerate(found) for _ in targets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array([t for targets in found for t in targets], pa.string())], names=["u", "target"])

    # Only pages that can name a link go to Python; the names of elements have no other spelling.
    some = pages.select(F.col(url).alias("u"), F.col(html).alias("html")).where("u is not null and html is not null").where(F.col("html").rlike(r"(?i)<(?:link|meta)[\s/]"))
    named = some.mapInArrow(run, "u string, target string")
    return named.select("u", F.explode(F.array_compact(F.array(absolute(F.col("target"), F.col("u"))))).alias("v"))


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """Adds host, path, rule, verdict and component (the smallest equivalent URL) to every page.

    redirects: more (u, v) edges, for example from a crawler's 3xx log.  Edge
    ends that are no page's URL still connect and are judged by the rules too.
    """
    edges = page_links(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("u", "v"))
    members = connected_components(edges)
    parts = members.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    blocked = parts.where(own_rule(F.col("host"), F.col("path"), rules)[1] == "block").select("component").distinct()
    alias = members.join(blocked.withColumn("blocked", F.lit(True)), "component", "left").select(F.col("node").alias("_node"), F.col("component").alias("_component"), F.coalesce("blocked", F.lit(False)).alias("_blocked"))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = own_rule(F.col("host"), F.col("path"), rules)
    judged = pages.withColumns({"host": host, "path": path}).join(alias, F.col(url) == F.col("_node"), "left")
    return judged.withColumns(
        {
            "rule": rule,
            "verdict": F.coalesce(verdict, F.when(F.col("_blocked"), "block"), F.lit("allow")),
            "component": F.coalesce("_component", F.col(url)),
        }
    ).drop("_node", "_component", "_blocked")
