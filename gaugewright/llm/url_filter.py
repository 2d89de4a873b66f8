"""URL filters with redirect equivalence.

Rules on host and path prefix allow or block a URL; the longest that fits wins. URLs joined by redirects or canonical links are
aliases: connected components over these edges carry decisions to members that no rule fits. There an allowed
alias takes precedence over a blocked one. A node is a URL with its scheme and host in lower case and without its fragment.
"""

from __future__ import annotations

import html as html_entities
import re
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .staging import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern``: a host, then a path prefix from its first slash."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2] if "/" in self.pattern else ""


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The pattern of the longest rule that fits, or null."""
    chain = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):  # a longer one is asked before
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        chain = F.when(fits, F.lit(rule.pattern)).otherwise(chain)
    return chain


def node_of(url: Column) -> Column:
    """The URL as a node of the graph: scheme and host in lower case (A-Z), no fragment."""
    whole = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(whole, r"(?s)^.*?://[^/?]*", 0)
    return F.concat(F.translate(head, UPPER, LOWER), F.substr(whole, F.length(head) + 1))


#: Elements whose content is text and no markup, and the one whose markup counts only without scripts.
RAW = {*"script style noscript template textarea title iframe noembed noframes xmp svg".split()}
#: A comment, a declaration, or a tag with its attributes in quotes; a tag whose quotes never end stops at its first bracket.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.DOTALL)
_ATTR = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_DELAY = re.compile(r"\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?(?:\"([^\"]*)|'([^']*)|(.*))", re.IGNORECASE | re.DOTALL)


def _attributes(tag: str | None) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTR.findall(tag or ""):
        found.setdefault(name.lower(), html_entities.unescape("".join(values)))
    return found


def target_of(tag: str, url: str, base: str | None = None) -> str | None:
    """The URL that a canonical link or a meta refresh of the page ``url`` leads to; ``base`` is the page's base element."""
    a = _attributes(tag)
    if tag[1:5].lower() == "link":
        target = a.get("href", "") if "canonical" in a.get("rel", "").lower().split() else ""
    else:
        m = _DELAY.match(a.get("content", "")) if a.get("http-equiv", "").strip().lower() == "refresh" else None
        target = (m[1] or m[2] or m[3] or "") if m else ""
    target = re.sub(r"[\t\n\r]", "", target.strip())
    if not target:
        return None
    try:
        target = urljoin(urljoin(url, _attributes(base).get("href", "").strip()), target)
    except ValueError:  # not a URL
        return None
    return target if "://" in target else None


def declared(source: str) -> tuple[list[str], str | None]:
    """The link and meta tags of a page, and its first base element. What stands in comments, scripts, styles, ``noscript`` and the like,
    or in an attribute of another tag, is no tag."""
    tags, base, at = [], None, 0
    while m := _MARKUP.search(source, at):
        at = m.end()
        name = (m[2] or "").lower()
        if m[1] or not name:
            continue
        if name in RAW and not (name == "svg" and m[0].endswith("/>")):
            end = re.compile(rf"</{name}\b", re.IGNORECASE).search(source, at)
            if not end:
                break
            at = end.start()
        elif name in ("link", "meta"):
            tags.append(m[0])
        elif name == "base" and base is None:
            base = m[0]
    return tags, base


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): the canonical links and the redirects (meta refresh) that the pages declare, resolved against the page's URL.

    Null URLs and null or empty pages declare nothing, nor do targets that lead to the page itself or are no URL. Repeated pages give
    repeated edges, which add nothing; an empty table gives an empty one. Other columns, whatever their names, are not read."""

    @F.pandas_udf("array<string>")
    def targets(urls: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for u, source in zip(urls, sources, strict=True):
            tags, base = declared(source)
            out.append([t for tag in tags if (t := target_of(tag, u, base))])
        return pd.Series(out, dtype=object)

    likely = F.col(html).rlike(r"(?i)canonical|refresh")  # most pages without a link need no closer look
    found = pages.where(F.col(url).isNotNull() & likely).select(F.col(url).alias("src"), F.explode(targets(url, html)).alias("dst"))
    return found.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src <> dst")


def judge(pages: DataFrame, edges: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """The columns of ``pages`` that are not named so, and ``host``, ``path``, ``rule`` and ``verdict``.

    A URL is allowed unless its rule, or without one an alias, blocks it. Null URLs and URLs without ``://`` have an empty host and
    path, fit no rule and have no alias. Repeated rows are judged alike; an empty table of either kind is fine.
    """
    verdicts = {r.pattern: r.verdict for r in rules}
    own = F.coalesce(*[F.when(F.col("rule") == p, F.lit(v)) for p, v in verdicts.items()]) if rules else F.lit(None).cast("string")

    def ruled(df: DataFrame, of: str) -> DataFrame:
        df = df.withColumns({"host": host_of(F.col(of)), "path": path_of(F.col(of))})
        return df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    edges = edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))
    groups = written(connected_components(edges), "aliases")
    decided = ruled(groups, "node").withColumn("own", own)
    by_group = decided.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    alias = groups.join(by_group, "component").where("blocked and not coalesce(allowed, false)").select(F.col("node").alias("alias_"))
    alias = written(alias, "blocked")

    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "alias_")]
    out = ruled(pages.select(*rest), url)
    out = out.join(alias, node_of(F.col(url)) == F.col("alias_"), "left")
    return out.withColumn("verdict", F.coalesce(own, F.when(F.col("alias_").isNotNull(), F.lit("block")), F.lit("allow"))).select(*rest, "host", "path", "rule", "verdict")
