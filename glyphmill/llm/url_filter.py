"""URL rules whose block decisions spread over redirect and canonical-link aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import connected_components, materialise

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule lists up to this many are sent to every task as a literal; longer ones are joined.
LITERAL_RULES = 200


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What redirects and canonical links connect: host, path and query; scheme and fragment don't count."""
    query = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^#]*?(\?[^#]*)", 1)
    return F.concat(host_of(url), path_of(url), query)


def match_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds ``rule`` and ``action`` of the longest fitting rule to ``pages(host, path, ...)``.

    ``rules`` are ``(action, host, path)``.  A rule fits its host and all
    subdomains if the path starts with the rule's path; the longest host plus
    path wins, and of equally long ones an allow.  Nulls where none fits.
    A short list becomes a literal array; a DataFrame is joined on the host's
    suffixes, so its size doesn't matter.
    """
    if not isinstance(rules, DataFrame):
        rules = [r for r in rules if None not in r]
        if len(rules) > LITERAL_RULES:
            rules = pages.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
    rank = lambda host, path, action: F.struct(
        F.length(F.concat(host, path)).alias("n"), (action == "allow").alias("allow"), F.concat(host, path).alias("rule"), action.alias("action")
    )
    if isinstance(rules, DataFrame):
        keys = pages.select("host", "path").distinct()
        parts = F.split("host", r"\.")
        keys = keys.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
        r = rules.select(F.col("action").alias("a"), F.col("host").alias("suffix"), F.col("path").alias("p"))
        best = keys.join(r, "suffix").where(F.startswith("path", "p")).groupBy("host", "path")
        best = best.agg(F.max(rank(F.col("suffix"), F.col("p"), F.col("a"))).alias("best"))
        out = pages.join(best, ["host", "path"], "left")
    elif rules:
        literal = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(h).alias("h"), F.lit(p).alias("p")) for a, h, p in rules])
        fits = F.filter(literal, lambda r: ((F.col("host") == r["h"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["h"]))) & F.startswith(F.col("path"), r["p"]))
        out = pages.withColumn("best", F.array_max(F.transform(fits, lambda r: rank(r["h"], r["p"], r["a"]))))
    else:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    return out.withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("best")


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``(url, target)`` from ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` of whole pages.

    ``canonical`` may be one of several words of ``rel``.  Targets are resolved
    against the page's url (``&amp;`` is read as ``&``): absolute ones, those
    without scheme or host, those relative to the page's folder with ``.`` and
    ``..``, and mere queries.  Fragments and other schemes (``mailto:``) make no edge.
    """
    tags = F.regexp_extract_all(html_col, F.lit(r"(?i)(<link\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), 1)
    rows = pages.select(F.col(url_col).alias("url"), F.explode(tags).alias("tag")).where("url is not null")
    canonical = F.array_contains(F.split(F.lower(_attribute("rel")), r"\s+"), "canonical")
    refresh = F.regexp_extract(_attribute("content"), r"(?i)\burl\s*=\s*[\"']?([^\"'\s]+)", 1)
    raw = F.when(F.startswith(F.lower("tag"), F.lit("<meta")), refresh).when(canonical, _attribute("href"))
    rows = rows.select("url", F.trim(F.replace(raw, F.lit("&amp;"), F.lit("&"))).alias("raw")).where("raw <> '' and not startswith(raw, '#')")
    return rows.select("url", _resolved(F.col("url"), F.col("raw")).alias("target")).where("target is not null")


def _attribute(name: str) -> Column:
    """The value of a ``tag``'s attribute, quoted or bare; empty if it has none."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract("tag", pattern, i) for i in (1, 2, 3)])


def _resolved(url: Column, raw: Column) -> Column:
    """A link's target as an absolute url; null for schemes without a host."""
    root = F.concat(F.lit("http://"), host_of(url))
    folder = F.concat(F.regexp_extract(path_of(url), r"^(.*/)", 1))
    path, rest = F.regexp_extract(raw, r"^[^?#]*", 0), F.regexp_extract(raw, r"^[^?#]*(.*)$", 1)
    parts = F.split(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path)), "/")
    climbed = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == ".", done).when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)),
    )
    end = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return (
        F.when(F.instr(raw, "://") > 0, raw).when(F.startswith(raw, F.lit("//")), F.concat(F.lit("http:"), raw))
        .when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None).when(path == "", F.concat(root, path_of(url), rest))
        .otherwise(F.concat(root, F.lit("/"), F.array_join(climbed, "/"), F.when(F.size(climbed) > 0, end).otherwise(""), rest))
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """Judges every url: ``id, host, path, rule, verdict, component``.

    A page with a fitting rule gets that rule's verdict (an explicit allow thus
    holds whatever its aliases are).  Redirects (``redirects(url, target)``) and
    canonical links or refreshes in ``html_col`` make urls equivalent; connected
    components of these edges are found by star contraction.  A page without a
    rule is blocked if a rule blocks some url of its component and no rule
    allows one; else allowed.  ``component`` is null for pages without edges.

    A null url, or one without ``://``, has an empty host and path, fits no
    rule and is allowed; null html has no edges.
    """
    edges = None if html_col is None else alias_edges(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select("url", "target").where("url is not null and target is not null")
        edges = more if edges is None else edges.unionByName(more)
    url = F.col(url_col)
    base = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = match_rules(base, rules)
    out = [F.col(id_col), "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict")]
    none = F.lit(None).cast("string").alias("component")
    if edges is None:
        return judged.select(*out, none)
    edges = materialise(edges.select("url", "target").distinct(), "aliases")
    if edges.isEmpty():
        return judged.select(*out, none)
    linked = edges.select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v"))
    components = materialise(connected_components(linked), "url-components")
    ends = edges.select("url").unionByName(edges.select(F.col("target").alias("url"))).distinct()
    ends = match_rules(ends.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")).distinct(), rules)
    spread = ends.join(components, "node").groupBy("component")
    spread = spread.agg(F.max((F.col("action") == "block").cast("int")).alias("b"), F.max((F.col("action") == "allow").cast("int")).alias("a"))
    spread = spread.select("component", (F.coalesce("b", F.lit(0)) > F.coalesce("a", F.lit(0))).alias("spread"))
    of_node = components.join(spread, "component", "left")
    final = judged.join(of_node, "node", "left")
    verdict = F.coalesce("action", F.when(F.col("spread"), "block"), F.lit("allow")).alias("verdict")
    return final.select(F.col(id_col), "host", "path", "rule", verdict, "component")
