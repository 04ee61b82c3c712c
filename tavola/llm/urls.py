"""URL rules with redirect equivalence, in DataFrame operations only.

Pages declare aliases by canonical links and by refresh redirects.  Connected
components over these edges make classes of equal addresses; an address that
no rule fits takes the verdict of the rules that fit its aliases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize
from .tables import dealt_anew, free, table

#: (verdict, host, path) of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; one that is empty is ``/``."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda had, x: F.when(x == ".", had).when(x == "..", F.slice(had, 1, F.greatest(F.size(had) - 1, F.lit(0)))).otherwise(F.concat(had, F.array(x))),
    )
    ends = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    plain = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends, "/").otherwise(""))).otherwise(plain)


def address(url: Column) -> Column:
    """What names a page: host, path and query; null if there is no ``://``.

    Without scheme and fragment, a port that is the scheme's own, and dot
    segments; a missing path is ``/``.  Both ends of every link pass here.
    """
    rest = _rest(url)
    port = F.when(url.rlike("(?i)^\\s*http://"), r":80?$").when(url.rlike("(?i)^\\s*https://"), r":(?:443)?$").otherwise(":$")
    host = F.regexp_replace(host_of(url), port, F.lit(""))
    query = F.regexp_extract(rest, r"^[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(rest != "", F.concat(host, _without_dots(path_of(url)), query))


def joined(base: Column, target: Column) -> Column:
    """The address that ``target`` has on the page ``base``, before normalizing; null for schemes of no pages, and where the base is no address."""
    t = F.regexp_replace(target, "#.*$", "")
    scheme, origin = F.regexp_extract(base, r"^(.*?):?//", 1), F.regexp_extract(base, r"^(.*?://[^/?#]*)", 1)
    path = path_of(base)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1))
    relative = (
        F.when(F.startswith(t, F.lit("//")), F.concat(scheme, F.lit(":"), t))
        .when(F.startswith(t, F.lit("/")), F.concat(origin, t))
        .when(F.startswith(t, F.lit("?")), F.concat(origin, path, t))
        .when(t == "", base)
        .otherwise(F.concat(origin, folder, t))
    )
    return F.when(t.rlike("(?i)^https?://"), t).when(t.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None).otherwise(F.when(origin != "", relative))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as ``struct<rule, verdict>``, null if none fits; of equally long ones the first."""
    cases = []
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        cases.append((fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), none)


def _attribute(tag: Column, name: str) -> Column:
    """Its value, trimmed; empty without it."""
    pattern = rf"(?i)[\s\x22\x27/]{name}\s*=\s*(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27|([^\s\x22\x27>]+))"
    return F.trim(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)``: addresses that a page's canonical link or refresh redirect makes equal.

    Targets are resolved against the page's address (a missing path, ``.``,
    ``..``, ``?query`` and ``//host`` included).  ``rel`` may name more than
    ``canonical``.  What stands in comments, scripts and styles declares
    nothing; targets that are no web pages make no edge.
    """
    url = F.col(url_col).cast("string")
    html = F.regexp_replace(F.col(html_col).cast("string"), r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", " ")
    found = F.when(F.col(html_col).cast("string").rlike("(?i)canonical|http-equiv"), F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>?"), F.lit(0)))
    tags = pages.select(url.alias("u"), F.explode(found).alias("t"))
    canonical = F.col("t").rlike("(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(F.col("t"), "rel")), r"\s+"), "canonical")
    refresh = F.col("t").rlike("(?i)^<meta") & (F.lower(_attribute(F.col("t"), "http-equiv")) == "refresh")
    jump = F.regexp_extract(_attribute(F.col("t"), "content"), r"(?i)\burl\s*=\s*[\x22\x27]?([^\x22\x27\s>]+)", 1)
    out = tags.select("u", F.when(canonical, _attribute(F.col("t"), "href")).when(refresh, jump).alias("t")).where("t <> ''")
    out = out.withColumn("t", F.regexp_replace("t", "(?i)&(?:amp|#38|#x26);?", "&"))
    return out.select(address(F.col("u")).alias("a"), address(joined(F.col("u"), F.col("t"))).alias("b")).where("a is not null and b is not null and a <> b").distinct()


def judge_urls(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, url_col: str = "url", html_col: str = "html", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` (columns of these names are replaced).

    A row's own rule decides.  Without one, its class of aliases does: any
    allow rule there allows, else any block rule blocks, else ``default``.
    ``edges (a, b)`` are addresses; by default those that the pages declare.
    Null addresses, and those without ``://``, have empty host and path, fit no
    rule and get ``default``.  Repeated rows are judged alike.
    """
    url = F.col(url_col).cast("string")
    if edges is None:
        edges = alias_edges(pages, url_col, html_col)
    member = connected_components(edges, "a", "b")
    known = rule_of(F.regexp_extract("node", r"^[^/?#]*", 0), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1), rules)["verdict"]
    member = materialize(member.select("node", "component", known.alias("v")), "aliases")
    said = member.groupBy("component").agg(F.when(F.max(F.col("v") == "allow"), "allow").when(F.max(F.col("v") == "block"), "block").alias("_said"), F.count("*").alias("n"))
    said = dealt_anew(said.where("_said is not null"), ["component"], "n")
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    own, at, node, told = (free(x, keep) for x in ("own", "at", "node", "told"))
    said = member.join(said, "component").select(F.col("node").alias(node), F.col("_said").alias(told))
    out = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias(at))
    out = out.withColumn(own, rule_of(F.col("host"), F.col("path"), rules))
    out = out.join(said, F.col(at) == F.col(node), "left")
    return out.select(*keep, "host", "path", F.col(f"`{own}`.rule").alias("rule"), F.coalesce(F.col(f"`{own}`.verdict"), told, F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of all pages."""
    pages = table(spark, sf_dir, "pages")
    out = judge_urls(pages.select("page_id", "url"), edges=alias_edges(pages))
    return out.select("page_id", "host", "path", "rule", "verdict")


_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, url, html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, html, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
n AS (SELECT *, host || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS node FROM h),
link AS (SELECT n.node AS a, regexp_extract(t, '(?i)\b(?:href|url)\s*=\s*["'']?[a-z]+://([^"''\s>#]+)', 1) AS b FROM n, unnest(list_concat(regexp_extract_all(n.html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical[^>]*>'), regexp_extract_all(n.html, '(?i)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>'))) AS x(t)),
both_ways AS (SELECT a, b FROM link WHERE b <> '' UNION SELECT b, a FROM link WHERE b <> ''),
reach AS (SELECT DISTINCT a AS s, a AS t FROM both_ways UNION SELECT s, b FROM reach JOIN both_ways ON t = a),
rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
told AS (SELECT s, max(CASE WHEN verdict = 'allow' THEN 2 ELSE 1 END) AS v FROM (SELECT s, t, arg_max(verdict, length(rh || rp)) AS verdict FROM (SELECT s, t, regexp_extract(t, '^[^/?#]*') AS th, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS tp FROM reach) JOIN rules ON (th = rh OR ends_with(th, '.' || rh)) AND starts_with(tp, rp) GROUP BY s, t) GROUP BY s),
own AS (SELECT page_id, url, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM n JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, url)
SELECT n.page_id, host, path, own.rule AS rule, coalesce(own.verdict, CASE v WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN own ON n.page_id = own.page_id AND n.url IS NOT DISTINCT FROM own.url LEFT JOIN told ON told.s = n.node
"""

QUERIES = {"op7_url_filter": op7_url_filter}
ORACLE = {"op7_url_filter": _SQL}
