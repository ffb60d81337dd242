"""URL filters: block and allow rules by host and path, and block decisions that reach the aliases of a blocked address."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready
from tidemark.llm.components import connected_components
from tidemark.session import stage

BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    def __post_init__(self):
        if self.verdict not in (BLOCK, ALLOW) or not self.host or not self.path.startswith("/"):
            raise ValueError(f"not a rule: {self}")

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule(BLOCK, "net", "/"), Rule(ALLOW, "example.net", "/en/"), Rule(BLOCK, "example.com", "/de/"), Rule(ALLOW, "org", "/fr/"))

#: What a page must hold to be searched for edges.
HINT = r"(?i)canonical|http-equiv"


# --- parts of an address


def _lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return _lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Name of the longest rule that fits, else null; of equal lengths the one with the longer host. Two verdicts for one name make no sense."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def _verdict(rule: Column, rules: Sequence[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.name, F.lit(r.verdict)).otherwise(out)
    return out


# --- edges between addresses

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"""<(link|meta|base)\b((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_REFRESH = re.compile(r"""\s*[\d.]+\s*[;,]?\s*url\s*=\s*["']?([^"']*)""", re.I)


def links_of(url: str | None, source: str) -> list[str]:
    """Absolute addresses that a page names as its canonical one or redirects to (meta refresh)."""
    found, base = [], url or ""
    for name, inside in _TAG.findall(_COMMENT.sub(" ", source)):
        has = {k.lower(): entities.unescape(a or b or c).strip() for k, a, b, c in _ATTRIBUTE.findall(inside)}
        target = None
        if name.lower() == "base":
            base = _join(base, has.get("href")) or base
        elif name.lower() == "link" and "canonical" in has.get("rel", "").lower().split():
            target = has.get("href")
        elif name.lower() == "meta" and has.get("http-equiv", "").lower() == "refresh":
            match = _REFRESH.match(has.get("content", ""))
            target = match and match.group(1).strip()
        joined = _join(base, target)
        if joined:
            found.append(joined)
    return found


def _join(base: str, target: str | None) -> str | None:
    if not target:
        return None
    try:
        joined = urljoin(base, target)
    except ValueError:  # a host that no parser takes
        return None
    return joined if "://" in joined else None


_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def node_of(url: str) -> str:
    """Address without fragment, A-Z of scheme and host lower-cased, an empty path and query as ``/``."""
    scheme, _, rest = url.split("#", 1)[0].partition("://")
    host = re.match(r"[^/?]*", rest).group()
    return f"{scheme.translate(_ASCII)}://{host.translate(_ASCII)}{rest[len(host):] or '/'}"


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst`` addresses: each page that names a canonical address or a redirect, and that address. Repeated pages give their edges once."""
    told = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).filter(
        F.col("html").rlike(HINT) & (F.instr("url", "://") > 0)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for target in links_of(url, source.as_py()):
                    src.append(node_of(url))
                    dst.append(node_of(target))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], names=["src", "dst"])

    return told.mapInArrow(run, "src string, dst string").filter("src <> dst").distinct()


def _nodes(pages: DataFrame, url_col: str) -> Column:
    """:func:`node_of` as a column."""
    url = F.regexp_replace(F.col(url_col), "(?s)#.*", "")
    scheme = _lower(F.substring_index(url, "://", 1))
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), _lower(host), F.when(path == "", F.lit("/")).otherwise(path)))


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page.

    The longest rule that fits decides. A page without a rule is blocked if any address it is equivalent to is blocked by a rule, else
    allowed: redirects and canonical links (``edges`` as ``src, dst`` addresses, by default read from the pages) join addresses to components,
    whether the addresses are pages or not, and a blocked address blocks its whole component. A rule that allows is explicit and wins over a block
    that only reaches the page through its aliases; it does not spread. A null address, or one without ``://``, has no host, path, rule or alias
    and is allowed. Repeated rows are judged each; other columns are ignored. Pages are read once for edges and once for their rows; only edges
    and addresses that take part in one are shuffled, never html.
    """
    ready(pages.sparkSession)
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    told = slim.select("page_id", "url", host.alias("host"), path.alias("path"))
    told = told.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    joined = stage(alias_edges(pages, url_col, html_col) if edges is None else edges.select("src", "dst"), "alias-edges")
    members = stage(connected_components(joined), "aliases")
    node_rule = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    blocked = members.filter(_verdict(node_rule, rules) == BLOCK).select("component").distinct()
    tainted = members.join(blocked, "component", "left_semi").select(F.col("node"), F.lit(True).alias("_blocked"))
    # Rows without a node, and addresses that share a null, must not meet in one task: only rows that a component can reach are joined.
    open_rows = F.when(F.col("rule").isNull(), _nodes(told, "url"))
    out = told.withColumn("_node", open_rows).join(tainted, F.col("_node") == F.col("node"), "left")
    verdict = F.coalesce(_verdict(F.col("rule"), rules), F.when(F.col("_blocked"), F.lit(BLOCK)), F.lit(ALLOW))
    return out.select(F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


def sql(rules: Sequence[Rule] = RULES) -> str:
    """The same in DuckDB's dialect. Addresses in links count there if they are absolute, or start with ``/`` or ``//``."""
    fits = lambda r, h, p: f"(({h} = '{r.host}' OR ends_with({h}, '.{r.host}')) AND starts_with({p}, '{r.path}'))"
    longest = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    pick = lambda value: "CASE " + " ".join(f"WHEN {fits(r, 'host', 'path')} THEN '{value(r)}'" for r in longest) + " END"
    rest = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
    lower = lambda e: f"translate({e}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: lower(f"regexp_extract({rest(u)}, '^[^/?#]*')")
    path = lambda u: f"regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1)"
    bare = lambda u: f"regexp_replace({u}, '(?s)#.*', '')"
    tail = lambda u: f"regexp_replace({rest(bare(u))}, '^[^/?]*', '')"
    start = lambda u: lower(f"split_part({bare(u)}, '://', 1)") + " || '://' || " + lower(f"regexp_extract({rest(bare(u))}, '^[^/?]*')")
    node = lambda u: f"CASE WHEN instr({bare(u)}, '://') > 0 THEN {start(u)} || CASE WHEN {tail(u)} = '' THEN '/' ELSE {tail(u)} END END"
    return f"""WITH RECURSIVE told AS (SELECT page_id, url, coalesce({host('url')}, '') AS host, coalesce({path('url')}, '') AS path, {node('url')} AS node FROM pages),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<(?:link|meta)\\b[^>]*>')) AS tag
  FROM pages WHERE instr(url, '://') > 0 AND regexp_matches(html, '(?i)canonical|http-equiv')),
targets AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?is)^<link\\b.*\\srel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b') THEN regexp_extract(tag, '(?is)\\shref\\s*=\\s*["'']?([^"''>\\s]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\\b.*http-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?is)content\\s*=\\s*["'']?[\\d.]+\\s*[;,]?\\s*url\\s*=\\s*([^"''>\\s]+)', 1) END AS href FROM tags),
links AS (
  SELECT url, CASE WHEN instr(href, '://') > 0 THEN href WHEN starts_with(href, '//') THEN split_part(url, '://', 1) || ':' || href
    WHEN starts_with(href, '/') THEN split_part(url, '://', 1) || '://' || regexp_extract({rest('url')}, '^[^/?#]*') || href END AS target FROM targets),
edges AS (SELECT DISTINCT {node('url')} AS src, {node('target')} AS dst FROM links WHERE target IS NOT NULL),
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
judged AS (SELECT node, {pick(lambda r: r.verdict)} AS verdict FROM (SELECT src AS node, {host('src')} AS host, {path('src')} AS path FROM both_ways)),
tainted AS (SELECT node FROM judged WHERE verdict = 'block' UNION SELECT b.dst FROM tainted t JOIN both_ways b ON b.src = t.node)
SELECT page_id, host, path, {pick(lambda r: r.name)} AS rule,
  coalesce({pick(lambda r: r.verdict)}, CASE WHEN node IN (SELECT node FROM tainted) THEN 'block' ELSE 'allow' END) AS verdict
FROM told"""


SQL = sql()
