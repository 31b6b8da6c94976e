"""URL filtering with rules that reach all aliases of a page.

Rules judge single addresses. Redirects and canonical links say that addresses
stand for the same page, so the connected components over these links carry a
block from any address to all that no rule names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.llm.columns import own_name
from changerisk.llm.components import components
from changerisk.llm.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only say where a visitor came from.
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid)"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    block: bool
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name and verdict of the longest rule that fits, else null.

    The rules are a short list given by the caller, held in the expression. Of
    rules of the same length one that allows goes first, then the order given.
    """
    found = F.lit(None).cast("struct<rule:string,block:boolean>")
    for r in sorted(rules, key=lambda r: (len(r.name), not r.block)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.block).alias("block"))
                       ).otherwise(found)
    return found


def address(url: Column) -> Column:
    """The address as a node: without scheme, fragment, tracking parameters and a final slash."""
    host, path = host_of(url), path_of(url)
    asked = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(asked, rf"(?:^|&){TRACKING}=[^&]*", "")
    kept = F.regexp_replace(kept, "^&+", "")
    return F.when(host != "", F.concat(
        host, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept))
        .otherwise("")))


def _beside(own: Column, target: Column) -> Column:
    """Path and query of a relative target, ``.`` and ``..`` resolved against the page's folder."""
    ahead = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(path_of(own), "^/|[^/]*$", ""))
    steps = F.split(F.concat(folder, ahead), "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(
        s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(s))))
    return F.when(ahead == "", F.concat(path_of(own), target)).otherwise(
        F.concat(F.array_join(walked, "/"), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)))


def page_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Redirect and canonical-link edges ``(a, b)`` between addresses.

    Read from ``<link rel=canonical href=..>`` and ``<meta http-equiv=refresh
    content="..;url=..">``, attributes in any order, quoted or not. Targets
    without a host are taken on the page's own host, those without a leading
    slash in the page's own folder, a query alone on its path. Other schemes
    (``mailto:``) and fragments alone give no edge.
    """
    def attribute(name: str) -> Column:
        value = r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
        return F.concat(*[F.regexp_extract("tag", rf"(?is)[\s\"'/]{name}\s*=\s*{value}", group)
                          for group in (1, 2, 3)])

    def once(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
        # A generator, so that the value is computed once and not pasted into each use.
        return df.select(*keep, F.explode(F.array(value)).alias(name))

    tags = pages.where(F.col(html).rlike("(?i)canonical|refresh")).select(
        F.col(url).alias("own"), F.explode(F.regexp_extract_all(
            F.col(html), F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), 1)).alias("tag"))
    found = tags.select(
        "own", F.lower(attribute("rel")).contains("canonical").alias("canonical"),
        (F.lower(attribute("http-equiv")) == "refresh").alias("refresh"),
        attribute("href").alias("href"),
        F.regexp_extract(attribute("content"), r"(?is)url\s*=\s*['\"]?([^'\"\s]+)", 1)
        .alias("to"))
    target = once(found, "target", F.when(F.col("canonical"), F.col("href"))
                  .when(F.col("refresh"), F.col("to")), "own").where("target <> ''")
    t = F.col("target")
    full = once(target, "full", F.when(t.contains("://"), t)
                .when(t.startswith("//"), F.concat(F.lit("http:"), t))
                .when(t.startswith("/"), F.concat(F.lit("http://"), host_of(F.col("own")), t))
                .when(~t.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.\-]*:)"), F.concat(
                    F.lit("http://"), host_of(F.col("own")), _beside(F.col("own"), t))),
                "own").where("full is not null")
    ends = once(once(full, "a", address(F.col("own")), "full"), "b", address(F.col("full")), "a")
    return ends.where("a is not null and b is not null and a <> b").distinct()


def filter_urls(pages: DataFrame, rules: list[Rule], *, links: DataFrame | None = None,
                url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` (``allow`` or ``block``) to ``keep``.

    The longest rule that fits an address decides on it. Where none fits, the
    address goes with its component over ``links(a, b)``, addresses in the form
    of ``address`` (from ``page_links`` if not given): blocked if a rule blocks
    one of its members and none allows one; an explicit allow of any alias
    goes before. All else is allowed, as are null urls and urls without
    ``://`` (host and path are then empty). No row is dropped or doubled. A name
    that ``keep`` has already gets ``_1`` after it.

    Members of a component that appear only as a link's target count as well.
    Decisions are folded per component before they move, and only addresses
    with links take part.
    """
    keep = keep if keep is not None else list(pages.columns)
    links = written(links if links is not None else page_links(pages, url=url))
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"), address(F.col(url)).alias("__node"))
    member = written(components(links))
    as_url = F.concat(F.lit("x://"), F.col("node"))
    # A node has no final slash, so a rule for a folder is asked with one, too.
    asked = member.select("component", host_of(as_url).alias("host"),
                          F.explode(F.array(path_of(as_url), F.concat(path_of(as_url), F.lit("/"))))
                          .alias("path"))
    ruled = asked.select("component", judge(F.col("host"), F.col("path"), rules)["block"]
                         .alias("block"))
    blocked = (ruled.where("block is not null").groupBy("component")
               .agg(F.min("block").alias("blocked")))
    verdicts = member.join(blocked, "component").where("blocked").select(
        F.col("node").alias("__node"), F.lit(True).alias("__alias"))
    return (
        rows.join(verdicts, "__node", "left")
        .withColumn("__own", judge(F.col("host"), F.col("path"), rules))
        .select("__row.*", F.col("host").alias(own_name(keep, "host")),
                F.col("path").alias(own_name(keep, "path")),
                F.col("__own.rule").alias(own_name(keep, "rule")),
                F.when(F.coalesce("__own.block", "__alias", F.lit(False)), "block")
                .otherwise("allow").alias(own_name(keep, "verdict"))))
