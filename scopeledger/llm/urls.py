"""Block and allow rules for urls, carried over redirects and canonical links.

Urls that redirect to each other or name the same canonical url form a group,
found as a connected component over all edges. A url that no rule fits takes its
group's decision: allow if a rule allows any member, else block if a rule blocks
any, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopeledger.llm.common import BROADCAST_ROWS, number_rows, stage
from scopeledger.llm.components import components

#: Query fields that only track a visit.
TRACKING = r"(?i)^(utm_[^=]*|gclid|fbclid|ref|source)(=.*)?$"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """The part behind the first ``://``, else empty."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def canonical(url: Column) -> Column:
    """The url a well-run site redirects to: https, lower-case host without default port, no fragment, no tracking fields, no final slash or index page."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?|/)$", "")
    query = F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    found = F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", found)


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a whole url, from the page's scheme, root or folder; null for other schemes and bare fragments."""
    parts = F.split(F.regexp_extract(target, r"^([^?#]*)", 1), "/")
    rest = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    root = F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    own = F.split(path_of(url), "/")
    folder = F.when(target.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))))

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part.isin(".", ""), done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(F.concat(folder, parts), F.array().cast("array<string>"), step)
    path = F.concat(F.array_join(F.transform(kept, lambda p: F.concat(F.lit("/"), p)), ""), F.when(target.rlike(r"/([?#]|$)"), "/").otherwise(""))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#|$)"), None)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"^(.*?:)//", 1), target))
        .when(target.startswith("?"), F.concat(root, path_of(url), rest)).otherwise(F.concat(root, path, rest))
    )


def declared(html: Column, url: Column) -> Column:
    """Urls that a page names as its own: canonical links, Open Graph urls and refresh targets, resolved against the page's url."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAG), F.lit(0))

    def target(tag: Column) -> Column:
        link = F.when(tag.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b"""), F.regexp_extract(tag, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
        graph = F.when(tag.rlike(r"""(?i)\bproperty\s*=\s*["']?og:url\b"""), F.regexp_extract(tag, r"""(?i)\bcontent\s*=\s*["']?([^"'\s>]+)""", 1))
        moved = F.when(tag.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract(tag, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
        return resolved(F.coalesce(link, graph, moved), url)

    return F.array_distinct(F.array_compact(F.transform(tags, target)))


def edges_of(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``a, b``: each url with the canonical form of itself and of every url that its page declares."""
    u = F.col(url)
    named = F.when(F.col(html).rlike(r"(?i)canonical|og:url|http-equiv"), declared(F.col(html), u)).otherwise(F.array().cast("array<string>"))
    own = pages.where(u.isNotNull()).select(canonical(u).alias("a"), F.explode(named).alias("b"))
    return own.select("a", canonical(F.col("b")).alias("b")).where("a <> b").distinct()


def fitting_rule(urls: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """``key, rule, verdict`` of the longest rule that fits, for urls that any fits.

    ``urls`` has ``key, host, path``; ``rules`` has ``host, path, verdict``. Each
    url is looked up by its host and parent domains and by the beginnings of its
    path that have the length of a rule's path, so the work per url does not grow
    with the number of rules. Of equal rules, allow wins.
    """
    rules = rules.where("host is not null and path is not null").groupBy(
        F.col("host").alias("_rule_host"), F.col("path").alias("_rule_path")
    ).agg(F.min("verdict").alias("verdict"))
    shapes = rules.select(F.length("_rule_path").alias("n")).distinct().agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    beginnings = F.transform(
        F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    tried = urls.where("host <> ''").select(key, "host", "path").crossJoin(F.broadcast(shapes))  # one row of path lengths
    tried = tried.select(key, F.explode(domains).alias("_domain"), beginnings.alias("_starts"))
    tried = tried.select(key, "_domain", F.explode("_starts").alias("_start"))
    if rules.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rules = F.broadcast(rules)
    hits = tried.join(rules, (F.col("_domain") == F.col("_rule_host")) & (F.col("_start") == F.col("_rule_path")))
    rule = F.concat("_rule_host", "_rule_path")
    longest = F.struct(F.length(rule).alias("n"), F.length("_rule_host").alias("h"), rule.alias("rule"), F.col("verdict").alias("verdict"))
    return hits.groupBy(key).agg(F.max(longest).alias("best")).select(key, "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for every row of ``pages``.

    ``edges`` (``a, b``, urls) adds known redirects to what the pages declare.
    A null url, or one without ``://``, has empty host and path, no rule and no
    aliases and is allowed; a null page declares nothing; repeated rows are
    judged alike; an empty table gives no row. ``component`` is the smallest
    canonical url of the group. ``pages`` must be a scan of files or staged, as
    its rows are numbered.
    """
    plain = number_rows(pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html")), "_row")
    links = edges_of(plain, "_url", "_html")
    if edges is not None:
        more = edges.select(canonical(F.col("a")).alias("a"), canonical(F.col("b")).alias("b")).where("a <> b")
        links = links.unionByName(more)
    u = F.col("_url")
    rows = stage(plain.select("_row", "_id", host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("_own")), "urls")
    fit = stage(fitting_rule(rows, "_row", rules).withColumnRenamed("_row", "_r"), "fits")
    judged = rows.join(fit, rows["_row"] == fit["_r"], "left").drop("_r")
    groups = components(links, "a", "b")
    # one row per canonical url: does a rule allow or block any of its urls
    per_url = judged.where("_own is not null").groupBy("_own").agg(
        F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"), F.max((F.col("verdict") == "block").cast("int")).alias("blocked")
    )
    # aliases that no page has are judged too, for a rule may fit them alone
    ends = groups.select(F.col("node").alias("_own"), host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    outer = fitting_rule(ends, "_own", rules).select(
        "_own", (F.col("verdict") == "allow").cast("int").alias("allowed"), (F.col("verdict") == "block").cast("int").alias("blocked")
    )
    named = per_url.unionByName(outer).join(groups, F.col("_own") == groups["node"], "left").select(
        "_own", F.coalesce("component", "_own").alias("component"), "allowed", "blocked"
    )
    decided = named.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    of_url = named.select("_own", "component").distinct().join(decided, "component").select(
        F.col("_own").alias("_k"), "component",
        F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").otherwise("allow").alias("group_verdict"),
    )
    done = judged.join(of_url, judged["_own"] == of_url["_k"], "left")
    return done.select(
        F.col("_id").alias(page_id), "host", "path", "rule", F.coalesce("verdict", "group_verdict", F.lit("allow")).alias("verdict"), "component"
    )
