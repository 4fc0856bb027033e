"""Not-modified revisit records resolved to the response they stand for.

A revisit belongs to the latest earlier full response of its canonical url (an
as-of join). Its validators are checked against that response, and of its
headers those that a 304 may update are merged into the stored ones.

The as-of join goes in two levels, so that a url with a third of all captures
is no single task: time is cut at quantiles of all captures, each url and
period keeps its last response, the last of earlier periods is carried over,
and inside a period a window finds the last one before each revisit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.llm.common import stage

#: Header fields that describe the body or the connection and that a 304 does not update (RFC 9110, 15.4.5; RFC 9111, 3.2).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Captures per period, on average.
PERIOD_ROWS = 20_000
MOST_PERIODS = 1_000


def canonical_uri(uri: Column) -> Column:
    """Scheme and host in lower case, without default port, fragment and empty path; without a scheme the uri as it is."""
    head = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.when(head != "", F.concat(head, F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest))).otherwise(uri)


def _etag(value: Column) -> Column:
    """Weak comparison: the tag without a leading ``W/``."""
    return F.regexp_replace(value, r"^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with the permitted ones of the revisit, sorted by name; names are in lower case."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(*NOT_MERGED))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_zip_with(stored, allowed, lambda _, old, new: F.coalesce(new, old)))))


def resolve_revisits(captures: DataFrame, period_rows: int = PERIOD_ROWS) -> DataFrame:
    """One row for every revisit of ``captures``: ``record_id, uri, response_id, outcome, payload_digest, headers``.

    ``captures`` has ``record_id, uri, ts, kind`` (``response`` or ``revisit``),
    ``status``, ``payload_digest`` and ``headers`` (a map, names in lower case,
    null: none). A full response has status 200. Earlier means a smaller
    ``(ts, record_id)``. ``outcome`` is

    - ``resolved``: entity tags are equal (weak comparison); without a tag on
      either side, last-modified dates are; without those too, nothing speaks
      against it. A payload digest on both sides must agree as well.
    - ``mismatch``: they differ; the response is named but nothing is merged.
    - ``no_response``: no full response came before, or the uri or time is null.

    Repeated records are resolved each; equal times go by record id; other kinds,
    null kinds and further columns are left out; an empty table gives no row.
    """
    rows = stage(
        captures.where("kind = 'revisit' or (kind = 'response' and status = 200)").select(
            "record_id", "uri", canonical_uri(F.col("uri")).alias("key"), F.col("ts").cast("timestamp").alias("ts"), "kind", "payload_digest",
            F.coalesce(F.col("headers").cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("headers"),
        ),
        "captures",
    )
    known = rows.where("key is not null and ts is not null")
    n = known.count()
    periods = min(MOST_PERIODS, max(1, -(-n // period_rows)))
    marks = [i / periods for i in range(1, periods)]
    cuts = known.agg(F.percentile_approx(F.unix_micros("ts"), marks, 10_000).alias("c")).first()["c"] if marks and n else []
    # at most MOST_PERIODS numbers
    edges = sorted(set(cuts))
    known = known.withColumn("period", _period(edges))
    response = F.struct("ts", "record_id", "payload_digest", F.map_entries("headers").alias("headers"))
    is_response = F.col("kind") == "response"
    known = known.withColumn("_response", F.when(is_response, response))
    last = known.groupBy("key", "period").agg(F.max("_response").alias("_last"))
    before = W.partitionBy("key").orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(
        F.col("key").alias("_k"), F.col("period").alias("_p"), F.last("_last", ignorenulls=True).over(before).alias("_carried")
    )
    earlier = W.partitionBy("key", "period").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    inside = known.withColumn("_inside", F.last("_response", ignorenulls=True).over(earlier)).where("kind = 'revisit'")
    found = inside.join(carried, (inside["key"] == carried["_k"]) & (inside["period"] == carried["_p"]))
    found = found.withColumn("r", F.coalesce("_inside", "_carried")).select("record_id", "uri", "payload_digest", "headers", "r")
    lost = rows.where("kind = 'revisit' and (key is null or ts is null)").select(
        "record_id", "uri", "payload_digest", "headers", F.lit(None).cast(found.schema["r"].dataType).alias("r")
    )
    both = found.unionByName(lost).withColumn("_stored", F.map_from_entries("r.headers"))
    theirs, ours = (lambda name: F.element_at("_stored", F.lit(name))), (lambda name: F.element_at("headers", F.lit(name)))
    tags = theirs("etag").isNotNull() & ours("etag").isNotNull()
    dates = theirs("last-modified").isNotNull() & ours("last-modified").isNotNull()
    same = F.when(tags, _etag(theirs("etag")) == _etag(ours("etag"))).when(dates, theirs("last-modified") == ours("last-modified")).otherwise(True)
    bodies = F.col("payload_digest").isNull() | F.col("r.payload_digest").isNull() | (F.col("payload_digest") == F.col("r.payload_digest"))
    outcome = F.when(F.col("r").isNull(), "no_response").when(same & bodies, "resolved").otherwise("mismatch")
    return both.withColumn("outcome", outcome).select(
        "record_id", "uri", F.col("r.record_id").alias("response_id"), "outcome",
        F.when(F.col("outcome") == "resolved", F.coalesce("r.payload_digest", "payload_digest")).alias("payload_digest"),
        F.when(F.col("outcome") == "resolved", merged_headers(F.col("_stored"), F.col("headers"))).alias("headers"),
    )


def _period(edges: list[int]) -> Column:
    """How many of the sorted edges are at or under the time."""
    if not edges:
        return F.lit(0)
    marks = F.array(*[F.lit(e) for e in edges])
    return F.size(F.filter(marks, lambda e: e <= F.unix_micros("ts")))
