"""Resolve not-modified revisits of WARC records to the response they stand for.

A revisit is joined as of its time to the latest earlier full response of the same
canonical URL. It resolves if no validator contradicts: an entity tag or, without tags on
both sides, a date of last change that both records carry must agree. The headers that a
not-modified answer may update replace those of the response; all others stay.

The as-of join is a carry over sorted rows: records are range-partitioned by (url, time,
id), so a URL with a third of all records is spread over many parts. Each part keeps the
last response of every URL; what a part begins with is carried from the parts before it.
Payloads are not moved; the result names the record that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

#: Header fields that a not-modified answer may carry for the stored response (HTTP semantics).
UPDATABLE = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. or m., path without a trailing slash or .html, query
    without tracking parameters, no scheme, user, default port or fragment."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^.*@|:(80|443)$", ""))
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(/|\.html)$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), query), r"&(utm_[a-z]+|ref|sessionid)=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve(records: DataFrame, updatable: list[str] = UPDATABLE) -> DataFrame:
    """One row per revisit with the response it resolves to.

    Takes record_id, url, fetched (time or whole number), kind ('response' or 'revisit'),
    status, headers (map of lower-case names). Returns record_id, url_key, fetched,
    response_id, response_fetched, outcome, headers.

    outcome: ``resolved``; ``changed`` if a validator contradicts; ``missing`` without an
    earlier full response (kind response, status 200). Only resolved rows have merged
    headers; others keep their own. Records of one time are ordered by record_id, and a
    response counts as earlier only if it comes before in that order. A null url, time or
    record_id resolves to nothing (``missing``). Null headers are empty. Repeated rows
    resolve each for itself. An empty table gives an empty result.
    """
    none = F.create_map().cast("map<string,string>")
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "fetched", "kind", "status", F.coalesce("headers", none).alias("headers"))
    known = F.col("url_key").isNotNull() & F.col("fetched").isNotNull() & F.col("record_id").isNotNull()
    full = known & (F.col("kind") == "response") & (F.col("status") == 200)
    rows = rows.withColumn("full", F.coalesce(full, F.lit(False))).where(F.col("full") | (F.col("kind") == "revisit"))
    order = ["url_key", "fetched", "record_id", "kind"]
    kept = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kept = materialize(kept, "records")
    stored = F.when(F.col("full"), F.struct(F.col("record_id").alias("id"), F.col("fetched").alias("at"), F.col("headers").alias("headers")))
    within = Window.partitionBy("part", "url_key").orderBy("fetched", "record_id", "kind").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("stored", F.last(stored, ignorenulls=True).over(within))
    ends = kept.where("full").groupBy("url_key", "part").agg(F.max_by(stored, F.struct("fetched", "record_id")).alias("own"))
    parts = kept.select("url_key", "part").distinct().join(ends, ["url_key", "part"], "left")
    over = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("carried", F.last("own", ignorenulls=True).over(over)).drop("own").where("carried is not null")
    carried = materialize(carried, "carried")
    found = kept.where("kind = 'revisit'").join(carried, ["url_key", "part"], "left")
    found = found.withColumn("match", F.when(known, F.coalesce("stored", "carried")))
    tag, old_tag = F.col("headers")["etag"], F.col("match.headers")["etag"]
    changed_at, old_changed = F.col("headers")["last-modified"], F.col("match.headers")["last-modified"]
    plain = lambda t: F.regexp_replace(t, r"^W/", "")  # noqa: E731  weak comparison
    agrees = F.when(tag.isNotNull() & old_tag.isNotNull(), plain(tag) == plain(old_tag)).when(
        changed_at.isNotNull() & old_changed.isNotNull(), changed_at == old_changed).otherwise(True)
    outcome = F.when(F.col("match").isNull(), "missing").when(agrees, "resolved").otherwise("changed")
    found = found.withColumn("outcome", outcome)
    fresh = F.map_filter("headers", lambda k, _: k.isin(updatable))
    merged = F.map_concat(F.map_filter("match.headers", lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    usable = F.col("outcome") != "missing"
    return found.select(
        "record_id", "url_key", "fetched", F.when(usable, F.col("match.id")).alias("response_id"), F.when(usable, F.col("match.at")).alias("response_fetched"),
        "outcome", F.when(F.col("outcome") == "resolved", merged).otherwise(F.col("headers")).alias("headers"))
