"""Not-modified revisits of WARC captures, resolved to the response they refer to.

Records: record_id long, url string, ts long, kind ``response`` or ``revisit``,
etag, last_modified, headers map<string,string>, digest, length. Each revisit
gets the latest earlier full response of its canonical URL (an as-of join):
ts first, then record_id; a response at the same ts counts as earlier. Its
validators must agree: the entity tags (compared weakly) where both have one,
else the modification dates. If they do, the response's headers are updated by
those of the 304, except the ones that describe the stored body.

A hot URL is cut by time: the last response of each (URL, time bucket) is
carried over the buckets, at most ``buckets`` a URL, and then looked up inside
the bucket, so no task holds a URL.

Defined results: a null URL is its own key and matches only null URLs; a null
ts sorts first; without an earlier response the status is ``no_antecedent``;
unequal or missing validators give ``mismatch`` and no headers; repeated rows
are records of their own; extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that describe the stored body; a 304 doesn't replace them.
BODY_HEADERS = ["content-encoding", "content-length", "content-range", "content-type", "transfer-encoding"]
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref)="


def canonical_url(url: Column) -> Column:
    """Host lower-cased, without scheme, default port, fragment, tracking parameters or a last slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^(?i)https?://", "")
    path, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, "\\?(.*)$", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(path, "^[^/]*", 0)), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(path, "/.*$", 0), "/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, rest, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame, buckets: int = 4096) -> DataFrame:
    """One row a revisit: record_id, canonical, ts, refers_to, status, headers, digest, length."""
    r = records.select(
        "record_id", F.coalesce(canonical_url(F.col("url")), F.lit("")).alias("canonical"), F.col("url").isNull().alias("no_url"),
        F.coalesce("ts", F.lit(-(1 << 62))).alias("ts"), "kind", "etag", "last_modified", "headers", "digest", "length",
    )
    span = r.where(F.col("ts") > -(1 << 62)).agg(F.min("ts"), F.max("ts")).first()
    first, width = span[0] or 0, max(1, ((span[1] or 0) - (span[0] or 0)) // buckets + 1)
    r = r.withColumn("bucket", F.when(F.col("ts") < first, F.lit(-1)).otherwise(F.floor((F.col("ts") - first) / width)))
    full = F.when(
        F.col("kind") == "response",
        F.struct("ts", "record_id", "etag", "last_modified", F.map_entries("headers").alias("headers"), "digest", "length"),
    )
    key = ["canonical", "no_url"]
    # Responses stand before the revisits of their ts.
    order = [F.col("ts"), F.when(F.col("kind") == "response", 0).otherwise(1), F.col("record_id")]
    inside = Window.partitionBy(*key, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = r.where(F.col("kind") == "response").groupBy(*key, "bucket").agg(F.max_by(full, F.struct("ts", "record_id")).alias("last"))
    marks = r.groupBy(*key, "bucket").agg(F.lit(1).alias("one"))
    ahead = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.join(last, [*key, "bucket"], "left").select(*key, "bucket", F.last("last", ignorenulls=True).over(ahead).alias("carried"))
    seen = r.withColumn("seen", F.last(full, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    found = seen.join(carried, [*key, "bucket"]).withColumn("of", F.coalesce("seen", "carried"))

    weak = lambda c: F.regexp_replace(c, "^W/", "")
    tags = weak(F.col("etag")) == weak(F.col("of.etag"))
    agree = F.coalesce(tags, F.col("last_modified") == F.col("of.last_modified"), F.lit(False))
    status = F.when(F.col("of").isNull(), "no_antecedent").when(agree, "resolved").otherwise("mismatch")
    lowered = lambda entries: F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    newer = F.filter(
        lowered(F.coalesce(F.map_entries("headers"), F.array().cast("array<struct<key:string,value:string>>"))),
        lambda e: ~e["key"].isin(BODY_HEADERS),
    )
    older = lowered(F.coalesce("of.headers", F.array().cast("array<struct<key:string,value:string>>")))
    kept = F.filter(older, lambda e: ~F.array_contains(F.transform(newer, lambda n: n["key"]), e["key"]))
    merged = F.array_sort(F.concat(kept, newer))
    ok = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "record_id", F.when(~F.col("no_url"), F.col("canonical")).alias("canonical"),
        F.when(F.col("ts") > -(1 << 62), F.col("ts")).alias("ts"), F.col("of.record_id").alias("refers_to"), "status",
        F.when(ok, F.array_join(F.transform(merged, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")).alias("headers"),
        F.when(ok, F.col("of.digest")).alias("digest"), F.when(ok, F.col("of.length")).alias("length"),
    )


def attach_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Resolved revisits with the body that they refer to; ``payloads`` has record_id and payload."""
    bodies = payloads.select(F.col("record_id").alias("refers_to"), "payload")
    return resolved.where("status = 'resolved'").join(bodies, "refers_to")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures of a pages table, as no WARC headers come with it.

    Every page is a full response at ts 2 * page_id, and its URL is asked again
    (with another fragment) at the ts after; every eleventh page is asked before
    instead. The second answer is a 304 with the page's tag; every seventh has
    an outdated one, and every fifth has a date alone.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    date = F.concat(F.lit("day "), (p % 365).cast("string"))
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    head = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    response = F.struct(
        (2 * p).alias("record_id"), F.col("url").alias("url"), (2 * p).alias("ts"), F.lit("response").alias("kind"),
        tag.alias("etag"), date.alias("last_modified"),
        head("Content-Type", "text/html", "Content-Length", length.cast("string"), "ETag", tag, "Cache-Control", "max-age=60").alias("headers"),
        F.md5(F.coalesce("html", F.lit(""))).alias("digest"), length.alias("length"),
    )
    sent = F.when(p % 5 == 0, F.lit(None).cast("string")).when(p % 7 == 0, F.lit('"outdated"')).otherwise(F.concat(F.lit("W/"), tag))
    revisit = F.struct(
        (2 * p + 1).alias("record_id"), F.concat(F.col("url"), F.lit("#again")).alias("url"),
        F.when(p % 11 == 0, 2 * p - 1).otherwise(2 * p + 1).alias("ts"), F.lit("revisit").alias("kind"),
        sent.alias("etag"), date.alias("last_modified"),
        head("Date", F.concat(F.lit("at "), p.cast("string")), "Cache-Control", "max-age=90", "Content-Length", "0").alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("length"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")
