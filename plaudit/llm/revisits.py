"""WARC: not-modified revisits resolved to the latest earlier full response of the same canonical URL.

The as-of join is a forward fill. Captures are dealt by ranges of (URL, time, record), so a URL that holds a
third of all captures spreads over many partitions; each partition is filled by a window per URL,
and the last response of the partitions before is carried in from a summary of one row per partition and URL.
Only what a resolved record needs of a response moves: validators, headers and digest; ``with_payload``
fetches contents afterwards.

A revisit is ``resolved`` if the validators agree: entity tags by weak comparison where both have one, else equal
modification dates. It is ``mismatch`` if they differ, ``no_validator`` if there is none to compare, and ``no_response`` without an
earlier full response. Resolved records get the headers of the response, replaced and extended by those of the
revisit that may update a stored response.

Cases: "earlier" is by time, then record id; a record with a null time or URL resolves nothing and is ``no_response``; null
headers count as none; repeated rows are resolved each; an empty table gives no rows; header names are compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plaudit.llm.common import written

# What a 304 response never changes in a stored one (hop-by-hop fields and fields that describe the stored content).
UNCHANGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
             "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without trailing slash, sorted query without tracking; no scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "^[^?]*[?](.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&", -1), lambda part: (part != "") & ~part.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """The map with names in lower case; of names that then agree the last in order of name counts."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda entry: F.struct(F.lower(entry["key"]).alias("key"), entry["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda entry: entry["key"]))
    return F.map_from_entries(F.transform(names, lambda name: F.element_at(F.filter(entries, lambda entry: entry["key"] == name), -1)))


def merged_headers(stored: Column, update: Column) -> Column:
    allowed = F.map_filter(update, lambda name, value: ~name.isin(*UNCHANGED))
    return F.map_concat(F.map_filter(stored, lambda name, value: ~F.map_contains_key(allowed, name)), allowed)


def resolved(spark: SparkSession, captures: DataFrame) -> DataFrame:
    """One row per revisit of ``captures (record_id, url, ts, kind, etag, last_modified, headers, digest)``.

    ``record_id, canonical_url, ts, response_id, verdict, headers, digest``; ``kind`` is ``response`` or ``revisit``.
    """
    none = F.create_map().cast("map<string,string>")
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("key"), "ts", "kind", "etag", "last_modified",
                           lower_names(F.coalesce("headers", none)).alias("headers"), "digest")
    ranged = written(spark, rows.repartitionByRange("key", "ts", "record_id").withColumn("part", F.spark_partition_id()), "captures")
    full = F.when((F.col("kind") == "response") & F.col("ts").isNotNull(),
                  F.struct("record_id", "etag", "last_modified", "headers", "digest"))
    whole = ranged.withColumn("full", full)
    summary = whole.groupBy("part", "key").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("ts", "record_id"))).alias("last"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select("part", "key", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("part", "key").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    filled = whole.withColumn("near", F.last("full", ignorenulls=True).over(within)).where("kind = 'revisit'")
    joined = filled.join(carried.where("carried is not null"), ["part", "key"], "left")
    found = F.when(F.col("ts").isNotNull(), F.coalesce("near", "carried"))
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    by_tag, by_date = weak(F.col("etag")) == weak(F.col("found.etag")), F.col("last_modified") == F.col("found.last_modified")
    verdict = (F.when(F.col("found").isNull(), "no_response")
               .when(F.coalesce(by_tag, by_date).isNull(), "no_validator").when(F.coalesce(by_tag, by_date), "resolved").otherwise("mismatch"))
    good = F.col("verdict") == "resolved"
    return joined.withColumn("found", found).withColumn("verdict", verdict).select(
        "record_id", F.col("key").alias("canonical_url"), "ts", F.col("found.record_id").alias("response_id"), "verdict",
        F.when(good, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"), F.when(good, F.col("found.digest")).alias("digest"))


def with_payload(found: DataFrame, responses: DataFrame) -> DataFrame:
    """Resolved records with the content of their response, from ``responses (record_id, payload)``."""
    contents = responses.select(F.col("record_id").alias("response_id"), "payload")
    return found.where("verdict = 'resolved'").join(contents, "response_id")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Each page as a full response of its section's front page, and two revisits by other forms of that URL."""
    rows = pages.select("page_id", "url", "html", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return rows.selectExpr(
        "page_id * 3 + k as record_id",
        """concat(if(k = 0, 'http://', 'https://WWW.'), regexp_replace(regexp_replace(url, '^https?://(www[.])?', ''), '/[0-9]+.*$', ''),
            case k when 0 then '' when 1 then '/?utm_source=x' else '#top' end) as url""",
        "if(k = 0, page_id * 7919 % 1000003, (page_id * 104729 * k + 17) % 1000003) as ts",
        "if(k = 0, 'response', 'revisit') as kind",
        "if(page_id % 3 = 0, null, concat(if(k = 0, 'W/', ''), '\\\"', substring(md5(html), 1, 12), '\\\"')) as etag",
        "concat('day ', string(page_id % 11)) as last_modified",
        """if(k = 0, map('Content-Type', 'text/html', 'Content-Length', string(octet_length(html)), 'Cache-Control', 'max-age=600'),
            map('Content-Length', '0', 'connection', 'close', 'cache-control', concat('max-age=', string(page_id % 7)), 'Expires', string(k))) as headers""",
        "sha2(html, 256) as digest")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolved(spark, captures_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda entry: F.concat(entry["key"], F.lit(": "), entry["value"])), "\n")
    return found.withColumn("headers", lines)
