"""WARC captures: not-modified revisits resolved by an as-of join on the canonical URL.

A revisit (status 304) takes the latest strictly earlier full response (status 200) of its canonical URL. If both
carry an entity tag, the tags must agree by weak comparison; else, if both carry Last-Modified, the dates must agree;
else there is nothing to check. A resolved revisit has the response's headers, updated with those that a 304 may
change.

The join is a scan in order: captures are ranged by (URL, time, record), so that even a URL with a third of all rows
spreads over many tasks; each part carries the last response forward, and what a part inherits from earlier parts of
the same URL is looked up in a table of one row per part and URL.

Header names are compared without case and given in lower case; of names that differ in case only, the value of the
last entry counts. `read_warc` reads WARC files, each record by its headers, in DataFrame functions; it gives payload
digests and lengths, not payloads.

Defined cases: captures without a URL or time resolve to nothing (verdict no_earlier_response); of responses at one
time the one with the largest record id counts; a response at the revisit's own time is not earlier; repeated rows
each give a row; null headers count as none, as do null names and values; statuses other than 200 and 304 are not
read; pages of any length are hashed whole, never gathered; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkloom.sharedfs import materialize

#: Header fields that a not-modified answer may bring up to date, in lower case.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "via", "warning")
#: Query parameters that do not choose the content.
TRACKING = ("fbclid", "gclid", "jsessionid", "phpsessid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")


def canonical_url(url: Column) -> Column:
    """host/path?query: no scheme, user, www prefix, default port, fragment, closing slash or tracking parameter;
    host in lower case; parameters sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"^www\d*\.", ""), r":(?:80|443)$|\.$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """The headers by lower-case name, the last of each."""
    entries = F.filter(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    named = F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda x: x["key"] == e["key"])))


def _fields(lines: Column) -> Column:
    """"Name: value" lines as a map of lower-case names; folded lines are not joined."""
    pairs = F.transform(F.filter(F.split(lines, "\r?\n"), lambda x: F.instr(x, ":") > 1), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda x: x["key"] == e["key"])))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of WARC files (also compressed by gzip, record by record): (record_id, url, time, status, headers,
    payload_sha256, payload_chars), as resolve_revisits takes them; time in seconds, payload_chars in bytes.

    The text source divides files at the version line, so uncompressed files are read in parallel and a record of any
    length is one row. Responses are full if their HTTP status is 200; revisit records are 304. A record whose block is
    shorter than its Content-Length (the version line inside a payload cuts it) is left out."""
    raw = spark.read.option("lineSep", "WARC/1.0\r\n").text(path).filter(F.col("value") != "")
    data = F.col("value").cast("binary")
    head = F.substring_index("value", "\r\n\r\n", 1)
    r = raw.select(_fields(head).alias("w"), data.alias("data"), F.octet_length(head).alias("at"))
    r = r.withColumn("size", F.element_at("w", "content-length").try_cast("long"))
    r = r.withColumn("block", F.substr("data", F.col("at") + 5, F.col("size").cast("int"))).filter("size is not null and length(block) = size")
    http = F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)
    r = r.select("w", "block", http.alias("http"), F.lower(F.element_at("w", "warc-type")).alias("type"))
    code = F.regexp_extract("http", r"^HTTP/\S+ +(\d{3})", 1).try_cast("int")
    status = F.when(F.col("type") == "revisit", 304).when(F.col("type") == "response", code)
    payload = F.substr("block", F.octet_length("http") + 5, F.greatest(F.lit(0), F.length("block") - F.octet_length("http") - 4))
    full = F.col("type") == "response"
    r = r.filter(F.col("type").isin("response", "revisit")).select(
        F.xxhash64(F.element_at("w", "warc-record-id")).alias("record_id"), F.regexp_replace(F.element_at("w", "warc-target-uri"), "^<|>$", "").alias("url"),
        F.unix_timestamp(F.try_to_timestamp(F.element_at("w", "warc-date"))).alias("time"), status.alias("status"), _fields(F.substr("http", F.instr("http", "\n") + 1)).alias("headers"),
        F.when(full, F.sha2(payload, 256)).alias("payload_sha256"), F.when(full, F.length(payload)).cast("long").alias("payload_chars"),
    )
    return r.filter("status is not null")


def _tag(etag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(etag), "^[Ww]/", ""), '^"|"$', "")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl of the pages table: each page is fetched in full at 10 * page_id, and asked for again 7 s later, or
    1,000 or 2,000 s after that (every thirteenth 5 s before it was fetched). Every fifth revisit has a weak tag,
    every seventh a date only, every eleventh a tag of other content. Pages of even id have header names in capitals. Times are seconds; record ids are 2 * page_id and 2 * page_id + 1."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    date = F.concat(F.lit("day "), F.floor(F.col("page_id") / 100).cast("string"))
    p = F.col("page_id")
    even = p % 2 == 0
    named = lambda *pairs: F.create_map(*[x for name, value in pairs for x in (F.when(even, name).otherwise(name.lower()), value)])
    html = F.coalesce("html", F.lit(""))
    size = F.length(html).cast("string")
    full = pages.select(
        (p * 2).alias("record_id"), "url", (p * 10).alias("time"), F.lit(200).alias("status"),
        named(("Content-Type", F.lit("text/html")), ("ETag", F.concat(F.lit('"'), tag, F.lit('"'))), ("Last-Modified", date), ("Date", (p * 10).cast("string")), ("Content-Length", size)).alias("headers"),
        F.sha2(html, 256).alias("payload_sha256"), F.length(html).cast("long").alias("payload_chars"),
    )
    at = F.when(p % 13 == 0, p * 10 - 5).otherwise(p * 10 + 7 + (p % 3) * 1000)
    sent = F.when(p % 11 == 0, F.lit('"other"')).when(p % 5 == 0, F.concat(F.lit('W/"'), tag, F.lit('"'))).otherwise(F.concat(F.lit('"'), tag, F.lit('"')))
    base = named(("Date", at.cast("string")), ("CACHE-CONTROL", F.lit("max-age=60")), ("Content-Length", F.lit("0")))
    more = F.when(p % 7 == 0, named(("LAST-MODIFIED", date))).otherwise(named(("ETAG", sent)))
    none = F.lit(None)
    again = pages.select((p * 2 + 1).alias("record_id"), "url", at.alias("time"), F.lit(304).alias("status"), F.map_concat(base, more).alias("headers"), none.cast("string").alias("payload_sha256"), none.cast("long").alias("payload_chars"))
    return full.unionByName(again)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """captures(record_id, url, time, status, headers, payload_sha256, payload_chars) -> one row per revisit:
    (record_id, url, canonical_url, time, verdict, response_id, response_time, headers, payload_sha256, payload_chars)."""
    c = captures.filter(F.col("status").isin(200, 304)).withColumns({"key": canonical_url(F.col("url")), "headers": lower_names(F.col("headers"))})
    c = c.withColumn("kind", F.when(F.col("status") == 304, 0).otherwise(1))  # at one time, revisits come first
    response = F.struct(F.col("record_id").alias("id"), "time", "headers", "payload_sha256", "payload_chars")
    c = c.withColumn("response", F.when((F.col("kind") == 1) & F.col("key").isNotNull() & F.col("time").isNotNull(), response))
    c = c.select("key", "time", "kind", "record_id", "url", "headers", "response")
    c = c.repartitionByRange("key", "time", "kind", "record_id").withColumn("part", F.spark_partition_id())
    c = materialize(c, "warc-ranged")
    run = Window.partitionBy("part", "key").orderBy("time", "kind", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = c.withColumn("own", F.last("response", ignorenulls=True).over(run)).filter("kind = 0").drop("response", "kind")
    ends = c.groupBy("part", "key").agg(F.max(F.when(F.col("response").isNotNull(), F.struct(F.col("response.time").alias("time"), F.col("response.id").alias("id")))).alias("last"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("from", F.max("last").over(before)).filter(F.col("key").isNotNull() & F.col("from").isNotNull())
    # The inherited response itself, by its part-independent name (URL, time, record).
    full = c.filter(F.col("response").isNotNull()).select(F.col("key").alias("f_key"), F.col("response.time").alias("f_time"), F.col("response.id").alias("f_id"), F.col("response").alias("inherited")).dropDuplicates(["f_key", "f_time", "f_id"])
    ends = ends.join(full, (F.col("key") == F.col("f_key")) & (F.col("from.time") == F.col("f_time")) & F.col("from.id").eqNullSafe(F.col("f_id"))).select("part", F.col("key").alias("e_key"), "inherited")
    r = seen.join(ends.withColumnRenamed("part", "e_part"), (F.col("part") == F.col("e_part")) & (F.col("key") == F.col("e_key")), "left")
    r = r.withColumn("got", F.when(F.col("key").isNotNull() & F.col("time").isNotNull(), F.coalesce("own", "inherited")))
    mine, theirs = F.col("headers"), F.coalesce("got.headers", F.create_map().cast("map<string,string>"))
    tag_a, tag_b = _tag(F.element_at(mine, "etag")), _tag(F.element_at(theirs, "etag"))
    date_a, date_b = F.element_at(mine, "last-modified"), F.element_at(theirs, "last-modified")
    agree = F.when(tag_a.isNotNull() & tag_b.isNotNull(), tag_a == tag_b).when(date_a.isNotNull() & date_b.isNotNull(), date_a == date_b).otherwise(True)
    ok = F.col("got").isNotNull() & agree
    fresh = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    stale = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(fresh, k))
    verdict = F.when(F.col("got").isNull(), "no_earlier_response").when(agree, "resolved").otherwise("validators_differ")
    return r.select(
        "record_id", "url", F.col("key").alias("canonical_url"), "time", verdict.alias("verdict"),
        F.when(ok, F.col("got.id")).alias("response_id"), F.when(ok, F.col("got.time")).alias("response_time"),
        F.when(ok, F.map_concat(stale, fresh)).alias("headers"), F.when(ok, F.col("got.payload_sha256")).alias("payload_sha256"), F.when(ok, F.col("got.payload_chars")).alias("payload_chars"),
    )
