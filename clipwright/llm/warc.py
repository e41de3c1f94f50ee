"""WARC captures: not-modified revisits resolved to the full response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.llm.common import cut, let

#: Headers of a stored response that a 304 doesn't replace: they speak of a body or of the one connection (fixed values).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that don't change what is served (fixed values).
TRACKING = "utm_[a-z_]*|ref|fbclid|gclid|sessionid"


def _decoded(x: Column) -> Column:
    """Percent-encoded letters, digits and -._~ as they are, other codes in capitals."""

    def one(p: Column, i: Column) -> Column:
        code = F.chr(F.conv(F.substring(p, 1, 2), 16, 10).cast("int"))
        rest = F.substr(p, F.lit(3))
        coded = F.when(code.rlike("^[A-Za-z0-9._~-]$"), F.concat(code, rest)).otherwise(F.concat(F.lit("%"), F.upper(F.substring(p, 1, 2)), rest))
        return F.when(i == 0, p).when(p.rlike("^[0-9A-Fa-f]{2}"), coded).otherwise(F.concat(F.lit("%"), p))

    return F.array_join(F.transform(F.split(x, "%"), one), "")


def _plain_path(path: Column) -> Column:
    """A path without empty segments, `.` and `..`, and without a closing slash."""

    def put(kept: Column, s: Column) -> Column:
        return F.when((s == "") | (s == "."), kept).when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, s))

    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), put)
    return let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("/"), F.array_join(k, "/"))).otherwise(""))


def canonical_url(url: Column) -> Column:
    """One form for a page's addresses.

    Without scheme, user, www. or m., default port, fragment, tracking parameters, closing or doubled
    slashes and dot segments; host in lower case, needless percent-encoding undone, parameters in order.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host, rest = F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), _decoded(F.regexp_replace(bare, "^[^/?]*", ""))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^(www|m)\\.", ""), ":(80|443)$", "")
    path = _plain_path(F.regexp_extract(rest, "^[^?]*", 0))
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _lower_headers(headers: Column) -> Column:
    """Names in lower case; those that differ in nothing else are one header, their values joined by a comma in the order of the names. Null values go."""
    none = F.create_map().cast("map<string,string>")
    entries = F.array_sort(F.filter(F.map_entries(F.coalesce(headers, none)), lambda e: e["value"].isNotNull()))

    def merged(es: Column) -> Column:
        names = F.array_distinct(F.transform(es, lambda e: F.lower(e["key"])))
        joined = lambda n: F.array_join(F.transform(F.filter(es, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), ", ")
        return F.map_from_arrays(names, F.transform(names, joined))

    return let(entries, merged)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


#: Ranges of instants, at most, for each of Spark's shuffle partitions.
RANGES_PER_PARTITION = 4


def resolve_revisits(records: DataFrame, rows_per_bucket: int = 5_000) -> DataFrame:
    """Each revisit in `records` with the latest full response of its page that was captured before it.

    `records` has record_id, url, kind (`response` or `revisit`; others count for nothing), captured_at
    (long, any unit), etag, last_modified, digest and headers (map of strings). Returns a row per
    revisit: record_id, canonical_url, outcome, response_id, response_at and headers. outcome is

    - `no-response` if no response is earlier (response_id, response_at and headers are null),
    - `mismatch` if the first validator that the revisit gives, of etag (compared weakly),
      last_modified and digest, isn't the response's (headers are null),
    - `unchecked` if it gives none,
    - `resolved` otherwise.

    For the last two, headers are the response's, with the revisit's in their place
    where a 304 may update them; names are in lower case, and names that differ in nothing else are one. A response at the very time of the revisit isn't earlier; of several at
    one time the largest record_id counts. Null urls or times resolve to nothing. Repeated
    revisits each get a row. An empty table gives no rows; other columns don't matter.

    Only ids, validators and headers are shuffled. Of all responses of a page at one instant only the last counts, and all
    revisits at one instant have the same answer, so instants are what is brought in order: in ranges of page and time,
    each of which hands its last response on to the page's later ones. A page with a third of all
    captures has many ranges, however close together they lie. A range has about `rows_per_bucket` rows, or
    more where that would make more than RANGES_PER_PARTITION ranges for each shuffle partition.
    """
    page = canonical_url(F.col("url"))
    columns = ["record_id", "kind", "captured_at", "etag", "last_modified", "digest", "headers"]
    rows = cut(records.where(F.col("kind").isin("response", "revisit")).select(page.alias("page"), *columns))
    asked = rows.where("kind = 'revisit'")
    full = F.struct("captured_at", "record_id", "etag", "last_modified", "digest", "headers")
    timed = "page is not null and captured_at is not null"
    responses = rows.where(f"kind = 'response' and {timed}").groupBy("page", "captured_at").agg(F.max_by(full, "record_id").alias("full"))
    moments = asked.where(timed).select("page", "captured_at").distinct()
    instants = responses.unionByName(moments.withColumn("full", F.lit(None).cast(responses.schema["full"].dataType)))
    most = RANGES_PER_PARTITION * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(-(-rows.count() // rows_per_bucket), most))
    placed = cut(instants.repartitionByRange(ranges, "page", "captured_at").withColumn("part", F.spark_partition_id()))

    at = F.when(F.col("full").isNotNull(), F.col("captured_at"))
    last = placed.groupBy("page", "part").agg(F.max_by("full", at).alias("last"))
    before = Window.partitionBy("page").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select("page", "part", F.last("last", ignorenulls=True).over(before).alias("handed"))
    # the range leaves out whatever has the row's own time
    within = Window.partitionBy("page", "part").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    answers = placed.withColumn("near", F.max_by("full", at).over(within)).where("full is null").join(handed, ["page", "part"])
    answers = answers.select(F.col("page").alias("_page"), F.col("captured_at").alias("_at"), F.coalesce("near", "handed").alias("full"))
    found = asked.join(answers, (F.col("page") == F.col("_page")) & (F.col("captured_at") == F.col("_at")), "left").drop("_page", "_at")

    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    same = (
        F.when(has("etag"), _weak(F.col("etag")).eqNullSafe(_weak(F.col("full.etag"))))
        .when(has("last_modified"), F.col("last_modified").eqNullSafe(F.col("full.last_modified")))
        .when(has("digest"), F.col("digest").eqNullSafe(F.col("full.digest")))
    )
    outcome = F.when(F.col("full").isNull(), "no-response").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    update = F.map_filter(_lower_headers(F.col("headers")), lambda k, v: ~k.isin(*NOT_MERGED))
    found = found.withColumn("outcome", outcome).withColumn("update", update)
    stored = F.map_filter(_lower_headers(F.col("full.headers")), lambda k, v: ~F.map_contains_key("update", k))
    merged = F.map_concat(stored, F.col("update"))
    return found.select(
        "record_id",
        F.col("page").alias("canonical_url"),
        "outcome",
        F.col("full.record_id").alias("response_id"),
        F.col("full.captured_at").alias("response_at"),
        F.when(F.col("outcome").isin("resolved", "unchecked"), merged).alias("headers"),
    )


def with_payload(resolved: DataFrame, responses: DataFrame) -> DataFrame:
    """Resolved revisits with the payload of their response (record_id, payload); others have none."""
    own = responses.select(F.col("record_id").alias("response_id"), "payload")
    good = resolved.where("outcome in ('resolved', 'unchecked')").join(own, "response_id", "left")
    rest = resolved.where("outcome not in ('resolved', 'unchecked')").withColumn("payload", F.lit(None).cast(own.schema["payload"].dataType))
    return good.select(*resolved.columns, "payload").unionByName(rest)


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of `pages` (page_id, url, html): a full response for each page, and three later requests for it.

    The response of page p has time 1000 * p. The requests come 3, 600 and 2,000,000 later, by other forms of
    the address: the first gives the right entity tag, the second, if p isn't a multiple of 4, a
    last-modified date only, otherwise a wrong tag, and the third the payload's digest. Pages whose id is a multiple of
    5 have no full response.
    """
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    modified = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    size = F.length(F.coalesce(F.col("html"), F.lit(""))).cast("string")
    text = lambda x: F.lit(x).cast("string")

    def record(suffix: int, kind: str, later: int, url: Column, etag: Column, last_modified: Column, own: Column, headers: dict[str, Column]) -> DataFrame:
        pairs = [x for k, v in headers.items() for x in (F.lit(k), v)]
        return pages.select(
            (F.col("page_id") * 4 + suffix).alias("record_id"), url.alias("url"), F.lit(kind).alias("kind"), (F.col("page_id") * 1000 + later).alias("captured_at"),
            etag.alias("etag"), last_modified.alias("last_modified"), own.alias("digest"), F.create_map(*pairs).alias("headers"),
        )

    tag = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    whole = {"Content-Type": F.lit("text/html"), "Content-Length": size, "ETag": tag, "Last-Modified": modified, "Cache-Control": F.lit("max-age=60")}
    full = record(0, "response", 0, F.col("url"), tag, modified, digest, whole).where((F.col("record_id") / 4) % 5 != 0)
    first = record(1, "revisit", 3, F.concat("url", F.lit("#again")), F.concat(F.lit("W/"), tag), text(None), text(None), {"ETag": F.concat(F.lit("W/"), tag), "Content-Length": F.lit("0"), "Cache-Control": F.lit("max-age=600")})
    wrong = F.col("page_id") % 4 == 0
    second = record(2, "revisit", 600, F.col("url"), F.when(wrong, F.lit('"other"')), F.when(~wrong, modified), text(None), {"date": F.lit("later"), "Connection": F.lit("close")})
    third = record(3, "revisit", 2_000_000, F.regexp_replace("url", "^https?://(www\\.)?", "HTTPS://"), text(None), text(None), digest, {"Age": F.lit("1")})
    return full.unionByName(first).unionByName(second).unionByName(third)
