"""URLs and media files: cleaning, checks, cache keys, choice of a stored file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings of unfinished downloads.
PARTIAL = (".part", ".ytdl", ".tmp", ".temp", ".aria2")


def clean(url: Column) -> Column:
    """A pasted URL without markdown link, angle brackets and escapes."""
    text = F.trim(url)
    link = F.regexp_extract(text, r"^(?i)\[[^\]]*\]\((https?://[^)]+)\)$", 1)
    text = F.when(link != "", link).otherwise(text)
    text = F.trim(F.regexp_replace(text, r"^<(.*)>$", "$1"))
    return F.regexp_replace(text, r"\\([_&?=#%])", "$1")


def is_public(url: Column) -> Column:
    """Whether a cleaned URL is http or https with a host."""
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#\s]+"), F.lit(False))


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def file_name(url: Column) -> Column:
    """Name of a direct download: 16 digits of the key and the path's ending, if it is a plain one of at most nine
    letters and digits and doesn't mark an unfinished file."""
    ending = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[^:]+://[^/]*/(?:.*/)?[^/]+(\.[\p{L}\p{N}]{1,9})$", 1))
    return F.concat(F.lit("direct-"), F.substring(cache_key(url), 1, 16), F.when((ending != "") & ~ending.isin(*PARTIAL), ending).otherwise(F.lit(".media")))


def identifiers(url: Column) -> Column:
    """What may be the provider's id in a URL, best first: the usual parameters, then the last part of the path."""
    path = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    found = F.array(*[F.try_parse_url(url, F.lit("QUERY"), F.lit(k)) for k in ("v", "id", "video_id")], F.get(path, F.size(path) - 1))
    return F.array_distinct(F.filter(found, lambda x: x.rlike("^[A-Za-z0-9_-]{3,128}$")))


def provider(url: Column) -> Column:
    """First label of the host, `www.` aside."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", ""), r"\.")[0]


def is_media_type(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return kind.startswith("video/") | kind.startswith("audio/") | kind.isin("", "application/octet-stream", "binary/octet-stream")


def is_complete(path: Column, length: Column) -> Column:
    """Whether a stored file is a finished download."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    unfinished = name.contains(".part-frag")
    for ending in PARTIAL:
        unfinished = unfinished | name.endswith(ending)
    return F.coalesce((length > 0) & ~unfinished, F.lit(False))


def within(path: Column, root: Column) -> Column:
    """Whether an indexed path stays inside its folder."""
    return path.startswith(F.concat(root, F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def stored_media(requests: DataFrame, index: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """requests (media_id, url) with `path` and `origin`: the URL index, then a direct file of the URL's name, then a file
    `<provider>-<id>.<ending>`; null where the medium must be fetched.

    Of the files with an id the newest of the URL's provider counts, or the only one of another; the first of the URL's ids
    that has one decides.
    """
    done = files.where(is_complete(F.col("path"), F.col("length"))).select("path", "length", "modified", F.element_at(F.split("path", "/"), -1).alias("name"))
    keyed = requests.withColumn("key", cache_key(F.col("url"))).withColumn("direct", file_name(F.col("url")))
    by_index = index.where(within(F.col("path"), F.lit(root))).join(done.select("path"), "path").select("key", F.col("path").alias("index_path"))
    by_name = done.groupBy(F.col("name").alias("direct")).agg(F.max_by("path", F.struct("modified", "path")).alias("direct_path"))
    part = F.split("name", "-")
    tails = F.transform(F.sequence(F.lit(2), F.size(part)), lambda k: F.array_join(F.slice(part, k, F.size(part)), "-"))
    named = done.where(F.size(part) > 1).select("*", F.explode(F.filter(tails, lambda t: t.contains("."))).alias("tail")).select("path", "modified", F.lower("name").alias("name"), F.substring_index("tail", ".", 1).alias("id"))
    asked = requests.select("media_id", "url", provider(F.col("url")).alias("provider"), F.posexplode(identifiers(F.col("url"))).alias("pos", "id"))
    hits = asked.join(named, "id").withColumn("own", F.col("name").startswith(F.concat("provider", F.lit("-"))))
    newest = F.struct("modified", "path")
    per_id = hits.groupBy("media_id", "pos").agg(F.max_by("path", F.when(F.col("own"), newest)).alias("own_path"), F.count(F.lit(1)).alias("n"), F.max("path").alias("any_path"))
    by_id = per_id.withColumn("id_path", F.coalesce("own_path", F.when(F.col("n") == 1, F.col("any_path")))).where("id_path IS NOT NULL").groupBy("media_id").agg(F.min_by("id_path", "pos").alias("id_path"))
    rows = keyed.join(by_index, "key", "left").join(by_name, "direct", "left").join(by_id, "media_id", "left")
    path = F.coalesce("index_path", "direct_path", "id_path")
    origin = F.when(F.col("index_path").isNotNull(), "index").when(F.col("direct_path").isNotNull(), "direct").when(F.col("id_path").isNotNull(), "provider")
    return rows.select("media_id", "url", path.alias("path"), origin.alias("origin"))
