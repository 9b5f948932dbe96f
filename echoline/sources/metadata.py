"""Provider and container metadata: JSON columns to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT = "struct<url:string,vcodec:string,acodec:string,height:double,tbr:double,abr:double,http_headers:map<string,string>>"
METADATA = f"struct<id:string,language:string,original_language:string,url:string,vcodec:string,acodec:string,height:double,tbr:double,abr:double,http_headers:map<string,string>,requested_formats:array<{FORMAT}>,formats:array<{FORMAT}>,subtitles:map<string,string>,automatic_captions:map<string,string>>"
VARIANT = "array<struct<ext:string,url:string,name:string,protocol:string,impersonate:string,http_headers:map<string,string>>>"
STREAM = "struct<index:int,codec_type:string,codec_name:string,width:string,height:string,avg_frame_rate:string,r_frame_rate:string,time_base:string,start_time:string,tags:struct<language:string,title:string>>"
PROBE = f"struct<format:struct<duration:string>,streams:array<{STREAM}>>"


def number(text: Column) -> Column:
    return text.try_cast("double")


def rational(text: Column) -> Column:
    """The value of "a/b" (or "a"); null for a zero denominator and anything else."""
    part = F.split(text, "/")
    return F.when(F.size(part) == 1, number(part[0])).when(F.size(part) == 2, F.try_divide(number(F.get(part, F.lit(0))), number(F.get(part, F.lit(1)))))


def parsed(df: DataFrame, json_col: str, out: str = "meta") -> DataFrame:
    """df with the provider's metadata; what isn't of the expected shape is null."""
    return df.withColumn(out, F.from_json(F.col(json_col), METADATA))


def _own(meta: Column) -> Column:
    return F.struct(*[meta[c].alias(c) for c in ("url", "vcodec", "acodec", "height", "tbr", "abr", "http_headers")])


def _list(x: Column) -> Column:
    return F.filter(F.coalesce(x, F.array().cast(f"array<{FORMAT}>")), lambda f: f.isNotNull())


def _present(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def video_source(meta: Column) -> Column:
    """struct(url, headers): what the provider chose, else the medium itself, else the format nearest to 720 lines from
    below, higher bit rates first."""
    tall = lambda f: F.when(F.coalesce(f["height"], F.lit(0.0)) == 0, None).otherwise(f["height"])
    listed = F.filter(_list(meta["formats"]), lambda f: (F.coalesce(f["vcodec"], F.lit("none")) != "none") & f["url"].isNotNull())
    keyed = F.transform(listed, lambda f, k: F.struct((F.coalesce(tall(f), F.lit(10000.0)) > 720).alias("over"), F.abs(F.coalesce(tall(f), F.lit(720.0)) - 720).alias("gap"), (-F.coalesce(f["tbr"], F.lit(0.0))).alias("rate"), k.alias("k")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.get(listed, s["k"]))
    all_of = F.concat(_list(meta["requested_formats"]), F.array(_own(meta)), ordered)
    good = F.filter(all_of, lambda f: (F.coalesce(f["vcodec"], F.lit("")) != "none") & _present(f["url"]))
    first = F.get(good, F.lit(0))
    headers = F.coalesce(F.when(F.size(first["http_headers"]) > 0, first["http_headers"]), meta["http_headers"], F.create_map().cast("map<string,string>"))
    return F.when(first.isNotNull(), F.struct(first["url"].alias("url"), F.map_filter(headers, lambda _, v: v.isNotNull()).alias("headers")))


def audio_source(meta: Column) -> Column:
    """The audio format to fetch: one without video if there is any, the highest bit rate, the first of equals."""
    heard = lambda f: (F.coalesce(f["acodec"], F.lit("none")) != "none") & _present(f["url"])
    all_of = F.filter(F.concat(_list(meta["requested_formats"]), _list(meta["formats"]), F.array(_own(meta))), heard)
    rate = lambda f: F.coalesce(F.nullif(f["abr"], F.lit(0.0)), F.nullif(f["tbr"], F.lit(0.0)), F.lit(0.0))
    keyed = F.transform(all_of, lambda f, k: F.struct((F.coalesce(f["vcodec"], F.lit("")) == "none").alias("alone"), rate(f).alias("rate"), (-k).alias("k")))
    return F.get(all_of, -F.array_max(keyed)["k"])


def caption_tracks(df: DataFrame, meta: str = "meta") -> DataFrame:
    """(media_id, source, track_pos, language, name, extension, url, protocol, impersonate, http_headers): a row for each
    variant of each language; what isn't a map of lists is passed over."""
    out = None
    for source, field in (("manual", "subtitles"), ("automatic", "automatic_captions")):
        rows = df.select("media_id", F.posexplode(F.map_entries(F.col(meta)[field])).alias("lang_pos", "entry"))
        rows = rows.select("media_id", "lang_pos", F.col("entry.key").alias("language"), F.posexplode(F.when(F.ltrim("entry.value").startswith("["), F.from_json(F.col("entry.value"), VARIANT))).alias("pos", "v")).where("v IS NOT NULL")
        rows = rows.select("media_id", F.lit(source).alias("source"), (F.col("lang_pos") * 10000 + F.col("pos")).alias("track_pos"), "language", F.col("v.name").alias("name"), F.col("v.ext").alias("extension"), "v.url", "v.protocol", "v.impersonate", "v.http_headers")
        out = rows if out is None else out.unionByName(rows)
    return out


def media_info(df: DataFrame, probe_col: str) -> DataFrame:
    """The media table from ffprobe's JSON: first video stream, first audio stream, all subtitle streams."""
    rows = df.select("media_id", F.from_json(F.col(probe_col), PROBE).alias("p"))
    kind = lambda k: F.filter(F.coalesce("p.streams", F.array().cast(f"array<{STREAM}>")), lambda s: s["codec_type"] == k)
    rows = rows.select("media_id", "p", F.get(kind("video"), F.lit(0)).alias("v"), F.get(kind("audio"), F.lit(0)).alias("a"), kind("subtitle").alias("s"))
    titles = F.transform("s", lambda s: F.struct(s["index"].alias("index"), s["codec_name"].alias("codec"), s["tags"]["language"].alias("language"), s["tags"]["title"].alias("title")))
    return rows.select(
        "media_id", number(F.col("p.format.duration")).alias("duration"), F.col("v").isNotNull().alias("has_video"), F.col("a").isNotNull().alias("has_audio"), titles.alias("embedded_subtitles"),
        F.col("v.width").try_cast("int").alias("width"), F.col("v.height").try_cast("int").alias("height"), F.col("v.codec_name").alias("video_codec"), F.col("a.codec_name").alias("audio_codec"),
        F.col("v.avg_frame_rate").alias("avg_frame_rate"), F.col("v.r_frame_rate").alias("real_frame_rate"), F.col("v.time_base").alias("video_time_base"),
        number(F.col("v.start_time")).alias("video_start_time"), number(F.col("a.start_time")).alias("audio_start_time"),
    )
