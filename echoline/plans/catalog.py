"""The named queries: each applies operators to whole tables. Where SQL can say the same, ORACLE has it for DuckDB.

Stand-ins: words are the words of ``documents`` at 0.4 s each, cues the turns of ``conversations`` at 4 s each, targets the
passages of ``benchmark``, frames and timed events the rows of ``events``, URLs those of ``pages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoline.config import SearchConfig
from echoline.functions import rules, text
from echoline.functions.similarity import indel_ratio, partial_indel_ratio
from echoline.operators import cache, captions, frames, intervals, occurrences, phrases, verify
from echoline.plans import search
from echoline.sources import metadata, subtitles, urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SQL_NORM = r"array_to_string(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+'), ' ')"
SQL_FIRST_WORDS = SQL_NORM.format(r"array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 12), ' ')")
TURNS = 1 << 32  # more than any conversation has
SQL_SECONDS = "((epoch_us(ts) - 1704067200000000) / 1000000.0)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(df: DataFrame) -> Column:
    """Seconds of events.ts since the start of 2024, whatever the session's time zone."""
    zone = "TIMESTAMP_NTZ'2024-01-01 00:00:00'" if dict(df.dtypes)["ts"] == "timestamp_ntz" else "TIMESTAMP'2024-01-01 00:00:00Z'"
    return F.expr(f"timestampdiff(MICROSECOND, {zone}, ts) / 1000000.0D")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("at", seconds(rows))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def normalized(df: DataFrame, id_col: str, name: str) -> DataFrame:
    return text.with_normalized(df.select(F.col(id_col).alias(name), "text"), "text", "normalized").drop("text")


def cue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("media_id"), F.lit("manual").alias("source"), F.lit("en").alias("language"), F.col("turn").cast("int").alias("cue_idx"), "text", (F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4.0 + 4.0).alias("end"))


@query(f"SELECT 'document' AS kind, doc_id AS id, {SQL_NORM.format('text')} AS normalized FROM documents UNION ALL SELECT 'benchmark', item_id, {SQL_NORM.format('text')} FROM benchmark")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = normalized(table(spark, sf_dir, "documents"), "doc_id", "id").select(F.lit("document").alias("kind"), "id", "normalized")
    return docs.unionByName(normalized(table(spark, sf_dir, "benchmark"), "item_id", "id").select(F.lit("benchmark").alias("kind"), "id", "normalized"))


@query(rf"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+') AS w FROM conversations)
SELECT conv_id, turn, CAST(k - 1 AS INTEGER) AS tok_idx, w[k] AS token FROM (SELECT conv_id, turn, w, unnest(generate_series(1, len(w))) AS k FROM t WHERE len(w) > 0)""")
def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.with_normalized(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "normalized")
    return phrases.token_positions(rows, "normalized", "conv_id", "turn")


@query(f"""
WITH d AS (SELECT doc_id, ' ' || {SQL_NORM.format('text')} || ' ' AS n FROM documents),
     b AS (SELECT item_id, ' ' || {SQL_NORM.format('text')} || ' ' AS q FROM benchmark),
     h AS (SELECT item_id AS query_id, doc_id AS media_id, n, q, strpos(n, q) AS place FROM b JOIN d ON contains(n, q) WHERE length(q) > 2)
SELECT query_id, media_id, CAST(len(string_split(substr(n, 1, place), ' ')) - 2 AS INTEGER) AS tok_idx,
       round(CAST((len(string_split(substr(n, 1, place), ' ')) - 2) * 0.4 AS DOUBLE), 3) AS start
FROM h""")
def phrase_exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first token-aligned exact place of every benchmark passage in every document."""
    media = normalized(table(spark, sf_dir, "documents"), "doc_id", "media_id")
    return phrases.first_phrase(media, normalized(table(spark, sf_dir, "benchmark"), "item_id", "query_id")).drop("n_found")


@query(rf"""
WITH t AS (SELECT item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
     l AS (SELECT item_id, w, len(w) AS n, greatest(1, least(3, CAST(ceil(len(w) / 4.0) AS INTEGER))) AS d FROM t WHERE len(w) > 0),
     k AS (SELECT item_id, w, n, unnest(generate_series(greatest(1, n - d), least(n, n + d))) AS len FROM l),
     s AS (SELECT item_id, w, len, unnest(generate_series(0, n - len)) AS start FROM k)
SELECT item_id, CAST(start AS INTEGER) AS start, CAST(len AS INTEGER) AS len, array_to_string(w[start + 1:start + len], ' ') AS "window" FROM s""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.token_windows(normalized(table(spark, sf_dir, "benchmark"), "item_id", "item_id"), "normalized", "item_id")


@query()
def indel_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the turn before, whole texts both."""
    rows = text.with_normalized(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "n")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("n").alias("m"))
    pairs = rows.join(before, ["conv_id", "turn"]).repartition(4 * spark.sparkContext.defaultParallelism)  # small rows, much work: over all cores
    return pairs.select("conv_id", "turn", F.round(indel_ratio("n", "m"), 6).alias("score"), F.round(partial_indel_ratio("n", "m"), 6).alias("partial_score"))


@query("""
WITH RECURSIVE p AS (SELECT x.p_partkey, lower(x.p_name) AS a, lower(y.p_name) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1),
r AS (
  SELECT p_partkey, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda k: CAST(0 AS BIGINT)) AS lcs FROM p
  UNION ALL
  SELECT p_partkey, a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN CAST(0 AS BIGINT) ELSE greatest(lcs[k + 1], lcs[k] + CAST(substr(a, i + 1, 1) = substr(b, k, 1) AS BIGINT)) END)))
  FROM r WHERE i < length(a)
)
SELECT p_partkey, round(CAST(200.0 * lcs[length(b) + 1] / (length(a) + length(b)) AS DOUBLE), 6) AS score FROM r WHERE i = length(a)""")
def indel_ratio_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against the next part's."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"))
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return parts.join(after, "p_partkey").select("p_partkey", F.round(indel_ratio("a", "b"), 6).alias("score"))


def perturbed(df: DataFrame) -> DataFrame:
    """Targets with every ninth word left out: heard, but not word for word."""
    words = F.split("text", r"\s+")
    return df.select("query_id", F.array_join(F.filter(words, lambda w, k: k % 9 != 4), " ").alias("text"))


@query()
def fuzzy_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All occurrences of the perturbed passages in all documents."""
    media = occurrences.spoken(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = occurrences.occurrences(media, perturbed(targets(spark, sf_dir)))
    return found.withColumn("score", F.round("score", 6)).withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))


@query()
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each conversation the best window for its whole first turn, among the later turns."""
    rows = table(spark, sf_dir, "conversations")
    whole = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    later = F.array_join(F.transform(F.slice("turns", 2, F.greatest(F.size("turns") - 1, F.lit(0))), lambda t: t["text"]), " ")
    talk = whole.select("conv_id", F.col("first").alias("target"), later.alias("text"))
    media = occurrences.spoken(talk, "conv_id", "text").join(talk.select(F.col("conv_id").alias("media_id"), F.col("conv_id").alias("query_id"), "target"), "media_id")
    return occurrences.best_windows(media).withColumn("score", F.round("score", 6)).withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))


NUMBER_CASES = [("twenty", "20"), ("twenty million", "20000000"), ("20 million", "20000000"), ("twenty million dollars", "20000000 usd"), ("$20 million", "20000000 usd"), ("one hundred and fifty", "150"), ("$150,000.", "150000 usd"), ("one hundred and fifty thousand dollars", "150000 usd"), ("twenty one hundred", "21 hundred"), ("3.5", "3 5"), ("zero thousand", "0 thousand"), ("five thousand and", "5000 and"), ("one two", "1 2"), ("$ then dollars", "then usd"), ("007 million", "7000000"), ("99999999999999999999 billion", "99999999999999999999000000000")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(NUMBER_CASES)) + ") AS t(case_id, text, canonical)")
def number_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(NUMBER_CASES)], "case_id int, text string")
    return rows.withColumn("canonical", text.normalize_for_matching("text"))


def spoken_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every turn; query_id is the conversation's number times TURNS plus the turn's."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * TURNS + F.col("turn")).cast("long").alias("query_id"), "text")


def opening_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve words of each conversation's second turn, as the SQL of caption_phrases has them."""
    rows = table(spark, sf_dir, "conversations").where("turn = 1")
    return rows.select(F.col("conv_id").alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 12), " ").alias("text"))


@query()
def cue_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption candidates of the whole lines of all conversations on all conversations."""
    found = captions.candidates(captions.cue_lists(cue_table(spark, sf_dir)), spoken_targets(spark, sf_dir))
    return captions.ranked(found, "query_id", "media_id").select("query_id", "media_id", "rank", "start", "end", "match_type", F.round("score", 6).alias("score"))


@query(rf"""
WITH n AS (SELECT conv_id, turn, {SQL_NORM.format('text')} AS t FROM conversations),
     q AS (SELECT conv_id AS query_id, {SQL_FIRST_WORDS} AS q FROM conversations WHERE turn = 1),
     w AS (SELECT a.conv_id, a.turn AS s, b.turn AS e, string_agg(c.t, ' ' ORDER BY c.turn) FILTER (c.t <> '') AS t FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn >= a.turn JOIN n c ON c.conv_id = a.conv_id AND c.turn BETWEEN a.turn AND b.turn GROUP BY a.conv_id, a.turn, b.turn),
     m AS (SELECT query_id, conv_id, s, e, t, q, coalesce(bool_or(e - s >= 3 AND length(t) >= length(q)) OVER (PARTITION BY query_id, conv_id, s ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM w, q WHERE t IS NOT NULL AND q <> '')
SELECT query_id, conv_id AS media_id, CAST(s * 4.0 AS DOUBLE) AS start, CAST(e * 4.0 + 4.0 AS DOUBLE) AS "end", CASE WHEN t = q THEN 'exact' ELSE 'substring' END AS match_type FROM m WHERE NOT over AND contains(t, q)""")
def caption_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cue windows that hold the first words of a line word for word (or letter for letter), before ranking."""
    found = captions.held_phrases(captions.cue_lists(cue_table(spark, sf_dir)), opening_targets(spark, sf_dir))
    return found.select("query_id", "media_id", "start", "end", "match_type")


@query("""
WITH c AS (SELECT conv_id AS media_id, turn AS seq, CAST((turn // 2) * 4.0 AS DOUBLE) AS start, CAST((turn // 2) * 4.0 + 4.0 AS DOUBLE) AS "end", CASE length(text) % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'substring' ELSE 'fuzzy' END AS match_type, CAST(85 + length(text) % 16 AS DOUBLE) AS score FROM conversations),
     p AS (SELECT *, CASE match_type WHEN 'exact' THEN 0 WHEN 'substring' THEN 1 ELSE 2 END AS prio FROM c),
     b AS (SELECT *, row_number() OVER (PARTITION BY media_id, start, "end" ORDER BY prio, score DESC, seq) AS n FROM p)
SELECT media_id, CAST(seq AS INTEGER) AS seq, start, "end", match_type, score, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start, prio, "end", score DESC, seq) AS INTEGER) AS rank FROM b WHERE n = 1""")
def caption_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    kind = F.when(F.length("text") % 3 == 0, "exact").when(F.length("text") % 3 == 1, "substring").otherwise("fuzzy")
    begin = F.floor(F.col("turn") / 2).cast("double") * 4.0
    found = rows.select(F.col("conv_id").alias("media_id"), F.col("turn").cast("int").alias("seq"), begin.alias("start"), (begin + 4.0).alias("end"), kind.alias("match_type"), (85 + F.length("text") % 16).cast("double").alias("score"))
    return captions.ranked(found, "media_id")


@query(f"""
WITH e AS (SELECT *, {SQL_SECONDS} AS sec FROM events),
     s AS (SELECT event_id, user_id, sec - 21600.0 AS low, sec + 21600.0 AS high FROM e WHERE event_type = 'purchase'),
     p AS (SELECT user_id, sec, value FROM e WHERE event_type = 'view')
SELECT s.event_id, CAST(count(*) AS BIGINT) AS n, round(min(p.sec), 6) AS first_at, round(sum(p.value), 2) AS total FROM s JOIN p ON s.user_id = p.user_id AND p.sec >= s.low AND p.sec <= s.high GROUP BY s.event_id""")
def verify_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views within six hours of each purchase of the same user."""
    e = events(spark, sf_dir)
    spans = e.where("event_type = 'purchase'").select("event_id", "user_id", (F.col("at") - 21600.0).alias("low"), (F.col("at") + 21600.0).alias("high"))
    points = e.where("event_type = 'view'").select("user_id", F.col("at").alias("ts"), "value")
    found = intervals.interval_join(spans, points, ["user_id"], "low", "high", "ts", bucket=21600.0)
    return found.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("ts"), 6).alias("first_at"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""
WITH e AS (SELECT *, {SQL_SECONDS} AS sec FROM events),
     c AS (SELECT event_id, user_id, sec FROM e WHERE event_type = 'click'), v AS (SELECT event_id AS frame_id, user_id, sec FROM e WHERE event_type = 'view')
SELECT c.event_id, c.user_id, round(c.sec, 6) AS "at", v.frame_id, round(v.sec, 6) AS frame_at FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.sec <= v.sec""")
def frame_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first view at or after each click of the same user."""
    e = events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "at")
    views = e.where("event_type = 'view'").select("user_id", F.col("at").alias("ts"), F.col("event_id").alias("frame_id"))
    return intervals.as_of_forward(clicks, views, ["user_id"], "at", "ts", "frame_id", bucket=86400.0).select("event_id", "user_id", F.round("at", 6).alias("at"), "frame_id", F.round("ts_found", 6).alias("frame_at"))


@query(f"""
WITH e AS (SELECT *, {SQL_SECONDS} AS sec FROM events),
     s AS (SELECT event_id AS query_id, user_id AS media_id, sec AS start, sec + 3600.0 AS "end" FROM e WHERE event_type = 'error'),
     f AS (SELECT user_id AS media_id, event_id AS decode_idx, sec AS timestamp FROM e WHERE event_type = 'view')
SELECT s.query_id, s.media_id, CAST(count(*) AS BIGINT) AS n_frames, CAST(min(decode_idx) AS BIGINT) AS first_frame FROM s JOIN f ON s.media_id = f.media_id AND f.timestamp >= greatest(0.0, s.start - 60.0) - 1e-9 AND f.timestamp <= s."end" + 60.0 + 1e-9 GROUP BY ALL""")
def frames_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (views) within a minute of each span (an hour from an error)."""
    e = events(spark, sf_dir)
    spans = e.where("event_type = 'error'").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("media_id"), F.col("at").alias("start"), (F.col("at") + 3600.0).alias("end"))
    views = e.where("event_type = 'view'").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("decode_idx"), F.col("at").alias("timestamp"))
    return frames.frames_between(spans, views, 60.0).groupBy("query_id", "media_id").agg(F.count(F.lit(1)).alias("n_frames"), F.min("decode_idx").alias("first_frame"))


@query()
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a frame, its lines what stands there; the perturbed passages are looked for."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("media_id"), F.lit(0).alias("decode_idx"), F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))
    shown = frames.visible_text(frames.frame_texts(lines), perturbed(targets(spark, sf_dir)))
    return shown.select("query_id", "media_id", "decode_idx", "match_type", F.round("score", 6).alias("score"))


@query("""
WITH t AS (SELECT page_id // 6 AS media_id, CASE page_id % 2 WHEN 0 THEN 'manual' ELSE 'automatic' END AS source, CAST(page_id % 6 AS INTEGER) AS track_pos,
                  ['en','en-US','en-orig','fr','de'][page_id % 5 + 1] AS language, ['json3','vtt','srt','ttml','ass','ssa','txt'][page_id % 7 + 1] AS extension, url FROM pages),
     u AS (SELECT *, list_position(['json3','vtt','srt','ttml','ass','ssa'], extension) AS fmt FROM t WHERE extension <> 'txt' AND split_part(lower(language), '-', 1) = 'en'),
     d AS (SELECT *, row_number() OVER (PARTITION BY media_id, source, lower(language), extension, url ORDER BY fmt, track_pos) AS n FROM u),
     r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY CASE source WHEN 'manual' THEN 0 ELSE 1 END, lower(language), fmt, track_pos) AS track_rank, CASE WHEN language LIKE '%-orig' THEN 0 WHEN language = 'en' THEN 1 ELSE 2 END AS pref FROM d WHERE n = 1),
     c AS (SELECT *, dense_rank() OVER (PARTITION BY media_id, source ORDER BY pref, lower(language)) AS choice FROM r)
SELECT media_id, source, language, extension, url, CAST(track_rank AS INTEGER) AS track_rank FROM c WHERE choice = 1""")
def track_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("page_id") % n).cast("int"))
    tracks = pages.select(
        F.floor(F.col("page_id") / 6).alias("media_id"), F.when(F.col("page_id") % 2 == 0, "manual").otherwise("automatic").alias("source"), (F.col("page_id") % 6).cast("int").alias("track_pos"),
        pick(["en", "en-US", "en-orig", "fr", "de"], 5).alias("language"), F.lit(None).cast("string").alias("name"), pick([*captions.FORMATS, "txt"], 7).alias("extension"), "url", F.lit("en").alias("spoken"),
    )
    return captions.relevant_tracks(tracks, "spoken").select("media_id", "source", "language", "extension", "url", "track_rank")


@query(f"""
WITH e AS (SELECT event_id, {SQL_SECONDS} AS sec FROM events), m AS (SELECT event_id, CAST(round_even(sec * 1000, 0) AS BIGINT) AS ms FROM e)
SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS hms FROM m""")
def format_hms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", text.hms(F.col("at")).alias("hms"))


@query("""
WITH g AS (SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'caption' ELSE 'asr' END AS loc, CASE event_id % 3 WHEN 0 THEN 'ocr' ELSE 'asr' END AS ver, CASE event_id % 5 WHEN 0 THEN 'fuzzy' ELSE 'exact' END AS mt, 80.0 + event_id % 21 AS sc,
                  CASE event_id % 2 WHEN 0 THEN ['exact','substring','fuzzy'][event_id % 3 + 1] END AS ct, CASE event_id % 2 WHEN 0 THEN 84.0 + event_id % 17 END AS cs, CASE event_id % 3 WHEN 0 THEN ['exact','fuzzy'][event_id % 2 + 1] END AS ot, CASE event_id % 3 WHEN 0 THEN 84.0 + event_id % 13 END AS os, event_id % 11 = 0 AS conflict FROM events)
SELECT event_id, CASE WHEN conflict THEN 'LOW' WHEN sc < 85 THEN 'LOW' WHEN cs < 85 THEN 'LOW' WHEN os < 85 THEN 'LOW'
  WHEN ver = 'ocr' THEN CASE WHEN mt = 'exact' AND ot = 'exact' THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN loc = 'caption' AND ver = 'asr' THEN CASE WHEN mt = 'exact' AND ct IN ('exact', 'substring') THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN mt = 'exact' THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM g""")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence rules on a grid of evidence that the event numbers run through."""
    n = F.col("event_id")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (n % k).cast("int"))
    verdict = rules.confidence(
        pick(["caption", "asr"], 2), F.when(n % 3 == 0, "ocr").otherwise("asr"), F.when(n % 5 == 0, "fuzzy").otherwise("exact"), 80.0 + n % 21,
        F.when(n % 2 == 0, pick(["exact", "substring", "fuzzy"], 3)), F.when(n % 2 == 0, 84.0 + n % 17), F.when(n % 3 == 0, pick(["exact", "fuzzy"], 2)), F.when(n % 3 == 0, 84.0 + n % 13), n % 11 == 0,
    )
    return table(spark, sf_dir, "events").select("event_id", verdict["category"].alias("confidence"))


MESSAGES = [
    ("Video URL must be a valid public HTTP(S) URL.", "invalid_url", "input", "INVALID_VIDEO_URL", 422), ("No decodable video stream: decoded video frame missing", "missing_video_stream", "media_inspection", "VIDEO_UNAVAILABLE", 422),
    ("Media does not contain an audio stream.", "missing_audio_stream", "media_inspection", "VIDEO_UNAVAILABLE", 422), ("Dialogue not found.", "dialogue_not_found", "matching", "DIALOGUE_NOT_FOUND", 404), ("Transcription contains no matchable words.", "dialogue_not_found", "matching", "DIALOGUE_NOT_FOUND", 404),
    ("Target dialogue cannot be empty.", "invalid_dialogue", "input", "DIALOGUE_REQUIRED", 422), ("FFprobe failed", "invalid_media", "media_inspection", "VIDEO_UNAVAILABLE", 422), ("Could not download media", "acquisition_failed", "acquisition", "VIDEO_UNAVAILABLE", 422),
    ("Could not write final frame", "frame_output_failed", "frame_output", "PROCESSING_FAILED", 500), ("PyAV could not open it", "video_decode_failed", "frame_resolution", "PROCESSING_FAILED", 500), ("Audio extraction failed", "audio_processing_failed", "audio_extraction", "PROCESSING_FAILED", 500),
    ("Speech recognition failed", "asr_failed", "speech_recognition", "PROCESSING_FAILED", 500), ("Something else", "processing_failed", "pipeline", "PROCESSING_FAILED", 500),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{c}', '{s}', '{p}', {n})" for m, c, s, p, n in MESSAGES) + ") AS t(message, code, stage, public_code, status)")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(m,) for m, *_ in MESSAGES], "message string").withColumn("e", rules.error_stage(F.col("message"))).withColumn("public_code", rules.public_code(F.col("message")))
    return rows.select("message", "e.code", "e.stage", "public_code", rules.public_status(F.col("public_code")).alias("status"))


@query("SELECT event_id, CASE WHEN value < 1 THEN true ELSE value >= 45 AND value < 85 END AS eligible, CASE WHEN value >= 1 AND value < 45 THEN 'base_match_score_below_precision_trigger' END AS reason FROM events")
def precision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a base score (none, below one) asks for a second pass."""
    base = F.when(F.col("value") >= 1, F.col("value"))
    config = SearchConfig()
    return table(spark, sf_dir, "events").select("event_id", verify.gate(base, config.precision_trigger, config.verification_threshold).alias("eligible"), verify.gate_reason(base, config.precision_trigger).alias("reason"))


@query("""
WITH d AS (SELECT doc_id, lang FROM documents), m AS (SELECT doc_id FROM d WHERE lang = 'en'), a AS (SELECT doc_id FROM d WHERE lang IN ('en', 'fr'))
SELECT doc_id, 'manual' AS evidence FROM m UNION ALL SELECT doc_id, 'automatic' FROM a WHERE doc_id NOT IN (SELECT doc_id FROM m)
UNION ALL SELECT doc_id, 'speech' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM m) AND doc_id NOT IN (SELECT doc_id FROM a)""")
def fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in order of cost: each document takes the first source that has it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    ranked = [docs.where(c).select("doc_id", F.lit(e).alias("evidence")) for e, c in (("manual", "lang = 'en'"), ("automatic", "lang IN ('en', 'fr')"), ("speech", "true"))]
    return search.fallback(*ranked, keys=["doc_id"])


@query("WITH d AS (SELECT doc_id, lang, sha256('base|' || coalesce(text, '')) AS key FROM documents) SELECT doc_id, key FROM d WHERE key NOT IN (SELECT key FROM d WHERE lang = 'en')")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content has no memo, when the English ones have been done."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", cache.digest(F.lit("base"), F.coalesce("text", F.lit(""))).alias("key"))
    memo = cache.envelope(docs.where("lang = 'en'"), "key", ["doc_id"], "transcript")
    return cache.hits_and_misses(docs.select("doc_id", "key"), memo, "key", "transcript")[1].select("doc_id", "key")


@query(r"""
SELECT page_id, url, regexp_matches(url, '^(?i)https?://[^/?#\s]+') AS valid, sha256(url) AS key,
       'direct-' || substr(sha256(url), 1, 16) || CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '^[^:]+://[^/]*/(.*/)?[^/]+\.[A-Za-z0-9]{1,9}$') THEN lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[A-Za-z0-9]{1,9})$', 1)) ELSE '.media' END AS file_name FROM pages""")
def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = urls.clean(F.concat(F.lit(" <"), F.col("url"), F.lit("> ")))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), urls.is_public(url).alias("valid"), urls.cache_key(url).alias("key"), urls.file_name(url).alias("file_name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS ratio, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:string>")["k"].alias("k"))
    return rows.select("event_id", metadata.rational(F.concat("k", F.lit("/100"))).alias("ratio"), F.col("k").try_cast("int").alias("k"))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents WHERE lang IS NOT NULL GROUP BY source")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("media_id"), F.col("lang").alias("language"))
    return captions.available_languages(rows).select(F.col("media_id").alias("source"), F.array_join("languages", ",").alias("languages"))


@query("WITH c AS (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id AS media_id, CAST((CASE WHEN n > 5 THEN n * 5.0 ELSE last * 4.0 + 4.0 END) * 2 AS DOUBLE) AS audio_processed_seconds FROM c")
def processed_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of two passes: the duration where it is known (more than five turns), else the end of the last word."""
    words = cue_table(spark, sf_dir).withColumnRenamed("cue_idx", "word_idx")
    media = words.groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).select("media_id", F.when(F.col("n") > 5, F.col("n") * 5.0).alias("duration"))
    return verify.processed_seconds(media, words, passes=2)


@query(r"SELECT conv_id AS media_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS cue_idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CAST(turn * 4.0 AS DOUBLE) AS start, CAST(turn * 4.0 + 3.5 AS DOUBLE) AS \"end\" FROM conversations WHERE trim(text) <> ''".replace('\\"', '"'))
def subtitle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as SubRip files and parsed again."""
    rows = table(spark, sf_dir, "conversations")
    srt = lambda s: F.replace(text.hms(s), F.lit("."), F.lit(","))
    block = F.concat_ws("\n", (F.col("turn") + 1).cast("string"), F.concat(srt(F.col("turn") * 4.0), F.lit(" --> "), srt(F.col("turn") * 4.0 + 3.5)), F.regexp_replace("text", r"\s*\n\s*", "\n"))
    files = rows.withColumn("block", block).groupBy(F.col("conv_id").alias("media_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda b: b["block"]), "\n\n").alias("content"))
    files = files.select("media_id", F.lit("manual").alias("source"), F.lit("en").alias("language"), F.lit("srt").alias("extension"), "content")
    return subtitles.cues(files).select("media_id", "cue_idx", "text", "start", "end")


@query("SELECT l_orderkey AS media_id, CAST(sum(l_quantity) AS DOUBLE) AS duration, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS has_video, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 AS has_audio, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS INTEGER) AS n_subtitles FROM lineitem GROUP BY l_orderkey")
def media_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container facts from JSON: each order is a medium, its lines are its streams."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "video").when(F.col("l_returnflag") == "A", "audio").otherwise("subtitle")
    streams = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("index"), kind.alias("codec_type"))))
    probe = F.to_json(F.struct(F.struct(F.sum("l_quantity").cast("string").alias("duration")).alias("format"), streams.alias("streams")))
    media = metadata.media_info(lines.groupBy(F.col("l_orderkey").alias("media_id")).agg(probe.alias("probe")), "probe")
    return media.select("media_id", "duration", "has_video", "has_audio", F.size("embedded_subtitles").alias("n_subtitles"))


@query("SELECT page_id AS media_id, url, 'v' || (page_id % 7) AS format_url FROM pages")
def stream_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The video format nearest to 720 lines from provider metadata built on the pages' URLs."""
    pages = table(spark, sf_dir, "pages")
    other = lambda url, height: F.struct(url.alias("url"), F.lit("vp9").alias("vcodec"), F.lit(height).alias("height"), F.lit(1000.0).alias("tbr"))
    best = F.concat(F.lit("v"), (F.col("page_id") % 7).cast("string"))
    meta = F.to_json(F.struct(F.lit("none").alias("vcodec"), F.array(other(F.lit("tall"), 1080.0), other(best, 720.0), other(F.lit("small"), 360.0)).alias("formats")))
    rows = metadata.parsed(pages.select(F.col("page_id").alias("media_id"), "url", meta.alias("json")), "json")
    return rows.select("media_id", "url", metadata.video_source(F.col("meta"))["url"].alias("format_url"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'VIDEO_URL_REQUIRED' WHEN page_id % 5 = 1 THEN 'INVALID_VIDEO_URL' WHEN page_id % 5 = 2 THEN 'DIALOGUE_REQUIRED' END AS code FROM pages")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that can't be run, as codes: blank URLs, others than http, blank lines."""
    n = F.col("page_id") % 5
    url = F.when(n == 0, "  ").when(n == 1, F.concat(F.lit("ftp://"), F.col("url"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", rules.request_error(url, F.when(n == 2, " ").otherwise("a line"), urls.is_public(urls.clean(url))).alias("code"))


@query()
def caption_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: all whole lines of the conversations searched in captions, verified by the words around, then in all speech."""
    cues = cue_table(spark, sf_dir)
    parts = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    spread = cues.select("media_id", "start", F.posexplode(parts).alias("k", "text"), F.size(parts).alias("n"), F.col("cue_idx"))
    words = spread.select("media_id", (F.col("cue_idx") * 10000 + F.col("k")).cast("int").alias("word_idx"), "text", (F.col("start") + F.col("k") * 4.0 / F.col("n")).alias("s"), (F.col("start") + (F.col("k") + 1) * 4.0 / F.col("n")).alias("end")).withColumnRenamed("s", "start")
    media = cues.groupBy("media_id").agg((F.max("end") + 1.0).alias("duration")).withColumn("audio_start_time", F.lit(0.0))
    found = search.search(cues, words, spoken_targets(spark, sf_dir), media)
    return found.select("query_id", "media_id", "matched_text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "match_type", F.round("score", 6).alias("score"), "localization_source", "caption_match_type", "evidence_conflict", "confidence", F.round("audio_processed_seconds", 3).alias("audio_processed_seconds"), "occurrence_count")


def queries() -> dict[str, Query]:
    from echoline.plans import catalog_lazy, catalog_more  # noqa: F401  (register their queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from echoline.plans import catalog_lazy, catalog_more  # noqa: F401  (register their queries)

    return dict(ORACLE)
