"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A document is its weighted set of five-word shingles (ASCII-lower-cased words; a shorter text is one shingle). A
shingle weighs tf * idf with the normalised inverse document frequency 1 + log((1 + N) / (1 + df)) / log(1 + N): from one
for what every document has to nearly two for what one document alone has, at any N. (Without the division by log(1 + N) the
weight of rare shingles grows with the corpus, and edited words outweigh what a group of thousands of copies shares.)

1. The document frequencies of all shingles come from the corpus-wide exchange of `shingles`.
2. A shingle that one document alone has is shared with no other, so a document whose repeated shingles hold less than
   THRESHOLD of its weight has no neighbour; the others are sampled (ROWS * BANDS consistent weighted samples).
3. Documents of equal weighted sets count as one. Sets that agree in a band are tested by exact weighted Jaccard
   similarity, first against the centre of their bucket, then among those whose classes still differ (see `link`). Since
   one minus the similarity is a metric, distances to the centre rule out pairs, as do the weights of shingles that no
   other document has. So no bucket is expanded into all pairs, and within the buckets no link between classes is lost.
4. Classes are the connected components of the links, by label propagation on tables.

Bands find a pair of similarity 0.8 with probability 1 - (1 - 0.8 ** 5) ** 25 > 0.9999.

Defined results: null, empty and wordless texts are in classes of their own; rows of one id are one document, in one
class; a class is named by its smallest id; rows without an id get no class (null).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoline.llm.base import bound_batches, map_rows, persist, spark_to_arrow
from echoline.llm.shingles import LOWER, STEP, Texts, answers, as_table, chunked, deal, distinct_counts, look_up, mix, repeated, sizes

WIDTH, THRESHOLD = 5, 0.8
ROWS, BANDS, SEED = 5, 25, 20240501
#: Rounds of tests against the centre of a bucket, before single pairs are tested.
STARS = 2
DRAW_BITS = 16
SKETCH = "id long, set_hash binary, total double, common double, bands array<bigint>, keys binary, weights binary"


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of all shingles, owners in order."""
    at, h = texts.windows(WIDTH)
    owner = texts.owner[at].astype(np.int64)
    n_words = np.diff(texts.first)
    short = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
    if len(short):
        own = [mix(np.array([sum(int(w) * pow(int(STEP), k + 1, 1 << 64) for k, w in enumerate(texts.hash[texts.first[d] : texts.first[d + 1]].tolist())) % (1 << 64)], np.uint64))[0] for d in short.tolist()]
        h, owner = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, owner


def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(r, log c, beta) of 2 ** DRAW_BITS draws, and an odd multiplier for each sample. Gamma(2, 1) twice, uniform once."""
    rng = np.random.default_rng(SEED)
    n = 1 << DRAW_BITS
    r = -np.log(rng.random(n) * rng.random(n) + 1e-300)
    c = -np.log(rng.random(n) * rng.random(n) + 1e-300)
    multipliers = rng.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.maximum(r, 1e-6).astype(np.float32), np.log(np.maximum(c, 1e-30)).astype(np.float32), rng.random(n).astype(np.float32), multipliers


def bands_of(h: np.ndarray, weight: np.ndarray, first: np.ndarray, table: tuple) -> np.ndarray:
    """Band keys (documents x BANDS) of the weighted sets that begin at `first`.

    A sample is the element of least a, where t = floor(log(w) / r + beta), log a = log c - r * (t - beta + 1). For one
    element a names t, so (a, element) is the sample. Elements that share a draw, as they do in long texts, have equal a;
    they are told apart by bits that differ from sample to sample, so that samples of long texts stay independent.
    """
    r, log_c, beta, multipliers = table
    log_w = np.log(weight).astype(np.float32)
    out = np.zeros((len(first), BANDS), np.uint64)
    for k, multiplier in enumerate(multipliers):
        product = h * multiplier
        at = (product >> np.uint64(64 - DRAW_BITS)).astype(np.intp)
        low = (product >> np.uint64(64 - DRAW_BITS - 32)) & np.uint64(0xFFFFFFFF)
        rk, bk = r[at], beta[at]
        t = np.floor(log_w / rk + bk)
        bits = (log_c[at] - rk * (t - bk + np.float32(1))).view(np.int32)
        ordered = np.where(bits < 0, ~bits, bits ^ np.int32(-(2**31))).view(np.uint32)
        sample = np.minimum.reduceat((ordered.astype(np.uint64) << np.uint64(32)) | low, first)
        out[:, k // ROWS] = mix(out[:, k // ROWS] * STEP + sample + np.uint64(k + 1))
    return out


def idf(df: np.ndarray, n_documents: int) -> np.ndarray:
    return 1 + np.log((1 + n_documents) / (1 + df)) / math.log(1 + max(1, n_documents))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """SKETCH rows of the documents that can have a neighbour: hash of the weighted set, its weight, its band keys, and
    its shingles that other documents have too, with their weights."""
    spark = docs.sparkSession
    bound_batches(spark)
    n_documents, n_chunks, n_buckets = sizes(docs, text_col)
    chunks = chunked(docs.where(F.col(id_col).isNotNull()), n_chunks, id_col, text_col)
    fields = spark_to_arrow(spark, SKETCH)

    def codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h, owner = shingles(Texts(table.column("text").to_pylist(), LOWER))
        return deal(h, n_buckets), owner

    def sketch(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return as_table([], fields)
        ids = table.column("id").to_pylist()
        h, owner = shingles(Texts(table.column("text").to_pylist(), LOWER))
        code = deal(h, n_buckets)
        local, n_texts = distinct_counts(code, owner)
        elsewhere, total = answers(known)
        df_of = np.maximum(n_texts, look_up(local, elsewhere, total, 0))
        order = np.lexsort((h, owner))
        h, owner, code = h[order], owner[order], code[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.empty(0, bool)
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        h, owner, code = h[at], owner[at], code[at]
        df = look_up(code, local, df_of, 1)
        weight = tf * idf(df, n_documents)
        n = len(ids)
        whole = np.bincount(owner, weight, n)
        common = np.bincount(owner, weight * (df > 1), n)
        candidate = (common >= threshold * whole * (1 - 1e-9)) & (whole > 0)
        keep = candidate[owner] if len(owner) else np.empty(0, bool)
        h, owner, tf, df, weight = h[keep], owner[keep], tf[keep], df[keep], weight[keep]
        if not len(h):
            return as_table([], fields)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        bands = bands_of(h, weight, first, draws())
        marks = [np.add.reduceat(mix(h + tf.astype(np.uint64) * np.uint64(m)), first) for m in (0x9FB21C651E98DF25, 0xA0761D6478BD642F)]
        cut, rows = np.append(first, len(h)), []
        for k, d in enumerate(owner[first].tolist()):
            part = slice(cut[k], cut[k + 1])
            several = df[part] > 1
            rows.append((ids[d], marks[0][k].tobytes() + marks[1][k].tobytes(), float(whole[d]), float(common[d]), bands[k].view(np.int64).tolist(), h[part][several].tobytes(), weight[part][several].astype("<f4").tobytes()))
        return as_table(rows, fields)

    shared = repeated(chunks, codes)
    return chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(sketch, SKETCH)


def jaccard(keys_a: bytes, weights_a: bytes, total_a: float, keys_b: bytes, weights_b: bytes, total_b: float) -> float:
    """Weighted Jaccard similarity from the shared part of two sets and their whole weights."""
    a, b = np.frombuffer(keys_a, np.uint64), np.frombuffer(keys_b, np.uint64)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = float(np.minimum(np.frombuffer(weights_a, "<f4")[i], np.frombuffer(weights_b, "<f4")[j]).sum(dtype=np.float64))
    return both / max(total_a + total_b - both, 1e-300)


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of each pair of representatives."""
    columns = ("keys", "weights", "total")
    left = sets.select(F.col("rep").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = sets.select(F.col("rep").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", *[f"{s}_{c}" for s in "ab" for c in columns])
    return map_rows(rows, lambda: lambda a, b, ka, wa, ta, kb, wb, tb: (a, b, jaccard(ka, wa, ta, kb, wb, tb)), "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for nodes with a link.

    Each round takes the least label among the neighbours, then the label's own label; rounds grow with the logarithm
    of a component's width. Every round is written to the shared folder.
    """
    both = persist(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "near-links")
    labels = persist(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "near-labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels["node"] == heard["x"]).select("node", "label", F.least("label", "heard").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        new = persist(nearer.join(jump, "next").select("node", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") < F.col("label")).alias("moved")), "near-labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def link(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) with a > b: verified links whose components are those of all links between sets that share a band.

    Stars first: a bucket's members are tested against its most central one, the set that meets most others over all
    bands (in a group of edited copies that is the original), and those that fail and are still in another class against
    the most central of them, STARS times. Then every pair of a bucket whose classes still differ is tested, but for
    those that the distances to the bucket's centre rule out; each pair once, in the first band that it shares. After
    the stars few sets are outside of a bucket's largest class, so a large group costs about one test for each member
    and bucket, not one for each pair.
    """
    spread = sets.select("rep", F.explode("bands").alias("key"))
    several = persist(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-keys")
    buckets = spread.join(several, "key")
    central = persist(buckets.groupBy("rep").agg(F.sum("n").alias("meets")), "near-central")
    buckets = persist(buckets.drop("n").join(central, "rep"), "near-buckets")
    left, links, done, first = buckets, None, None, None
    for step in range(STARS):
        leaders = persist(left.groupBy("key").agg(F.max_by("rep", F.struct("meets", -F.col("rep"))).alias("leader")), "near-leaders")
        members = persist(left.join(leaders, "key").where("rep <> leader"), "near-members")
        found, judged = tests(members.withColumnRenamed("leader", "other"), sets, done)
        judged = persist(judged.withColumnRenamed("other", "leader"), "near-judged")
        done = found if done is None else done.unionByName(found)
        good = found.where(F.col("similarity") >= threshold).select("a", "b")
        links = good if links is None else links.unionByName(good)
        first = judged if first is None else first
        labels = components(links)
        left = judged.where(F.col("similarity") < threshold)
        left = labelled(labelled(left, labels, "rep"), labels, "leader").where("rep_label <> leader_label").select("key", "rep", "meets")
        if left.isEmpty():
            break
    pairs = open_pairs(buckets, first, labels, sets, threshold)
    more, _ = tests(pairs, sets, done)
    return links.unionByName(more.where(F.col("similarity") >= threshold).select("a", "b"))


def tests(members: DataFrame, sets: DataFrame, done: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(new similarities (a, b, similarity), members (rep, other, ...) with `similarity`); pairs in done aren't tested again."""
    pair = (F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b"))
    pairs = members.select(*pair).distinct()
    found = persist(similarities(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), sets), "near-similarities")
    known = found if done is None else done.unionByName(found)
    return found, members.select("*", *pair).join(known, ["a", "b"]).drop("a", "b")


def labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """rows with the class of `column` in `<column>_label`; a set without a link is a class of its own."""
    found = labels.select(F.col("node").alias(column), F.col("label").alias(f"{column}_label"))
    return rows.join(found, column, "left").withColumn(f"{column}_label", F.coalesce(f"{column}_label", column))


def open_pairs(buckets: DataFrame, judged: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, other): the pairs of a bucket that are in different classes and may be linked.

    Two bounds rule pairs out before they are made, without losing a link. judged has the similarities to each bucket's
    centre: sets whose distances to it differ by more than the largest distance of a link aren't linked. And two sets share
    at most the smaller weight of their repeated shingles; a link must share threshold / (1 + threshold) of both weights.
    """
    far = 1 - threshold
    near = judged.select("key", "rep", F.col("similarity").alias("s"))
    rows = labelled(buckets.select("key", "rep").join(near, ["key", "rep"], "left").withColumn("s", F.coalesce("s", F.lit(1.0))), labels, "rep").withColumnRenamed("rep_label", "label")
    rows = persist(rows, "near-open")
    counts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = persist(counts.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max_by("label", F.struct("n", "label")).alias("largest")).where("classes > 1").select("key", "largest"), "near-mixed")
    rows = persist(rows.join(mixed, "key").join(sets.select("rep", "bands", "total", "common"), "rep"), "near-open")
    outside = rows.where("label <> largest").select("key", F.col("rep").alias("other"), F.col("label").alias("other_label"), F.col("s").alias("other_s"), *[F.col(c).alias(f"other_{c}") for c in ("bands", "total", "common")])
    once = (F.col("label") == F.col("largest")) | (F.col("rep") > F.col("other"))
    near_centre = F.abs(F.col("s") - F.col("other_s")) <= far + 1e-6
    enough = F.least("common", "other_common") * (1 + threshold) >= threshold * (F.col("total") + F.col("other_total")) * (1 - 1e-6)
    joined = rows.alias("r").join(outside.alias("o"), (F.col("r.key") == F.col("o.key")) & (F.col("label") != F.col("other_label")) & near_centre & enough & once & (F.array_min(F.array_intersect("bands", "other_bands")) == F.col("r.key")))
    return persist(joined.select("rep", "other"), "near-open-pairs")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) of the documents that share a class with another one or could have; others are classes of their own."""
    sketch = persist(sketches(docs, id_col, text_col, threshold), "near-sketches")
    sets = persist(sketch.groupBy("set_hash").agg(F.min("id").alias("rep"), *[F.min_by(c, "id").alias(c) for c in ("total", "common", "bands", "keys", "weights")]), "near-sets")
    labels = components(persist(link(sets, threshold), "near-links"))
    named = sets.select("set_hash", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("set_hash", F.coalesce("label", "rep").alias("class_id"))
    return sketch.select("id", "set_hash").join(named, "set_hash").groupBy("id").agg(F.min("class_id").alias("class_id"))


def near_query(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: its class, and whether it is the one to keep."""
    found = classes(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(found, rows["doc_id"] == found["id"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("class_id", "doc_id") == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that name their class: one document of each class stays, with all its columns. Of rows that
    repeat an id and its text one stays; rows of one id with different texts all stay, as do rows without an id."""
    gone = persist(classes(docs, id_col, text_col).where("class_id <> id").select("id"), "near-gone")
    rows = docs.join(gone, docs[id_col] == gone["id"], "left_anti")
    several = persist(docs.where(docs[id_col].isNotNull()).groupBy(docs[id_col].alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "near-repeated")
    single = rows.join(several, rows[id_col] == several["id"], "left_anti")
    packed = rows.join(several, rows[id_col] == several["id"], "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    same = Window.partitionBy(f"r.{id_col}", F.sha2(F.coalesce(F.col(f"r.{text_col}").cast("binary"), F.lit("").cast("binary")), 256), F.col(f"r.{text_col}").isNull()).orderBy(F.lit(1))
    first = packed.withColumn("place", F.row_number().over(same)).where("place = 1").select("r.*")
    return single.unionByName(first)
