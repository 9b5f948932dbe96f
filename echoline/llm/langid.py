"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary logistic classifier over hashed byte n-grams (lower-cased, other
ASCII signs as spaces) is trained to tell the languages with a one from those with a zero. A text goes to the codeword
with the least weighted logistic loss; a bit weighs as much as it separates the training snippets. Texts whose two best
codewords are close are flagged as ambiguous.

The fit uses snippets of at most ROWS_A_LANGUAGE documents of each language (a documented bound, drawn by a hash of the
id); prediction covers every text in full. The languages themselves, a short list, come to the driver. Of codewords that
are equally near the one of the alphabetically first language is chosen; such a text is flagged as ambiguous.

Defined results: `und` with score 0 for null texts and texts without a letter, or when nothing can be learned; one
learned language gives that language with score 1; repeated rows predict alike.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoline.llm.base import binary_text, bound_batches, spark_to_arrow

ROWS_A_LANGUAGE, SNIPPETS, ORDERS, BUCKET_BITS = 400, (600, 120, 60, 30), (2, 3, 4), 16
ITERATIONS, RATE, RIDGE, AMBIGUOUS_MARGIN = 25, 0.5, 1e-4, 0.1
STEP_BYTES = 1 << 19
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1: all distinct splits for up to five languages, else the random code of greatest distance."""
    if n <= 5:
        bits = [[1 if i == 0 or (k >> (i - 1)) & 1 else -1 for i in range(n)] for k in range(2 ** max(0, n - 1) - 1)]
        return np.array(bits, np.float32).reshape(-1, n).T.copy() if bits else np.ones((n, 0), np.float32)
    rng, width, best = np.random.default_rng(seed), math.ceil(10 * math.log2(n)), (-1, None)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = int(min((code.shape[1] - code @ code.T)[~np.eye(n, dtype=bool)]) // 2)
        if apart > best[0]:
            best = (apart, code)
    return best[1]


def ngrams(buffer: np.ndarray, offsets: np.ndarray, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every n-gram of every order (with `starts`, of those that begin at the first `starts`
    bytes); n-grams don't cross documents."""
    folded = FOLD[buffer].astype(np.uint32)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found, owners = [], []
    packed = folded.copy()
    for n in range(2, max(ORDERS) + 1):
        packed = (packed[:-1] << np.uint32(8)) | folded[n - 1 :] if len(packed) > 1 else packed[:0]
        if n in ORDERS:
            inside = owner[: len(packed)] == owner[n - 1 : n - 1 + len(packed)]
            inside[starts if starts is not None else len(inside) :] = False
            bucket = (packed * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
            found.append(bucket[inside].astype(np.int32) + (ORDERS.index(n) << BUCKET_BITS))
            owners.append(owner[: len(packed)][inside])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-gram buckets x bits
    bias: np.ndarray
    bit_weight: np.ndarray


def margins(model_weights: np.ndarray, bias: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The classifiers' outputs: the mean weight of a document's n-grams, scaled, plus the bias."""
    count = np.bincount(owner, minlength=n)
    out = np.empty((n, len(bias)))
    for bit in range(len(bias)):
        out[:, bit] = np.bincount(owner, model_weights[:, bit][bucket], minlength=n)
    return out / np.sqrt(np.maximum(count, 1))[:, None] + bias


def totals(model_weights: np.ndarray, joined: np.ndarray, offsets: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(summed weights for each bit, n-grams) of each text, step bytes at a time; each n-gram counts in the piece that it
    begins in, so pieces give the same sums as whole texts."""
    n = len(offsets) - 1
    sums, counts = np.zeros((n, model_weights.shape[1])), np.zeros(n)
    for at in range(0, len(joined), step):
        piece = joined[at : at + step + max(ORDERS) - 1]
        bucket, owner = ngrams(piece, np.clip(offsets - at, 0, len(piece)), step)
        for bit in range(sums.shape[1]):
            sums[:, bit] += np.bincount(owner, model_weights[:, bit][bucket], minlength=n)
        counts += np.bincount(owner, minlength=n)
    return sums, counts


def decode(model: Model, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, ambiguous) by least weighted logistic loss."""
    loss = np.stack([(np.logaddexp(0, -f * word) * model.bit_weight).sum(1) for word in model.code], 1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    order = np.sort(p, 1)
    best = loss.argmin(1)
    return best, p[np.arange(len(p)), best], (order[:, -1] - order[:, -2] < AMBIGUOUS_MARGIN) if p.shape[1] > 1 else np.zeros(len(p), bool)


def snippets(docs: DataFrame, counts: dict[str, int], fold_column, most: int) -> list[tuple[str, bytes]]:
    """(language, snippet) of at most `most` documents of each language: a draw by the id's hash of about twice as many,
    and of these the first of each language by the same hash, so that no language crowds out another."""
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, 2 * most / n)))])
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lit(11))
    draw = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & fold_column(F.col("doc_id").cast("long"))).where(draw < share[F.col("lang")])
    bound_batches(docs.sparkSession)
    schema = "lang string, id long, key long, snippets array<binary>"
    fields = spark_to_arrow(docs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            out = []
            for lang, doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng = np.random.default_rng((abs(doc or 0), len(text)))
                places = [(int(rng.integers(0, max(1, len(text) - n + 1))), n) for n in SNIPPETS]
                out.append((lang, doc, key, [text[at : at + n] for at, n in places]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    found = rows.select("lang", F.col("doc_id").cast("long").alias("id"), key.alias("key"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
    first = Window.partitionBy("lang").orderBy("key", "id", "snippets")
    found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).orderBy("lang", "n")
    return [(r["lang"], bytes(s)) for r in found.collect() for s in r["snippets"]]  # `most` rows a language


def learn(docs: DataFrame, fold_column=lambda c: F.lit(True), most: int = ROWS_A_LANGUAGE) -> Model:
    """Fit on the rows with a language and a text whose id satisfies fold_column."""
    counts = {r["lang"]: r["n"] for r in docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & fold_column(F.col("doc_id").cast("long"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    code = codewords(len(languages))
    dims = len(ORDERS) << BUCKET_BITS
    model = Model(languages, code, np.zeros((dims, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.ones(code.shape[1], np.float32))
    if len(languages) < 2:
        return model
    rows = [(lang, text) for lang, text in snippets(docs, counts, fold_column, most) if text.strip()]
    if not rows:
        return model
    place = {lang: k for k, lang in enumerate(languages)}
    label = np.array([place[lang] for lang, _ in rows])
    offsets = np.cumsum([0, *(len(t) for _, t in rows)])
    bucket, owner = ngrams(np.frombuffer(b"".join(t for _, t in rows), np.uint8), offsets)
    each = np.bincount(label, minlength=len(languages)).astype(np.float64)
    sample_weight = (len(rows) / len(languages) / np.maximum(each, 1))[label] / len(rows)
    norm = (1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(rows)), 1)))[owner]
    for bit in range(code.shape[1]):
        y = code[label, bit].astype(np.float64)
        w, b, seen_w, seen_b = np.zeros(dims), 0.0, np.full(dims, 1e-8), 1e-8
        for _ in range(ITERATIONS):
            f = np.bincount(owner, w[bucket] * norm, minlength=len(rows)) + b
            g = -y * sample_weight / (1 + np.exp(np.clip(y * f, -30, 30)))
            grad = np.bincount(bucket, g[owner] * norm, minlength=dims) + RIDGE * w
            seen_w, seen_b = seen_w + grad * grad, seen_b + g.sum() ** 2
            w, b = w - RATE * grad / np.sqrt(seen_w), b - RATE * g.sum() / math.sqrt(seen_b)
        f = np.bincount(owner, w[bucket] * norm, minlength=len(rows)) + b
        right = float((sample_weight * (f * y > 0)).sum())
        model.weights[:, bit], model.bias[bit], model.bit_weight[bit] = w, b, max(0.05, 2 * right - 1)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every text."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # a fixed number of weights for each bit
    schema = "id long, lang_pred string, score double, ambiguous boolean"
    fields = spark_to_arrow(spark, schema)

    def run(batches):
        m = sent.value
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            lang, score, unsure = [UNDETERMINED] * len(ids), [0.0] * len(ids), [False] * len(ids)
            todo = [k for k, t in enumerate(texts) if t and m.languages and LETTER.search(t.decode("utf-8", "replace"))]
            if len(m.languages) == 1:
                for k in todo:
                    lang[k], score[k] = m.languages[0], 1.0
                todo = []
            while todo:
                n, room = 0, STEP_BYTES
                while n < len(todo) and (room > 0 or not n):
                    room -= len(texts[todo[n]])
                    n += 1
                part, todo = todo[:n], todo[n:]
                joined = np.frombuffer(b"".join(texts[k] for k in part), np.uint8)
                sums, counts = totals(m.weights, joined, np.cumsum([0, *(len(texts[k]) for k in part)]), 4 * STEP_BYTES)
                best, p, close = decode(m, sums / np.sqrt(np.maximum(counts, 1))[:, None] + m.bias)
                for k, i, s, c in zip(part, best.tolist(), p.tolist(), close.tolist(), strict=True):
                    lang[k], score[k], unsure[k] = m.languages[i], s, c
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], schema=fields)

    return binary_text(docs, id_col, text_col).mapInArrow(run, schema)


def language_query(docs: DataFrame) -> DataFrame:
    """Learn on the rows whose id's checksum modulo 4 isn't 2, predict all."""
    from echoline.llm.toxicity import crc_of_id

    model = learn(docs, lambda c: crc_of_id(c) % 4 != 2)
    return predict(docs, model).select(F.col("id").alias("doc_id"), (crc_of_id(F.col("id")) % 4 == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
