from __future__ import annotations

import time

import numpy as np
from conftest_llm import make_docs

from echoline.llm import neardup, shingles
from echoline.llm.base import spark_to_arrow


def test_packing_does_not_depend_on_the_number_of_buckets(spark):
    """The same codes, dealt to a few buckets and to fifty million."""
    fields = spark_to_arrow(spark, shingles.SENT)
    h = shingles.mix(np.arange(1, 20_001, dtype=np.uint64))
    spent = []
    for n_buckets in (4, 50_000_000):
        code, count = shingles.distinct_counts(shingles.deal(h, n_buckets), np.zeros(len(h), np.int64))
        began = time.perf_counter()
        table = shingles.pack_counts(3, code, count, fields)
        spent.append(time.perf_counter() - began)
        got = {(b << 32) | int(k) for b, keys in zip(table.column("bucket").to_pylist(), table.column("keys").to_pylist(), strict=True) for k in np.frombuffer(keys, "<u4")}
        assert got == set(code.tolist())
    assert table.num_rows > 19_000
    assert spent[1] < 1.0  # an array over all buckets alone would take 400 MB


def test_packing_nothing(spark):
    fields = spark_to_arrow(spark, shingles.SENT)
    assert shingles.pack_counts(0, np.empty(0, np.uint64), np.empty(0, np.int64), fields).num_rows == 0


def test_rows_of_one_id_are_dealt_over_the_chunks(spark):
    rows = [(None, f"text {k}") for k in range(600)] + [(7, f"word {k}") for k in range(600)]
    dealt = shingles.chunked(make_docs(spark, rows), 12, "doc_id", "text").groupBy("id", "chunk").count().collect()
    for doc in (None, 7):
        sizes = [r["count"] for r in dealt if r["id"] == doc]
        assert len(sizes) == 12
        assert max(sizes) < 120


def test_samples_of_long_texts_are_independent():
    """Two sets of far more elements than there are draws: bands agree as often as their similarity says."""
    rng, n = np.random.default_rng(3), 300_000
    h = np.sort(rng.integers(1, 1 << 63, n, dtype=np.uint64))
    other = np.sort(np.concatenate([h[rng.random(n) < 0.9], rng.integers(1, 1 << 63, n // 10, dtype=np.uint64)]))
    common = len(np.intersect1d(h, other))
    similarity = common / (len(h) + len(other) - common)
    table = neardup.draws()
    first = np.zeros(1, np.int64)
    a, b = (neardup.bands_of(x, np.ones(len(x)), first, table)[0] for x in (h, other))
    agree = (a == b).mean()
    assert abs(agree - similarity**neardup.ROWS) < 4 * (similarity**neardup.ROWS / neardup.BANDS) ** 0.5
    assert 0 < (a == b).sum() < neardup.BANDS
