from __future__ import annotations

import hashlib
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from conftest_llm import make_docs

import __spark_entry__
from echoline.llm import registry
from echoline.llm.base import work_dir

corpus_pipeline = pytest.importorskip("corpus_pipeline")
began = time.time()


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    """Tables with planted toxic texts, copies and repeated passages."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    for k in range(300):
        rows.append((k, prose(k, 60, 300) + (f" {prose(k + 7, 1)} moron" if k % 5 == 0 else "")))
        labels.append((k, 1, int(k % 5 == 0)))
    passage = prose(70_000, 55)
    rows += [(1000 + k, f"{prose(2000 + k, 30)} {passage} {prose(3000 + k, 30)}") for k in range(4)]
    rows += [(2001, rows[1][1]), (2002, rows[2][1] + " end"), (2003, "what a m0r0n you are"), (2004, None), (2005, "")]
    make_docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(rows), passage


def test_stages(spark, folder, tmp_path, tokenizer):
    path, texts, passage = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "mixing", "byte_bpe"]
    clean = {d for d in texts if d < 300 and d % 5} | {1000, 1001, 1002, 1003, 2001, 2002, 2004, 2005}
    assert {r["doc_id"] for r in seen["toxicity"]} == clean
    kept = clean - {2001, 2002}
    assert {r["doc_id"] for r in seen["near_duplicates"]} == kept
    assert {r["doc_id"] for r in seen["substrings"]} == kept
    cut = {r["doc_id"]: r["text"] for r in seen["substrings"]}
    assert passage in cut[1000]
    assert not any(passage in cut[d] for d in (1001, 1002, 1003))
    assert all(cut[d] == texts[d] for d in kept if d < 1000)
    assert all(r["n_chars"] == len(r["text"] or "") for r in seen["substrings"])
    assert {r["doc_id"] for r in seen["mixing"]} == kept
    import tiktoken

    from echoline.llm import bpe

    library = tiktoken.Encoding("own", pat_str=tokenizer[1], mergeable_ranks=bpe.load_ranks(tokenizer[0]), special_tokens={})
    for r in seen["byte_bpe"]:
        ids = library.encode_ordinary(cut[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert len(seen["byte_bpe"]) == len(seen["mixing"])


def test_run(spark, folder):
    path, texts, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]
    assert out.select("doc_id").distinct().count() == 60 * 4 + 4 + 2


def test_run_on_awkward_rows(spark, awkward, tmp_path):
    """Nulls, empty and very long texts, repeated rows and columns of clashing names; with labels that teach nothing."""
    docs = make_docs(spark, awkward, extra=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert seen == {d for d, _ in awkward} - {9}  # 9 has the text of 8
    for folder in Path(work_dir(spark)).iterdir():
        assert not folder.name.startswith(("scratch", "pipeline-toxicity", "pipeline-near", "pipeline-substrings", "pipeline-mixing")) or folder.stat().st_mtime < began


def test_run_on_empty_tables(spark, tmp_path):
    make_docs(spark, [(1, "x")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]
    assert out.count() == 0


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    for n in range(1, 11):
        assert any(re.match(rf"op{n}_", x) for x in names)
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_on_small_tables(spark, sf_dir, name):
    rows = registry.queries()[name](spark, sf_dir).collect()
    assert rows
    if name.startswith(("op1_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_")):
        ids = [r["doc_id"] for r in rows]
        assert len(ids) == len(set(ids)) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if name.startswith(("op9_", "op10_")):
        modulus, value = (5, 0) if name.startswith("op9_") else (4, 2)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == value) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = registry.queries()[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(found.fetchall(), key=str)
