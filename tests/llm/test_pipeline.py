"""The pipeline's stages, on odd rows and against brute force, and the queries' contracts."""

import re
from pathlib import Path

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.compare import differences, views

from tests.llm.test_operators import frame, odd_rows
from sprucelake.llm import common, decontaminate, minhash, queries

STAGES = dict(corpus_pipeline.STAGES)


def test_order():
    assert list(STAGES) == ["toxicity", "exact_dedup", "minhash", "decontamination", "sentencepiece"]


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_odd_rows(spark, sf, name):
    docs = frame(spark, odd_rows()).withColumnRenamed("name", "lang").withColumnRenamed("key", "source")
    out = STAGES[name](spark, docs, sf)
    if name != "sentencepiece":
        assert out.columns == docs.columns
    assert 0 < out.count() <= docs.count()
    assert STAGES[name](spark, docs.where("false"), sf).count() == 0


def test_exact_stage_keeps_one_of_each(spark, sf):
    rows = odd_rows()
    out = STAGES["exact_dedup"](spark, frame(spark, rows), sf).collect()
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    assert len(out) == len({lower(t) for _, t in rows}) == len({lower(r["text"]) for r in out})


def test_rows_without_id_are_filtered_too(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    same = " ".join(f"word{i}" for i in range(90))
    rows = [(5, same), (None, same + " more"), (None, "and " + same), (None, f"before {item} behind"), (None, "clean words of no use"), (None, None), (2**62 + 5, "far away"), (None, "second row of clean words")]
    assert STAGES["minhash"](spark, frame(spark, [*rows, (2**63 - 1, "farther"), (-(2**40), "less")]), sf).where("doc_id is null").count() in (4, 5)
    docs = frame(spark, rows)
    near = STAGES["minhash"](spark, docs, sf)
    assert near.columns == docs.columns and near.schema["doc_id"] == docs.schema["doc_id"]
    assert sorted((r["text"] or "") for r in near.collect()) == sorted(t or "" for i, t in rows if same not in (t or "") or i)
    clean = STAGES["decontamination"](spark, docs, sf).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in clean) == sorted((i or 0, t or "") for i, t in rows if item not in (t or ""))


def test_columns_of_any_name_are_carried(spark, sf):
    names = ["own_sha", "copy_id", "copy_sha", "copy_kept", "gone", "Pieces", "with.dot", "c0"]
    docs = frame(spark, [(1, "some words of a text"), (2, "Some words of a text"), (3, "other words"), (None, "no id")]).select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in STAGES.items():
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all(tuple(r)[2:10] == tuple(range(8)) for r in out.collect()), name


def test_near_stage_keeps_one_of_each(spark, sf):
    docs = frame(spark, odd_rows())
    kept = {r["doc_id"] for r in STAGES["minhash"](spark, docs, sf).collect()}
    groups = minhash.near_groups(docs).collect()
    assert kept == {r["doc_id"] for r in groups if r["kept"]} and not kept & {r["doc_id"] for r in groups if not r["kept"]}


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in out}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    leaks = {r["doc_id"] for r in decontaminate.overlaps(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert len(ids) == len(out) and not ids & leaks and all(r["pieces"]["back"] and r["text"] for r in out) and len(out) > 0.5 * docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, name):
    assert differences(queries.QUERIES[name](spark, sf), views(sf), queries.ORACLE[name]) == ""


def test_a_worker_gives_memory_back_after_a_task():
    """A memo of 140 MB below something that stays: without giving back, all of it stays with the worker."""
    held, kept = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]), []

    def work(batches):
        memo = [bytes(700) for _ in range(200_000)]
        kept.append(bytes(700))
        yield from batches
        assert len(memo) and held() > before + 100_000

    before = held()
    rows = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert list(common.tidy(work)([rows, rows])) == [rows, rows]
    assert held() < before + 50_000
