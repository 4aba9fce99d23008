from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_packing import assert_packed
from test_quality import plain_measures
from test_shingles import plain_kept

import corpus_pipeline as pipeline
from tesora.llm import mixing, quality
from tesora.llm.base import BATCH_BYTES, documents, small_batches, write_shared

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="shared tables are absent")


@pytest.fixture(scope="module")
def steps(spark):
    docs = documents(spark, SMALL)
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(spark.read.parquet(write_shared(stage(spark, out[-1], SMALL), f"test_{name}")))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_all_but_the_last_return_documents(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    counts = [s.count() for s in steps]
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0


def test_quality_keeps_what_a_plain_version_keeps(spark, steps):
    model = quality.fit(steps[0], quality.labels_of(spark, SMALL))
    want = []
    for r in steps[0].collect():
        n, *_, repeated = plain_measures(r.text)
        grams = quality.gram_buckets((r.text or "").encode(), len(model.ratio) // 2)
        score = sum(float(model.ratio[g]) for g in grams) / max(1, len(grams))
        if n >= 20 and 100 * repeated <= 30 * n and score >= model.threshold - 1e-9:
            want.append(tuple(r))
    assert rows_of(steps[1]) == sorted(want, key=str)


def test_language_keeps_documents_of_one_language(steps):
    assert set(rows_of(steps[2])) <= set(rows_of(steps[1]))
    assert steps[2].count() >= 0.98 * steps[1].count()


def test_one_of_each_group_stays(steps):
    want = plain_kept([(r.doc_id, r.text) for r in steps[2].collect()])
    assert sorted(r.doc_id for r in steps[3].collect()) == want


def test_the_mix_follows_its_sql(steps):
    con = duckdb.connect()
    con.register("documents", steps[3].toPandas())
    want = {r[0]: (r[1], r[4]) for r in con.execute(mixing.OP10_SQL).fetchall()}
    copies = {}
    for r in steps[4].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {d: taken // size for d, (size, taken) in want.items() if taken}


def test_all_tokens_are_packed(steps):
    rows = steps[5].collect()
    found = assert_packed(rows, 2048)
    assert len(found) <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1
    assert {r.doc_id for r in rows} == {r.doc_id for r in steps[4].collect()}


def test_every_stage_takes_awkward_and_empty_tables(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.count() <= 2 * docs.count() + 200 if name == "best_fit" else out.columns == docs.columns


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"].__wrapped__ is pipeline.run
    assert {f"op{n}" for n in range(1, 14)} <= {name.split("_")[0] for name in entry.queries()}
    assert pipeline.run(spark, SMALL).count() > 0


@pytest.fixture
def batch_setting(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    yield name
    spark.conf.unset(name)


def batch_sizes(docs):
    """(bytes, rows) of the batches that Python gets."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    return [tuple(r) for r in docs.mapInArrow(run, "size long, n long").collect()]


def test_stages_send_whole_texts_to_python_in_small_batches(spark, awkward, batch_setting):
    docs = spark.range(150, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('x', IF(id = 70, 9, 1) * 1000000)").alias("text"))
    for name, stage in pipeline.STAGES:
        if name == "mixing_sources":  # has no Python
            continue
        spark.conf.unset(batch_setting)
        stage(spark, awkward, SMALL)
        assert int(spark.conf.get(batch_setting)) == BATCH_BYTES, name
    sizes = batch_sizes(docs)
    assert sum(n for _, n in sizes) == 150 and sum(size for size, _ in sizes) >= 158_000_000
    assert max(size for size, _ in sizes) <= BATCH_BYTES + 9_001_000
    assert sorted(size for size, _ in sizes)[-2] <= BATCH_BYTES + 1_001_000


def test_a_session_keeps_its_own_size_of_batches(spark, batch_setting):
    spark.conf.set(batch_setting, "1m")
    small_batches(spark)
    assert spark.conf.get(batch_setting) == "1m"
