"""The pipeline's stages on a small table, each against plain Python, and its rows against its own stages."""

from __future__ import annotations

import zlib

import corpus_pipeline
import pytest
from test_dedup import brute_jaccard, brute_lines, brute_suffix, key

from shardwise.llm import queries


@pytest.fixture(scope="module")
def docs(messy):
    return messy[1].select("doc_id", "text", "lang", "source", "n_chars")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_lines_stage(spark, docs, sf_dir):
    out = corpus_pipeline.boilerplate_lines(spark, docs, sf_dir)
    want = brute_lines(rows_of(docs), 10)
    assert out.columns == docs.columns
    assert sorted([(r[0], r[1]) for r in rows_of(out)], key=key) == sorted([(w[0], w[1]) for w in want], key=key)
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert sorted([(r[0], r[2], r[3]) for r in rows_of(out)], key=key) == sorted([(r[0], r[2], r[3]) for r in rows_of(docs)], key=key)


def test_near_duplicates_stage(spark, docs, sf_dir):
    rows = rows_of(docs)
    out = rows_of(corpus_pipeline.near_duplicates(spark, docs, sf_dir))
    component = {w[0]: w[2] for w in brute_jaccard(rows, 5, 80)}
    want = {r[:2] for r in rows if r[0] is None or component[r[0]] == r[0]}
    assert sorted([r[:2] for r in out], key=key) == sorted(want, key=key)
    assert len(out) < len(rows) - 20


def test_strings_stage(spark, docs, sf_dir):
    out = corpus_pipeline.repeated_strings(spark, docs, sf_dir)
    plain = {(w[0], w[1]): w for w in brute_suffix(rows_of(docs))}
    assert out.columns == docs.columns and out.count() == docs.count()
    before = {(r[0], len((r[1] or "").encode())): r for r in rows_of(docs)}
    for (i, n), w in plain.items():
        if w[2] == 0:  # nothing repeated: unchanged
            assert any(r[0] == i and r[1] == (before[i, n][1] or "") for r in rows_of(out.where(out.doc_id.eqNullSafe(i))))
            break
    left = sum(len(r.text.encode()) for r in out.collect())
    assert 0 <= left - sum(w[1] - w[2] for w in brute_suffix(rows_of(docs))) < 4 * docs.count()


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == first.columns and out.dtypes == first.dtypes, name
        assert 0 < out.count() <= docs.count()
        docs = out
    got = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in got} == set(kept)
    from shardwise.llm.packing import encoder

    memory = encoder(queries.PACK_VOCABULARY, queries.PATTERN)
    for r in got:
        ids = memory.texts([kept[r.doc_id]])[0] + b"\0\0\0\0"
        part = ids[4 * r.start : 4 * (r.start + r.length)]
        assert bytes(r.ids) == part and r.ids_crc32 == zlib.crc32(part)


def test_stages_keep_columns_of_any_name(spark, messy, sf_dir):
    """The names that operators use inside come through every stage with their values; nulls, empty and very long texts too."""
    docs = messy[1]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        others = [c for c in docs.columns if dict(docs.dtypes)[c] == "string" and c not in ("text", "lang", "source")]
        assert len(others) > 10 and {v for r in out.select(*others).distinct().collect() for v in r} == {"clash"}
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_stages_take_an_empty_table(spark, nothing, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0


def test_workers_remember_nothing_after_packing(spark, sf_dir):
    """Python workers stay when a stage is over; what packing has encoded does not stay in them."""
    import sys

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(8)
    assert corpus_pipeline.pack_sequences(spark, docs, sf_dir).count() >= docs.count()

    def held(batches):
        import pyarrow as pa

        for batch in batches:
            kept = vars(sys.modules["llm_worker_store"]).values() if "llm_worker_store" in sys.modules else []
            n = sum(len(k.inner) + len(k.first) for k in kept if hasattr(k, "inner"))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([len(list(kept))], pa.int64())], ["n", "stores"])

    rows = spark.range(0, 16, 1, 16).mapInArrow(held, "n long, stores long").collect()
    assert max(r.stores for r in rows) > 0  # some of the same workers answer
    assert max(r.n for r in rows) == 0
