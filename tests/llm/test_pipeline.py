"""The corpus pipeline, stage by stage, against plain Python; the SQL of the queries."""

import sys
from pathlib import Path

import pytest

import corpus_pipeline
from energylake.llm import pii, quality, simhash
from energylake.llm.oracle import LLM_ORACLE
from energylake.llm.queries import LLM_QUERIES
from energylake.session import stage

from .test_packing import check
from .test_simhash import groups_of

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, documents):
    out = [documents]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], SMALL), f"test-{name}"))
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "pack_sequences"]


def test_columns_of_documents_stay(stages):
    for df in stages[:-1]:
        assert df.columns == COLUMNS


def test_rejected_documents_go(stages):
    kept = {r.row.doc_id for r in quality.quality(stages[0]).filter("kept").collect()}
    assert {tuple(r) for r in stages[1].collect()} == {tuple(r) for r in stages[0].collect() if r.doc_id in kept}
    assert 0 < len(kept) < stages[0].count()


def test_one_of_each_group_stays(stages):
    rows = stages[1].collect()
    root = groups_of(sorted({simhash.fingerprint(r.text) for r in rows}), 4)
    first = {}
    for r in sorted(rows):
        first.setdefault(root[simhash.fingerprint(r.text)], r)
    assert sorted(stages[2].collect()) == sorted(first.values())


def test_no_personal_data_is_left(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    spans = {r.row.doc_id: r.spans for r in pii.report(pii.find(stages[2])).collect()}
    assert any(spans.values())
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert (r.text == before[i].text) == (not spans[i])
        assert r.n_chars == len(r.text)
    assert not any(r.spans for r in pii.report(pii.find(stages[3])).collect())


def test_all_tokens_are_packed(stages):
    rows = stages[4].collect()
    check(rows, [(r.doc_id, r.text) for r in stages[3].collect()], 4096)


def test_run_is_the_stages_in_a_row(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    keys = ["doc_id", "piece", "ids_crc32"]
    assert sorted(got.select(keys).collect()) == sorted(stages[-1].select(keys).collect())


def test_odd_rows_go_through(spark, odd):
    df = odd
    for name, step in corpus_pipeline.STAGES:
        df = stage(step(spark, df, SMALL), f"odd-{name}")
    assert df.count() >= 1


def test_no_rows_go_through(spark, documents):
    df = documents.limit(0)
    for name, step in corpus_pipeline.STAGES:
        df = stage(step(spark, df, SMALL), f"none-{name}")
    assert df.count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_and_sql_agree(spark, name):
    import oracle_check

    con = oracle_check.connect(SMALL)
    got = oracle_check._canonical(LLM_QUERIES[name](spark, SMALL).toPandas())
    want = oracle_check._canonical(con.execute(LLM_ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.astype(str).equals(want.astype(str))


CONTRACT = {
    "op1_html": "page_id bigint, url string, text string, n_chars bigint",
    "op2_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_ppm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_of_the_queries(spark, name):
    got = LLM_QUERIES[name](spark, SMALL)
    assert ", ".join(f"{c} {k}" for c, k in got.dtypes) == CONTRACT[name]
