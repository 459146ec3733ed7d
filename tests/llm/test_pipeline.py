"""The stages against plain versions, each on its own input, and the queries' schemas."""

import duckdb
import pytest
from test_copies import plain_fingerprint, plain_groups
from test_scans import plain_hits

import __spark_entry__ as contract
import corpus_pipeline
from broodspark.llm.queries import QUERIES, SQL
from checks.run import canonical, database

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, sf_dir):
    """Every stage keeps what a plain version keeps of what came in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(str(i), t) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            rows = out.collect()
            tokens = {r.doc_id: r.doc_tokens for r in rows}
            assert tokens.keys() == before.keys() and sum(r.length for r in rows) == sum(tokens.values())
            continue
        assert out.columns == COLUMNS
        out = spark.createDataFrame(out.collect(), docs.schema)
        after = {r.doc_id: r.text for r in out.collect()}
        assert after.items() <= before.items()
        if name == "toxicity":
            score = {r.doc_id: r.predicted for r in QUERIES["op2_toxicity"](spark, sf_dir).collect()}
            assert after.keys() == {d for d in before if not score[d]}
        elif name == "exact_dedup":
            assert sorted(after) == sorted({t: d for d, t in sorted(before.items())}.values())
        elif name == "simhash_near_dedup":
            groups = plain_groups([(d, plain_fingerprint(t)) for d, t in before.items()])
            assert after.keys() == {c for _, _, c in groups}
        else:
            hits = {d: plain_hits(t, items, 13) for d, t in before.items()}
            assert after.keys() == {d for d, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}
        assert after and len(after) <= len(before)
        docs, before = out, after


def test_run_equals_its_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.count() > 0


def test_stages_of_a_messy_table(messy, nothing, spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy, sf_dir).count() > 0
        assert stage(spark, nothing, sf_dir).count() == 0


SCHEMAS = {
    1: "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    2: "doc_id bigint, held_out boolean, score double, predicted int",
    3: "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    4: "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    5: "doc_id bigint, held_out boolean, score double, predicted int",
    6: "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    7: "doc_id bigint, held_out boolean, lang_pred string, score double",
    8: "doc_id bigint, fingerprint string, component_id bigint",
    9: "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    10: "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
}


@pytest.mark.parametrize("number", SCHEMAS)
def test_query_columns(spark, sf_dir, number):
    (name,) = (n for n in contract.queries() if n.startswith(f"op{number}_"))
    frame = QUERIES[name](spark, sf_dir)
    wanted = [tuple(c.split()) for c in SCHEMAS[number].split(", ")]
    assert set(wanted) <= set(frame.dtypes)
    if number != 6:
        assert frame.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("name", SQL)
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    theirs = database(sf_dir).execute(SQL[name]).df()
    assert canonical(QUERIES[name](spark, sf_dir).toPandas()).equals(canonical(theirs))
