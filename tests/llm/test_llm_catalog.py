"""The registered queries: one for each operator and the pipeline, and the SQL of those that have it."""

import math

import duckdb
import pytest

import __spark_entry__
from gridlens.llm import catalog

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = list(catalog.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 14)), "pipeline"]
    assert set(names) <= set(__spark_entry__.queries()) and set(catalog.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_and_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    result = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    plain = lambda v: "~" if v is None or isinstance(v, float) and math.isnan(v) else str(v)
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert sorted(tuple(map(plain, r)) for r in catalog.queries()[name](spark, SF).select(*columns).collect()) == want


COLUMNS = {
    "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op4_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_html": "page_id url text n_chars",
    "op7_caps": "vec_id n_links component_id kept",
    "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9_jaccard": "doc_id n_shingles component_id",
    "op10_linededup": "doc_id text n_lines n_removed",
    "op11_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op12_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13_search": "item_id rank doc_id score",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_of_the_results(spark, name):
    assert set(COLUMNS[name].split()) <= set(catalog.queries()[name](spark, SF).columns)
