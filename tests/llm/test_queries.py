"""The registered queries over whole test tables, with SQL where there is some."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered
from roundledger.llm import queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))

# The columns each query must return.
COLUMNS = {
    "op1_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op2_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op3_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_mix_sources": "doc_id size source_size target taken",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words "
    "base_failed kept",
    "op6_quality_classifier": "doc_id held_out score predicted",
    "op7_html_extraction": "page_id url text n_chars",
    "op8_url_filter": "page_id host path rule verdict",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_repeated_passages": "doc_id start_word end_word source_id identity",
    "op11_structure_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op12_embedding_near_dedup": "vec_id n_links component_id kept",
    "op13_spelling_variants": "word form root n n_near form_n",
}


def test_all_are_registered():
    assert COLUMNS.keys() == queries.QUERIES.keys()
    assert COLUMNS.keys() | {"pipeline"} <= registered.queries().keys()
    assert set(queries.ORACLES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    table = queries.QUERIES[name](spark, str(DATA)).toArrow()
    assert set(COLUMNS[name].split()) <= set(table.column_names)
    assert table.num_rows > 0
    with duckdb.connect() as duck:
        for file in DATA.glob("*.parquet"):
            duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        if name in queries.ORACLES:
            duck.register("got", table)
            columns = ", ".join(table.column_names)
            expected = duck.sql(queries.ORACLES[name]).to_arrow_table()
            duck.register("wanted", expected)
            for a, b in (("got", "wanted"), ("wanted", "got")):
                rest = f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}"
                assert duck.sql(rest).fetchall() == []
        elif "doc_id" in table.column_names and name not in ("op9_packing", "op10_repeated_passages"):
            rows = duck.sql("SELECT doc_id FROM documents ORDER BY 1").fetchall()
            assert sorted(table["doc_id"].to_pylist()) == [r[0] for r in rows]
