"""The registered queries over a small corpus: columns, rows, and SQL where there is some."""

import duckdb
import pytest

from folioscan.llm.queries import ORACLE_SQL, QUERIES

FIRST = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op4_lm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_language": "page_id host declared text_lang lang posterior",
    "op6_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_licence_scan": "doc_id paragraph family probability template overlap",
    "op8_token_files": "doc_id start n_tokens ids_crc32",
    "op9_benchmark_decontamination": "doc_id n_items first_item n_equal",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op11_conversation_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op13_grouped_ranking_ties": "vendor_id part month pos place sale_id line_no quantity percent amount_cents tied",
    "base2_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256",
    "base4_lm_scores": "doc_id held_out n_tokens n_known train_tokens base_score",
    "base10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed",
}
PER_DOCUMENT = ("op1_", "op2_", "op3_", "op4_", "op8_", "op10_", "op12_", "base")


def test_all_are_there():
    assert set(QUERIES) == set(FIRST) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(FIRST))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = FIRST[name].split()
    assert df.columns[: len(columns)] == columns
    rows = df.collect()
    assert rows
    if name.startswith(PER_DOCUMENT):
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    if name not in ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "sale_lines"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in names) for r in rows), key=key) == sorted(result.fetchall(), key=key)
