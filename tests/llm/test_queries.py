"""Registered queries run on a test table and return their contract's columns."""

import pytest

from shelfspark.llm import queries

COLUMNS = {
    "op2_quality": {"doc_id", "held_out", "score", "predicted"},
    "op3_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op4_minhash_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op5_source_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op7_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op8_order_minhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op9_language_model": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op10_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op11_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    assert COLUMNS[name] <= set(found.columns)
    assert found.count() == queries.documents(spark, sf_dir).count()
