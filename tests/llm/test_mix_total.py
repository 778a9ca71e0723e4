import os

import pytest

from tallyweave.llm import merge_replay as mr
from tallyweave.llm.plans import p7_mix, p7_shares, p7_tempered_shares

needs_file = pytest.mark.skipif(not os.path.exists(os.path.join(mr.TOKENIZER_DIR, "byte_bpe_50k.json")), reason="no tokenizer file")


@needs_file
def test_total_is_of_all_documents_also_those_without_source(spark, tmp_path):
    text = "Hello world, hello!"
    docs = [(i, text, None if i % 3 == 0 else "mail") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("m", 1.0, "mail", 1.0, 2)], "mix_name string, corpus_multiple double, source string, target_weight double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    one = mr.token_counts(spark, spark.createDataFrame([(0, text)], "doc_id long, text string")).first()["n_tokens"]
    draws = p7_mix(spark, str(tmp_path)).collect()
    assert sum(r.repeats for r in draws) == 30 and all(r.source == "mail" and 1 <= r.repeats <= 2 for r in draws)
    for query in (p7_shares, p7_tempered_shares):
        r = query(spark, str(tmp_path)).first()
        assert (r.target_tokens, r.actual_tokens) == (30 * one, 30 * one)
