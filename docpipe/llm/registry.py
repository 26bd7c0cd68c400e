"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import conversation_repair, decontaminate, embedding_dedup, jaccard, license_scan, resample, sentencepieces, sharding, token_counts, token_files, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_token_files": token_files.op3_token_files,
        "op4_warc": warc.op4_warc,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_license": license_scan.op7_license,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_sharding": sharding.op9_sharding,
        "op10_sentencepiece": sentencepieces.op10_sentencepiece,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_resample": resample.op12_resample,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": embedding_dedup.OP1_SQL, "op2_url_filter": url_filter.OP2_SQL, "op4_warc": warc.OP4_SQL, "op6_decontaminate": decontaminate.OP6_SQL, "op8_jaccard": jaccard.OP8_SQL, "op12_resample": resample.OP12_SQL, "op13_conversation_repair": conversation_repair.OP13_SQL}
