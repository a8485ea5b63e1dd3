"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from siftmill.llm import collocations, embedding_dedup, exact_dedup, hard_negatives, html_extract, langid, mixing, near_dedup, packing, pii, quality, token_counts, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_quality": quality.op3_quality,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_warc": warc.op6_warc,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_packing": packing.op9_packing,
    "op10_langid": langid.op10_langid,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_pii": pii.op12_pii,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_near_dedup": near_dedup.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_embedding_dedup": embedding_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
