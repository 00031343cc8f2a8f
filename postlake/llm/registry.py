"""The queries of the training-data operators, and SQL for those that SQL can express."""

from postlake.llm import decontamination, filter_audit, merkle, neardup, sharding, topk
from postlake.llm.bpe import op1_byte_bpe
from postlake.llm.chat import op9_chat_format
from postlake.llm.katz import op8_katz_scores
from postlake.llm.secrets import op6_secret_scan
from postlake.llm.simhash import op12_simhash
from postlake.llm.sstable import op4_sstable_ids
from postlake.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_sstable_ids": op4_sstable_ids,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_ring_sharding": sharding.op7_ring_sharding,
    "op8_katz_scores": op8_katz_scores,
    "op9_chat_format": op9_chat_format,
    "op10_pivot_topk": topk.op10_pivot_topk,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_simhash": op12_simhash,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES = {
    "op3_near_duplicates": neardup.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
    "op7_ring_sharding": sharding.oracle_sql(),
    "op10_pivot_topk": topk.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_merkle_manifest": merkle.oracle_sql(),
}
