"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from batchloom.llm.embedding_dedup import ORACLE as EMBEDDING_SQL
from batchloom.llm.embedding_dedup import op6_embedding_graph
from batchloom.llm.filter_audit import ORACLE as AUDIT_SQL
from batchloom.llm.filter_audit import op11_filter_interactions
from batchloom.llm.language_id import op4_language_fusion
from batchloom.llm.minhash import ORACLE as MINHASH_SQL
from batchloom.llm.minhash import op9_minhash_near_dedup
from batchloom.llm.mixing import ORACLE as MIX_SQL
from batchloom.llm.mixing import op7_mix_sources
from batchloom.llm.quality import op10_quality_rules
from batchloom.llm.secret_scan import ORACLE as SECRET_SQL
from batchloom.llm.secret_scan import op8_secret_scan
from batchloom.llm.segment import op5_sample_pieces
from batchloom.llm.sharding import op3_karmarkar_karp_shards
from batchloom.llm.token_alignment import op13_align_tokens
from batchloom.llm.token_counts import op1_token_counts
from batchloom.llm.toxicity import op2_toxicity_chain
from batchloom.llm.web_archive import ORACLE as ARCHIVE_SQL
from batchloom.llm.web_archive import op12_arc_to_warc

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_karmarkar_karp_shards": op3_karmarkar_karp_shards,
    "op4_language_fusion": op4_language_fusion,
    "op5_sample_pieces": op5_sample_pieces,
    "op6_embedding_graph": op6_embedding_graph,
    "op7_mix_sources": op7_mix_sources,
    "op8_secret_scan": op8_secret_scan,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_arc_to_warc": op12_arc_to_warc,
    "op13_align_tokens": op13_align_tokens,
}
ORACLES: dict[str, str] = {
    "op6_embedding_graph": EMBEDDING_SQL,
    "op7_mix_sources": MIX_SQL,
    "op8_secret_scan": SECRET_SQL,
    "op9_minhash_near_dedup": MINHASH_SQL,
    "op11_filter_interactions": AUDIT_SQL,
    "op12_arc_to_warc": ARCHIVE_SQL,
}
