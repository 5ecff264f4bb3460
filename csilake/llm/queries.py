"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from csilake.llm.bpe import op4_bpe
from csilake.llm.centroids import OP11_SQL, op11_centroids
from csilake.llm.decontaminate import OP8_SQL, op8_decontaminate
from csilake.llm.html_text import op2_html_text
from csilake.llm.lm_score import op7_lm_score
from csilake.llm.near_dups import OP5_SQL, op5_near_dups
from csilake.llm.phrase_dedup import OP13_SQL, op13_phrase_dedup
from csilake.llm.secrets import OP3_SQL, op3_secrets
from csilake.llm.sharding import op10_sharding
from csilake.llm.suffix_dedup import op1_suffix_dedup
from csilake.llm.syncmers import op9_syncmers
from csilake.llm.token_alignment import op12_token_alignment
from csilake.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_html_text, op3_secrets, op4_bpe, op5_near_dups, op6_toxicity, op7_lm_score, op8_decontaminate, op9_syncmers, op10_sharding, op11_centroids, op12_token_alignment, op13_phrase_dedup)}
QUERIES["pipeline"] = corpus_pipeline.run

#: Of what SQL can say whole; the tests hold the other operators against brute-force versions.
ORACLE = {"op3_secrets": OP3_SQL, "op5_near_dups": OP5_SQL, "op8_decontaminate": OP8_SQL, "op11_centroids": OP11_SQL, "op13_phrase_dedup": OP13_SQL}
