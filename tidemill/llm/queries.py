"""The named queries of this package and their DuckDB check SQL."""

from __future__ import annotations

from tidemill.llm.balltree import op12_ranked_search
from tidemill.llm.bpe import op13_bpe
from tidemill.llm.chat import op9_chat_snapshots
from tidemill.llm.decontaminate import op2_decontaminate
from tidemill.llm.html_text import op10_html_text
from tidemill.llm.jaccard import op7_ngram_jaccard_join
from tidemill.llm.lloyd import op11_vector_codes
from tidemill.llm.mixing import op6_source_mix
from tidemill.llm.pii import op3_pii
from tidemill.llm.quality import op4_quality_rules
from tidemill.llm.secret_scan import op5_secret_scan
from tidemill.llm.sql import SQL
from tidemill.llm.token_counts import op8_token_counts
from tidemill.llm.warc import op1_warc

QUERIES = {q.__name__: q for q in (
    op1_warc, op2_decontaminate, op3_pii, op4_quality_rules, op5_secret_scan, op6_source_mix, op7_ngram_jaccard_join,
    op8_token_counts, op9_chat_snapshots, op10_html_text, op11_vector_codes, op12_ranked_search, op13_bpe,
)}

__all__ = ["QUERIES", "SQL"]
