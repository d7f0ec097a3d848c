"""The numbered operators as queries over whole tables."""

from __future__ import annotations

from .attribution import op6_section_tokens
from .chat import op8_chat_formatting
from .decontamination import op7_decontamination
from .extraction import OP12_SQL, op12_html_extraction
from .jaccard import OP10_SQL, op10_jaccard_join
from .mixing import op1_mix_sources
from .packing import op3_token_files
from .quality import OP2_SQL, op2_quality_rules
from .ranking import OP13_SQL, op13_ranked_search
from .secrets import op4_secret_scan
from .sharding import op9_shard_documents
from .spelling import OP11_SQL, op11_spelling_variants
from .toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality_rules, op3_token_files, op4_secret_scan, op5_toxicity, op6_section_tokens, op7_decontamination, op8_chat_formatting, op9_shard_documents, op10_jaccard_join, op11_spelling_variants, op12_html_extraction, op13_ranked_search)}

SQL = {"op2_quality_rules": OP2_SQL, "op10_jaccard_join": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_html_extraction": OP12_SQL, "op13_ranked_search": OP13_SQL}
