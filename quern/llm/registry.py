"""Queries of this folder, and SQL where it can express them."""

from quern.llm import divergence, embedding_dedup, exact_copies, importance, mixing, quality_rules
from quern.llm.divergence import op11_source_divergence
from quern.llm.embedding_dedup import op10_embedding_dedup
from quern.llm.exact_copies import op12_exact_copies
from quern.llm.html_text import op2_html_text
from quern.llm.importance import op13_importance
from quern.llm.language_id import op8_language_id
from quern.llm.mixing import op5_mixing
from quern.llm.packing import op9_packing
from quern.llm.pii import op6_pii
from quern.llm.quality_rules import op3_quality_rules
from quern.llm.simhash_dedup import op7_simhash_dedup
from quern.llm.suffix_dedup import op1_suffix_dedup
from quern.llm.toxicity import op4_toxicity

_OPERATORS = (op1_suffix_dedup, op2_html_text, op3_quality_rules, op4_toxicity, op5_mixing, op6_pii, op7_simhash_dedup, op8_language_id, op9_packing, op10_embedding_dedup, op11_source_divergence, op12_exact_copies, op13_importance)
QUERIES = {f.__name__: f for f in _OPERATORS}

ORACLES = {"op3_quality_rules": quality_rules.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op10_embedding_dedup": embedding_dedup.ORACLE_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op12_exact_copies": exact_copies.ORACLE_SQL, "op13_importance": importance.ORACLE_SQL}
