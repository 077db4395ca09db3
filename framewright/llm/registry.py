"""The queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from framewright.llm.decontam import op6_decontaminate
from framewright.llm.embeddings import op9_embeddings
from framewright.llm.html import op10_html
from framewright.llm.langid import op3_language
from framewright.llm.mixing import op5_mix
from framewright.llm.passages import op7_substring
from framewright.llm.pii import op2_pii
from framewright.llm.pitman_yor import op4_pitman_yor
from framewright.llm.quality import op1_quality
from framewright.llm.simhash import op8_simhash

QUERIES = {f.__name__: f for f in (op1_quality, op2_pii, op3_language, op4_pitman_yor, op5_mix, op6_decontaminate, op7_substring, op8_simhash, op9_embeddings, op10_html)}

#: None of the ten can be expressed in SQL (fitted models, permutations, sampling, parsers): tests/llm holds them
#: against brute-force versions, held-out labels and round trips.
ORACLE_SQL: dict[str, str] = {}
