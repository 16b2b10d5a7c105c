"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from quernstone.llm.decontam import SQL as BENCHMARK_SQL
from quernstone.llm.decontam import op7_decontamination
from quernstone.llm.jaccard import SQL as JACCARD_SQL
from quernstone.llm.jaccard import op6_ngram_jaccard_join
from quernstone.llm.langid import op8_language_id
from quernstone.llm.linededup import SQL as LINES_SQL
from quernstone.llm.linededup import op3_line_dedup
from quernstone.llm.lm import op1_lm_scoring
from quernstone.llm.mixing import SQL as MIXING_SQL
from quernstone.llm.mixing import op5_mixing
from quernstone.llm.simhash import op4_document_fingerprints
from quernstone.llm.surrogates import op2_pii_surrogates
from quernstone.llm.toxicity import op9_toxicity
from quernstone.llm.urls import SQL as URLS_SQL
from quernstone.llm.urls import op10_url_filters

QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_pii_surrogates, op3_line_dedup, op4_document_fingerprints, op5_mixing, op6_ngram_jaccard_join, op7_decontamination, op8_language_id, op9_toxicity, op10_url_filters)}
ORACLES = {"op3_line_dedup": LINES_SQL, "op5_mixing": MIXING_SQL, "op6_ngram_jaccard_join": JACCARD_SQL, "op7_decontamination": BENCHMARK_SQL, "op10_url_filters": URLS_SQL}
