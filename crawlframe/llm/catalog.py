"""Registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from crawlframe.llm.bpe import op10_bpe
from crawlframe.llm.collocations import ORACLE_COLLOCATIONS, op12_collocations
from crawlframe.llm.decontaminate import ORACLE_DECONTAMINATION, op13_decontamination
from crawlframe.llm.fingerprint import op6_fingerprint
from crawlframe.llm.html_text import op3_html
from crawlframe.llm.jaccard import ORACLE_JACCARD, op2_ngram_join
from crawlframe.llm.language import op8_language
from crawlframe.llm.mixing import ORACLE_MIX, op1_mixing
from crawlframe.llm.passages import op5_passages
from crawlframe.llm.quality import op9_quality
from crawlframe.llm.trie import ORACLE_TRIE, op11_prefix_trie
from crawlframe.llm.urlfilter import op4_url_filter
from crawlframe.llm.vectors import ORACLE_EMBEDDINGS, op7_embeddings

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_ngram_join": op2_ngram_join,
    "op3_html": op3_html,
    "op4_url_filter": op4_url_filter,
    "op5_passages": op5_passages,
    "op6_fingerprint": op6_fingerprint,
    "op7_embeddings": op7_embeddings,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_decontamination": op13_decontamination,
}

#: Where SQL can express the query.
ORACLE = {
    "op1_mixing": ORACLE_MIX,
    "op2_ngram_join": ORACLE_JACCARD,
    "op7_embeddings": ORACLE_EMBEDDINGS,
    "op11_prefix_trie": ORACLE_TRIE,
    "op12_collocations": ORACLE_COLLOCATIONS,
    "op13_decontamination": ORACLE_DECONTAMINATION,
}
