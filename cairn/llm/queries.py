"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_language_id": "langid",
    "op2_html_extraction": "htmltext",
    "op3_quality": "quality",
    "op4_sentencepiece": "sptok",
    "op5_mixing": "mixing",
    "op6_toxicity": "toxicity",
    "op7_media": "media",
    "op8_url_filter": "urls",
    "op9_licenses": "licenses",
    "op10_ngram_jaccard": "njaccard",
}

QUERIES = {name: importlib.import_module(f"cairn.llm.{module}").query for name, module in _MODULES.items()}
QUERIES["op5_mixing_whole"] = importlib.import_module("cairn.llm.mixing").whole_query

SQL = {name: importlib.import_module(f"cairn.llm.{_MODULES[name]}").SQL for name in ("op5_mixing", "op10_ngram_jaccard")}
