"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import align, drift, html_text, lines, ordinal, pieces, planes, quality_rules, simhash, surrogates, toxicity, urls, winnow

_MODULES = (align, drift, html_text, lines, ordinal, pieces, planes, quality_rules, simhash, surrogates, toxicity, urls, winnow)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
