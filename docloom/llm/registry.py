"""The queries of this folder and their SQL."""

from . import ann, decontaminate, langid, licenses, linededup, mixing, phrases, simhash, substrings, surrogates, url_rules, vecdedup, wrappers

_MODULES = (ann, substrings, wrappers, licenses, surrogates, mixing, url_rules, decontaminate, langid, simhash, vecdedup, linededup, phrases)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
