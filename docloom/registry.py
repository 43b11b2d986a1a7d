"""All queries of the library but those of the llm folder, with their SQL."""

from docloom.operators import accounting, contexts, discovery, evidence, evidence_runs, fields, folds, grounding, joins, lines, metrics, origins, pages, quotes, ranking, reconcile, records, regions, rendering, scores, segmentation, sweeps, versions

_MODULES = (lines, folds, pages, evidence, quotes, joins, metrics, reconcile, ranking, records, versions, accounting, discovery, segmentation, regions, contexts, evidence_runs, sweeps, origins, fields, grounding, scores, rendering)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
FLAGSHIP = "line_stats_by_lang"
