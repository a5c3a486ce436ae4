"""Every query outside the llm subpackage, by name."""

from __future__ import annotations

from plumbline.operators import adjacency, faces, fits, graph, greedy, labels, linkages, placement, polygons, reviews, solvers, spatial
from plumbline.plans import decisions, extensions, figures, linkage, names, rules, scalars, scoring
from plumbline.streaming import stateful, upsert

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (scoring, linkage, rules, scalars, names, figures, decisions, adjacency, greedy, graph, fits, polygons, solvers, spatial, faces, labels, linkages, placement, reviews, extensions, upsert, stateful):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
