"""Order of pipeline stages: what a request needs, what follows from it, and what an import replaces."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Stages by phase, in their order; what each one invalidates; what must run before; what an import replaces.
STAGES = ["eco_load", "eco_chunk", "eco_export_chunks", "eco_embed", "eco_import_embed", "eco_tokenize", "eco_vector_index", "eco_bm25_index", "bench_load", "bench_embed", "bench_import_embed", "bench_export_queries", "bench_tokenize"]
FOLLOWS = {
    "eco_load": ["eco_chunk"], "eco_chunk": ["eco_embed"], "eco_embed": ["eco_vector_index", "eco_tokenize"],
    "eco_import_embed": ["eco_vector_index", "eco_tokenize"], "eco_tokenize": ["eco_bm25_index"],
    "bench_load": ["bench_embed"], "bench_embed": ["bench_tokenize"], "bench_import_embed": ["bench_tokenize"],
}
NEEDS = {"eco_export_chunks": ["eco_load", "eco_chunk"], "bench_export_queries": ["bench_load"]}
REPLACES = {"eco_import_embed": "eco_embed", "bench_import_embed": "bench_embed"}


def resolve(requested: Iterable[str]) -> list[str]:
    requested = list(requested)
    open_, needed = list(requested), {n for s in requested for n in NEEDS.get(s, ())}
    reached: set[str] = set()
    while open_:
        stage = open_.pop()
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage}")
        if stage not in reached:
            reached.add(stage)
            open_ += FOLLOWS.get(stage, ())  # what is there as a mere need pulls nothing in
    replaced = {REPLACES[s] for s in requested if s in REPLACES}
    return [s for s in STAGES if s in (reached | needed) - replaced]


def run(requested: Iterable[str], steps: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Results by stage, in order."""
    return {stage: steps[stage]() for stage in resolve(requested) if stage in steps}
