"""Thresholds of the analysis rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    # The defaults that results depend on.
    chunk_size: int = 400
    chunk_overlap: int = 60
    whole_document_words: int = 3000
    context_radius: int = 40
    fs_created_confidence: float = 0.35
    fs_modified_confidence: float = 0.25
    meta_created_confidence: float = 0.70
    meta_modified_confidence: float = 0.55
    content_explicit_confidence: float = 0.85
    content_relative_confidence: float = 0.60
    content_year_confidence: float = 0.45
    least_year: int = 1970
    most_year: int = 2100
    min_key_chars: int = 6
    filename_confidence: float = 0.90
    title_confidence: float = 0.75
    entity_confidence: float = 0.55
    edge_floor: float = 0.5
    max_entity_artifacts: int = 4
    recency_window_days: int = 90
    small_corpus: int = 6
    cluster_similarity: float = 0.8
    cluster_min_points: int = 3
    current_threshold: float = 0.6
    superseded_threshold: float = 0.4
    single_signal_confidence: float = 0.6
    small_corpus_cap: float = 0.35
    min_confident_label: float = 0.3
    gap_few_threshold: int = 2
    gap_zero_confidence: float = 0.9
    gap_few_confidence: float = 0.7
    promise_no_later_confidence: float = 0.55
    promise_judged_cap: float = 0.65
    promise_unjudged_confidence: float = 0.35
    promise_overlap: float = 0.6
    promise_merge_gap: int = 20
    promise_radius: int = 200
    template_min_confidence: float = 0.5
    name_chars: int = 80
    table_rows: int = 50
    table_chars: int = 20_000


RULES = Rules()
