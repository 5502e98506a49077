"""Tunable weights and limits, and their merging."""

from __future__ import annotations

import copy
import json

#: The defaults of ranking.
DEFAULTS: dict = {
    "bm25": {"k1": 1.5, "b": 0.75},
    "synonyms": {},
    "search": {
        "weights": {"bm25": 0.35, "ngram": 0.15, "embedding": 0.35, "field_boost": 0.10, "exact_match_boost": 0.05, "recency_boost_max": 0.05},
        "candidate_limits": {"bm25": 50, "ngram": 50, "vector": 50, "merged_max": 100},
        "field_boosts": {"title": 0.30, "filename": 0.25, "folder": 0.20, "heading": 0.15, "body": 0.05},
        "field_boost_cap": 0.35,
        "expanded_share": 0.6,
        "exact_phrase_boost": 0.05,
        "compact_exact_phrase_boost": 0.03,
        "exact_boost_cap": 0.08,
    },
    "v2": {"lexical": 0.45, "vector": 0.30, "hit": 0.15, "ngram": 0.05, "recency": 0.05},
    "intent": {
        "access_info": {"top_k": 3, "candidate_k": 25, "max_context_chars": 1100, "snippets_per_chunk": 2},
        "account_info": {"top_k": 3, "candidate_k": 25, "max_context_chars": 1200, "snippets_per_chunk": 2},
        "report": {"top_k": 4, "candidate_k": 30, "max_context_chars": 2000, "snippets_per_chunk": 3},
        "troubleshooting": {"top_k": 5, "candidate_k": 35, "max_context_chars": 2800, "snippets_per_chunk": 3},
        "feature_explanation": {"top_k": 5, "candidate_k": 35, "max_context_chars": 2500, "snippets_per_chunk": 3},
        "summary": {"top_k": 8, "candidate_k": 40, "max_context_chars": 4000, "snippets_per_chunk": 2},
        "general_search": {"top_k": 5, "candidate_k": 40, "max_context_chars": 2200, "snippets_per_chunk": 2},
    },
}


def merged(base: dict, changes: dict) -> dict:
    """`base` with `changes`: dicts are merged in depth, anything else is replaced."""
    out = copy.deepcopy(base)
    for k, v in changes.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(path: str) -> dict:
    """The defaults with the changes of a JSON file; a missing file changes nothing."""
    try:
        with open(path, encoding="utf-8") as f:
            return merged(DEFAULTS, json.load(f))
    except FileNotFoundError:
        return copy.deepcopy(DEFAULTS)


def save(path: str, settings: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f, ensure_ascii=False, indent=2)
