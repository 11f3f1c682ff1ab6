"""Imports every query module so the registry is complete."""
from __future__ import annotations

from . import q_augment, q_dataset, q_evaluate, q_features, q_misc, q_monitor, q_models, q_sampling, q_smote, q_sources, q_streaming, q_synthesize, q_text, q_tfidf, q_threads  # noqa: F401
from .registry import REGISTRY


def queries():
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql():
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
