"""Queries of this package and their SQL checks."""

from __future__ import annotations

import importlib

MODULES = ["ngram_join", "language", "embedding_dedup", "sharding", "topk", "warc", "lm", "bpe", "html_text", "mixing", "resampling", "packing", "whitening"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"emberlake.llm.{name}"), attribute, {})
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
