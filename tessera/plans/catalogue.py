"""All registered queries: importing this module imports every module that registers some."""

from __future__ import annotations

from . import changes, crawling, documents, layout, monitoring, profiles, questions, relational, retrieval, rules, sources, streaming, text, trees, wording
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "changes", "crawling", "documents", "layout", "monitoring", "profiles", "questions", "relational", "retrieval", "rules", "sources", "streaming", "text", "trees", "wording"]
