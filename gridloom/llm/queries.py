"""All queries of this subpackage; importing a module registers its query."""

from gridloom.llm import (  # noqa: F401
    exact_dedup,
    filteraudit,
    fingerprints,
    jaccard_join,
    langid,
    mixing,
    packing,
    pieces,
    quality,
    sourceaudit,
    toxicity,
    urlrules,
    warc,
)
from gridloom.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
