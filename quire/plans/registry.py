"""All queries of the library, each with the SQL that gives the same rows."""

from __future__ import annotations

from quire.plans import alignments, audits, changes, entities, forced, intake, linking, listening, preparation, quality, reimports, retrieval, search, segments, sources, streams, synchrony, timelines, titles, transcripts, upkeep, vectors  # noqa: F401
from quire.plans.base import QUERIES, SQL, Query

FLAGSHIP: Query = QUERIES["rag_chunks"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
