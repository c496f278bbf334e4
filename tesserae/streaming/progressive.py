"""Progressive search: results tier by tier, without repeats."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rank
from ..plans.search import RESULT, Engine, progressive
from ..session import cut

__all__ = ["progressive", "stream"]


def stream(engine: Engine, query: str, limit: int = 10) -> Iterator[tuple[str, DataFrame]]:
    """("tier 1" to "tier 3", new rows of that tier) and then ("finished", the whole result).

    The whole query is one term.  A tier gives out documents that no tier before
    it gave out, best score first, as long as fewer than `limit` have been; the
    finished result is the best row of each document by score and tier.
    """
    term = query.strip()
    given: DataFrame | None = None
    found: DataFrame | None = None
    left = limit
    for tier in (1, 2, 3):
        rows = cut(engine.tier(term, tier, limit)) if term else None
        if rows is None:
            break
        found = rows if found is None else found.unionByName(rows)
        new = rows if given is None else rows.join(given, "doc_id", "left_anti")
        out = cut(rank.top(new.drop("rank"), [F.desc("score"), F.asc("doc_id")], max(left, 0)))
        n = out.count()
        left -= n
        ids = out.select("doc_id")
        given = ids if given is None else given.unionByName(ids)
        yield f"tier {tier}", out.select(*RESULT, "title")
    if found is not None:
        best = rank.stream_best(found.drop("rank"))
        yield "finished", rank.top(best, [F.desc("score"), F.asc("tier"), F.asc("doc_id")], limit).select(*RESULT, "title")
