"""The retrieval pipeline: scoped arms, threshold, turns among sources, character budget."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..config import Retrieval
from ..sources.scratch import Scratch, small
from .knn import Arm, scan
from .ranking import char_budget, positioned, round_robin, threshold

#: Bytes of link identifiers that one automaton holds; more links take more passes over a path.
LINK_BYTES = 16 << 20


def linked_scopes(path: Column, links: DataFrame) -> Column:
    """Sorted array of the workspaces that a chunk's path is linked to. links (workspace, identifier): the path contains the identifier.

    Identifiers go to the tasks in blocks of bounded size, and each task makes one automaton of a block, so that a path is read
    once for all of them; the plan has one expression a block, however many links there are. An empty identifier is in every
    path; null ones, and null paths, link nothing.
    """
    rows = links.where("workspace IS NOT NULL AND identifier IS NOT NULL").select("workspace", F.replace("identifier", F.lit("\\"), F.lit("/")).alias("identifier")).distinct()
    blocks = [_matcher(block)(path) for block in _link_blocks(rows.orderBy("identifier", "workspace").toLocalIterator())]
    if not blocks:
        return F.array().cast("array<string>")
    return blocks[0] if len(blocks) == 1 else F.array_sort(F.array_distinct(F.flatten(F.array(*blocks))))


def _link_blocks(rows: Iterator[Row]) -> Iterator[dict[str, list[str]]]:
    """Workspaces by identifier, as many as one automaton holds."""
    held: dict[str, list[str]] = {}
    size = 0
    for r in rows:
        held.setdefault(r["identifier"], []).append(r["workspace"])
        size += len(r["identifier"]) + len(r["workspace"])
        if size >= LINK_BYTES:
            yield held
            held, size = {}, 0
    if held:
        yield held


def _matcher(names: dict[str, list[str]]):
    @F.arrow_udf(Ty.ArrayType(Ty.StringType()))
    def scopes(paths: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = ahocorasick.Automaton()
        for name, workspaces in names.items():
            if name:
                find.add_word(name, workspaces)
        always = names.get("", [])
        if len(find):
            find.make_automaton()
        for batch in paths:
            known: dict[str | None, list[str]] = {None: []}
            for p in batch.unique().to_pylist():  # many chunks are of one path
                if p is not None:
                    hits = (w for _, some in (find.iter(p) if len(find) else ()) for w in some)
                    known[p] = sorted({*always, *hits})
            yield pa.array([known[p] for p in batch.to_pylist()], pa.list_(pa.string()))

    return scopes


def arms(chunks: DataFrame, queries: DataFrame, pool: int, shared: str = "Global", links: DataFrame | None = None) -> DataFrame:
    """(q, doc_id, score, arm): the query's workspace (0), the shared one (1), and sources linked to its workspace (2).

    links: workspace, identifier; a linked chunk's path contains the identifier, whatever its workspace. A chunk that
    several arms find counts once, in the first of them. The chunks are read and scored once for all arms.
    """
    reach = [Arm(0, pool, "own"), Arm(1, max(10, pool // 2), "shared", shared)]
    if links is not None:
        chunks = chunks.withColumn("_scopes", linked_scopes(F.col("file_path"), links))
        reach.append(Arm(2, 2 * pool, "linked"))
    found = scan(chunks, queries, reach, "workspace", "_scopes" if links is not None else None)
    return found.groupBy("q", "doc_id").agg(F.max("score").alias("score"), F.min("arm").alias("arm"))


def filter_and_balance(rows: DataFrame, setting: Retrieval) -> DataFrame:
    """rows: q, doc_id, score, arm, src, text; threshold, then turns, then budget."""
    r = threshold(positioned(rows, F.desc("score"), "arm", "doc_id"), setting.min_score)
    return char_budget(round_robin(r, setting.top_k, setting.per_source), setting.max_chars)


def search(chunks: DataFrame, queries: DataFrame, setting: Retrieval, shared: str = "Global", links: DataFrame | None = None) -> DataFrame:
    """Ranked chunks of each query, with all their columns."""
    pool = max(setting.pool, 2 * setting.top_k)
    # what was found is written and counted first: few rows are sent to the chunks, whose texts then stay where they are
    found = Scratch(chunks.sparkSession).written(arms(chunks, queries, pool, shared, links), "search-found", keep=True)
    rows = small(found, 64).join(chunks.drop("vector"), "doc_id").withColumn("src", F.col("file_path"))
    return filter_and_balance(rows, setting)
