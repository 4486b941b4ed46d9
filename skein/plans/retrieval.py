"""Queries of the retrieval engine: neighbours, ranking, pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BUDGET_FREE, BUDGET_LEAST, PRESETS, TRUNCATED, Retrieval
from ..operators import ranking
from ..operators.ivf import Index
from ..operators.knn import knn, knn_sql
from ..operators.retrieve import arms, linked_scopes, search
from ..sources.scratch import folder
from ..schema import CHUNKS_SQL, chunks, fixture, query_vectors, table

K = 10
SCORE_SQL = "round(1 / (1 + greatest(0, list_sum(list_transform(list_zip(c.vector, q.vector), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)))), 6)"
QUERIES_SQL = "queries AS (SELECT doc_id AS q, workspace, vector FROM chunks WHERE doc_id % 20 = 0 AND vector IS NOT NULL)"
LINKS = "('en', 'src1'), ('fr', 'src2'), ('de', 'src\\\\3'), ('de', 'src3')"
LINKS_SQL = "links AS (SELECT DISTINCT ws, replace(ident, chr(92), '/') AS ident FROM (VALUES ('en', 'src1'), ('fr', 'src2'), ('de', 'src' || chr(92) || '3'), ('de', 'src3')) v(ws, ident))"


def _links(spark: SparkSession) -> DataFrame:
    return fixture(spark, "workspace, identifier", LINKS)


def _knn_sql(where: str = "true", key: str = "true", k: int = K) -> str:
    return f"""WITH {CHUNKS_SQL}, {QUERIES_SQL}
        SELECT q, doc_id, score FROM (SELECT q.q, c.doc_id, {SCORE_SQL} AS score, row_number() OVER (PARTITION BY q.q ORDER BY {SCORE_SQL} DESC, c.doc_id) AS r
        FROM chunks c, queries q WHERE c.vector IS NOT NULL AND {where} AND {key}) WHERE r <= {k}"""


def knn_l2_topk(spark, d):
    q = query_vectors(spark, d).orderBy("q").first()
    vector = q["vector"] if q else []
    return knn_sql(chunks(spark, d), vector, 20) if vector else chunks(spark, d).select("doc_id", F.lit(0.0).alias("score")).limit(0)


def knn_batch_topk(spark, d):
    return knn(chunks(spark, d), query_vectors(spark, d), K)


def knn_workspace_filter(spark, d):
    return knn(chunks(spark, d).where("workspace = 'fr'"), query_vectors(spark, d), K)


def knn_in_list(spark, d):
    return knn(chunks(spark, d).where(F.col("workspace").isin("fr", "de")), query_vectors(spark, d), K)


def knn_raw_predicate(spark, d):
    return knn(chunks(spark, d).where("length(text) > 500 AND file_path LIKE 'src1%'"), query_vectors(spark, d), K)


def knn_own_workspace(spark, d):
    return knn(chunks(spark, d), query_vectors(spark, d), K, key="workspace")


def _index(spark, d) -> Index:
    """An index over the chunks with a vector, their vectors and workspaces beside them."""
    return Index.build(chunks(spark, d).select("doc_id", "workspace", "vector"), f"{folder(spark)}/skein/ivf-{uuid.uuid4().hex}")


def ivf_topk(spark, d):
    """Near neighbours from an index that probes as many cells as its pilot rows need; with the recall that these had."""
    index = _index(spark, d)
    return index.knn(query_vectors(spark, d), K).withColumns({"probes": F.lit(index.probes), "recall": F.lit(index.recall)})


def ivf_all_cells(spark, d):
    """The same index with all its cells probed, which is exact."""
    return _index(spark, d).knn(query_vectors(spark, d), K, exact=True)


def ivf_own_workspace(spark, d):
    return _index(spark, d).knn(query_vectors(spark, d), K, key="workspace", exact=True)


def linked_sources_arm(spark, d):
    c = chunks(spark, d)
    return c.where(F.size(linked_scopes(F.col("file_path"), _links(spark))) > 0).groupBy("workspace", "file_path").agg(F.count("*").alias("n"))


def multi_arm_fanout(spark, d):
    return arms(chunks(spark, d), query_vectors(spark, d), 30, shared="en", links=_links(spark))


def _scored(spark, d, k=60):
    found = knn(chunks(spark, d), query_vectors(spark, d), k).join(chunks(spark, d).drop("vector"), "doc_id")
    return ranking.positioned(found.withColumn("src", F.col("file_path")), F.desc("score"), "doc_id")


def threshold_keep(spark, d):
    return ranking.threshold(_scored(spark, d), 0.42).select("q", "doc_id", "score")


def threshold_fallback(spark, d):
    rows = _scored(spark, d).where("pos > 0").withColumn("pos", F.col("pos") - 1)  # without the query itself
    return ranking.threshold(rows, 0.95).select("q", "doc_id", "score")


def round_robin(spark, d):
    return ranking.round_robin(_scored(spark, d), 15, 3).select("q", "pos", "doc_id", "src")


def round_robin_backfill(spark, d):
    return ranking.round_robin(_scored(spark, d, 40), 35, 1).select("q", "pos", "doc_id", "src")


def diversify_dedupe(spark, d):
    return ranking.round_robin(ranking.distinct_first(_scored(spark, d), "content_hash"), 20, 2).select("q", "pos", "doc_id", "src")


def char_budget(spark, d):
    return ranking.char_budget(_scored(spark, d), 12_000).select("q", "pos", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("h"))


def result_header(spark, d):
    rows = ranking.round_robin(_scored(spark, d), 5, 2).withColumn("keywords", F.lit(""))
    return ranking.rendered(rows)


def _retrieve(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search(chunks(spark, d), query_vectors(spark, d), PRESETS[name], shared="en", links=_links(spark)).select("q", "pos", "doc_id", "score", F.length("text").cast("long").alias("n_chars"))

    return run


def _ranked_sql(k: int = 60) -> str:
    return f"""WITH {CHUNKS_SQL}, {QUERIES_SQL}, scored AS (SELECT * FROM (SELECT q.q, c.doc_id, {SCORE_SQL} AS score, c.file_path AS src, c.text, c.content_hash, c.file_name, c.workspace,
        row_number() OVER (PARTITION BY q.q ORDER BY {SCORE_SQL} DESC, c.doc_id) - 1 AS pos FROM chunks c, queries q WHERE c.vector IS NOT NULL) WHERE pos < {k})"""


def _threshold_sql(src: str, least: float) -> str:
    return f"(SELECT * FROM (SELECT *, max((score >= {least})::INT) OVER (PARTITION BY q) AS got FROM {src}) WHERE score >= {least} OR (got = 0 AND pos = 0))"


def _robin_sql(src: str, k: int, per: int) -> str:
    return f"""(SELECT * EXCLUDE (pos, turn, late, ord, start), ord - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY late, CASE WHEN late THEN 0 ELSE turn END, CASE WHEN late THEN pos ELSE start END, pos) AS ord
        FROM (SELECT *, turn > {per} AS late FROM (SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY q, src) AS start FROM {src}))) WHERE ord <= {k})"""


def _budget_sql(src: str, most: int) -> str:
    n = len(TRUNCATED)
    return f"""(SELECT * EXCLUDE (text, cum, stop, room), CASE WHEN pos = stop THEN substr(text, 1, room::BIGINT) || chr(10) || '{TRUNCATED[1:]}' ELSE text END AS text FROM (
        SELECT *, min(CASE WHEN cum > {most} AND pos >= {BUDGET_FREE} THEN pos END) OVER (PARTITION BY q) AS stop, greatest(0, {most} - (cum - length(text))) AS room
        FROM (SELECT *, sum(length(text)) OVER (PARTITION BY q ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM {src})) WHERE stop IS NULL OR pos < stop OR (pos = stop AND room > {BUDGET_LEAST})) /* {n} */"""


def _arms_sql(pool: int) -> str:
    def top(arm: int, k: int, where: str) -> str:
        return f"""SELECT q, doc_id, score, {arm} AS arm FROM (SELECT q.q, c.doc_id, {SCORE_SQL} AS score, row_number() OVER (PARTITION BY q.q ORDER BY {SCORE_SQL} DESC, c.doc_id) AS r
            FROM chunks c, queries q WHERE c.vector IS NOT NULL AND {where}) WHERE r <= {k}"""

    linked = "EXISTS (SELECT 1 FROM links l WHERE l.ws = q.workspace AND contains(c.file_path, l.ident))"
    return f"""WITH {CHUNKS_SQL}, {QUERIES_SQL}, {LINKS_SQL}, arms AS (SELECT q, doc_id, max(score) AS score, min(arm) AS arm FROM (
        {top(0, pool, "c.workspace = q.workspace")} UNION ALL {top(1, max(10, pool // 2), "c.workspace = 'en' AND q.workspace <> 'en'")} UNION ALL {top(2, 2 * pool, linked)}) GROUP BY q, doc_id)"""


def _retrieve_sql(s: Retrieval) -> str:
    rows = "(SELECT a.*, c.text, c.file_path AS src, row_number() OVER (PARTITION BY q ORDER BY score DESC, arm, a.doc_id) - 1 AS pos FROM arms a JOIN chunks c USING (doc_id))"
    out = _budget_sql(_robin_sql(_threshold_sql(rows, s.min_score), s.top_k, s.per_source), s.max_chars)
    return f"{_arms_sql(max(s.pool, 2 * s.top_k))} SELECT q, pos, doc_id, score, length(text) AS n_chars FROM {out}"


QUERIES = {f.__name__: f for f in (
    knn_l2_topk, knn_batch_topk, knn_workspace_filter, knn_in_list, knn_raw_predicate, knn_own_workspace, ivf_topk, ivf_all_cells, ivf_own_workspace, linked_sources_arm, multi_arm_fanout, threshold_keep,
    threshold_fallback, round_robin, round_robin_backfill, diversify_dedupe, char_budget, result_header)} | {f"retrieve_{n}": _retrieve(n) for n in PRESETS}
ORACLE = {
    "knn_l2_topk": f"WITH {CHUNKS_SQL}, {QUERIES_SQL} SELECT c.doc_id, {SCORE_SQL} AS score FROM chunks c, (SELECT vector FROM queries ORDER BY q LIMIT 1) q WHERE c.vector IS NOT NULL ORDER BY score DESC, doc_id LIMIT 20",
    "knn_batch_topk": _knn_sql(),
    "knn_workspace_filter": _knn_sql("c.workspace = 'fr'"),
    "knn_in_list": _knn_sql("c.workspace IN ('fr', 'de')"),
    "knn_raw_predicate": _knn_sql("length(c.text) > 500 AND c.file_path LIKE 'src1%'"),
    "knn_own_workspace": _knn_sql(key="c.workspace = q.workspace"),
    "ivf_all_cells": _knn_sql(),
    "ivf_own_workspace": _knn_sql(key="c.workspace = q.workspace"),
    "linked_sources_arm": f"WITH {CHUNKS_SQL}, {LINKS_SQL} SELECT workspace, file_path, count(*) AS n FROM chunks c WHERE EXISTS (SELECT 1 FROM links l WHERE contains(c.file_path, l.ident)) GROUP BY ALL",
    "multi_arm_fanout": f"{_arms_sql(30)} SELECT q, doc_id, score, arm FROM arms",
    "threshold_keep": f"{_ranked_sql()} SELECT q, doc_id, score FROM {_threshold_sql('scored', 0.42)}",
    "threshold_fallback": f"{_ranked_sql()} SELECT q, doc_id, score FROM {_threshold_sql('(SELECT * REPLACE (pos - 1 AS pos) FROM scored WHERE pos > 0)', 0.95)}",
    "round_robin": f"{_ranked_sql()} SELECT q, pos, doc_id, src FROM {_robin_sql('scored', 15, 3)}",
    "round_robin_backfill": f"{_ranked_sql(40)} SELECT q, pos, doc_id, src FROM {_robin_sql('scored', 35, 1)}",
    "diversify_dedupe": f"""{_ranked_sql()}, firsts AS (SELECT * REPLACE (row_number() OVER (PARTITION BY q ORDER BY pos) - 1 AS pos) FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY q, content_hash ORDER BY pos) = 1))
        SELECT q, pos, doc_id, src FROM {_robin_sql('firsts', 20, 2)}""",
    "char_budget": f"{_ranked_sql()} SELECT q, pos, doc_id, length(text) AS n_chars, sha256(text) AS h FROM {_budget_sql('scored', 12000)}",
    "result_header": f"""{_ranked_sql()} SELECT q, string_agg('--- [Document Chunk ' || (pos + 1) || ' | Source: ' || file_name || ' | Workspace: ' || workspace || ' | Type: Local Document] ---' || chr(10) || 'Path: ' || src || chr(10) || 'Content:' || chr(10) || text,
        chr(10) || chr(10) ORDER BY pos) AS rendered FROM {_robin_sql('scored', 5, 2)} GROUP BY q""",
} | {f"retrieve_{n}": _retrieve_sql(s) for n, s in PRESETS.items()}
