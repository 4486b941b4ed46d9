"""Queries of conversation memory; the driver's system turns stand in for tool turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PRIOR_TURN, TURN_CUT
from ..operators import memory
from ..schema import table


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "tool").otherwise(F.col("role")).alias("role"), "text")


def _memory(spark, d):
    level = F.when(F.col("turn") % 3 == 0, "meta_summary").otherwise("session_summary")
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("w"), F.col("conv_id") % 4).alias("workspace"), level.alias("level"), (F.col("turn") * 100 + F.col("conv_id") % 7).alias("ts"))


def format_history(spark, d):
    return memory.history(_turns(spark, d))


def memory_by_level(spark, d):
    return memory.by_level(_memory(spark, d))


def meta_batch(spark, d):
    return memory.meta_batch(_memory(spark, d)).select("workspace", "rank", "id")


def prune_history(spark, d):
    return memory.pruned_history(_turns(spark, d)).select("conv_id", "turn", F.sha2("text", 256).alias("h"))


def turn_tool_budget(spark, d):
    return memory.turn_budget(_turns(spark, d)).select("conv_id", "turn", F.sha2("text", 256).alias("h"))


def last_user_turn(spark, d):
    return _turns(spark, d).groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("boundary"))


def session_summaries(spark, d):
    return memory.summarised(_turns(spark, d))


def _entries(spark, d):
    return _memory(spark, d).select(F.col("id").cast("string").alias("id"), "workspace", "level", "ts").join(
        table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), F.col("text").alias("content")), "id")


def memory_consolidate(spark, d):
    """The memory after its oldest session summaries became one meta summary of each workspace."""
    return memory.consolidated(_entries(spark, d)).groupBy("workspace", "level").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max(F.when(F.col("id").startswith("meta_"), F.sha2("content", 256))).alias("h"))


def memory_store(spark, d):
    """Session summaries joined to the memory, each thread in a workspace."""
    said = memory.summarised(_turns(spark, d)).withColumn("workspace", F.concat(F.lit("w"), F.col("conv_id") % 4))
    old = _entries(spark, d)
    out = memory.stored(old, said, F.lit(10**6).cast("long"))
    return out.where("ts = 1000000").select("id", "workspace", "level", F.sha2("content", 256).alias("h"))


def memory_delete(spark, d):
    from ..operators.dml import delete_ids

    m = _memory(spark, d)
    return memory.by_level(delete_ids(m, memory.meta_batch(m), "id"))


def memory_reset(spark, d):
    return memory.by_level(memory.reset(_memory(spark, d), "w1"))


def memory_last(spark, d):
    """The last turns of each conversation, oldest first."""
    from pyspark.sql import Window

    t = table(spark, d, "conversations")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return t.withColumn("back", back).where("back <= 2").select("conv_id", "turn", "back")


_T = "t AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'tool' ELSE role END AS role, text FROM conversations)"
_M = "m AS (SELECT conv_id * 1000 + turn AS id, 'w' || conv_id % 4 AS workspace, CASE WHEN turn % 3 = 0 THEN 'meta_summary' ELSE 'session_summary' END AS level, turn * 100 + conv_id % 7 AS ts FROM conversations)"
QUERIES = {f.__name__: f for f in (format_history, memory_by_level, meta_batch, prune_history, turn_tool_budget, last_user_turn, session_summaries, memory_consolidate, memory_store, memory_delete, memory_reset, memory_last)}
ORACLE = {
    "format_history": f"WITH {_T} SELECT conv_id, string_agg(upper(role) || ': ' || text || chr(10), '' ORDER BY turn, text) AS history FROM t WHERE role IN ('user', 'assistant') GROUP BY conv_id",
    "memory_by_level": f"WITH {_M} SELECT workspace, level, count(*) AS n FROM m GROUP BY ALL",
    "meta_batch": f"""WITH {_M} SELECT workspace, rank::INT AS rank, id FROM (SELECT *, count(*) OVER (PARTITION BY workspace) AS n, row_number() OVER (PARTITION BY workspace ORDER BY ts, id) AS rank FROM m WHERE level = 'session_summary')
        WHERE n >= 30 AND rank <= 10""",
    "prune_history": f"""WITH {_T} SELECT conv_id, turn, sha256(CASE WHEN role = 'tool' AND length(text) > 300 AND n > 2 THEN '{PRIOR_TURN}' ELSE text END) AS h FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM t)""",
    "turn_tool_budget": f"""WITH {_T}, b AS (SELECT *, turn > coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), -1) AS now FROM t),
        s AS (SELECT *, greatest(4000, 40000 // greatest(sum((role = 'tool' AND now)::INT) OVER (PARTITION BY conv_id), 1))::BIGINT AS share FROM b)
        SELECT conv_id, turn, sha256(CASE WHEN role <> 'tool' THEN text WHEN now THEN CASE WHEN length(text) > share THEN substr(text, 1, share) || chr(10) || '{TURN_CUT[1:]}' ELSE text END ELSE '{PRIOR_TURN}' END) AS h FROM s""",
    "last_user_turn": "SELECT conv_id, max(CASE WHEN role = 'user' THEN turn END) AS boundary FROM conversations GROUP BY conv_id",
    "session_summaries": f"""WITH {_T}, h AS (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn, text) AS said FROM t WHERE role IN ('user', 'assistant') GROUP BY conv_id),
        p AS (SELECT conv_id, list_filter(string_split(regexp_replace(said, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 20) AS s FROM h) SELECT conv_id, array_to_string(s[1:3], ' ') AS summary FROM p""",
    "memory_consolidate": f"""WITH {_M}, e AS (SELECT m.id::VARCHAR AS id, workspace, level, ts, text AS content FROM m JOIN conversations ON conv_id * 1000 + turn = m.id),
        o AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY ts, id) AS r, count(*) OVER (PARTITION BY workspace) AS c FROM e WHERE level = 'session_summary'), b AS (SELECT * FROM o WHERE c >= 30 AND r <= 10),
        g AS (SELECT 'meta_' || min_by(id, r) AS id, workspace, 'meta_summary' AS level, string_agg(CASE WHEN regexp_matches(content, '(?s)^.*?[.!?](\\s|$)') THEN regexp_extract(content, '(?s)^(.*?[.!?])(?:\\s|$)', 1) ELSE content END, ' ' ORDER BY r) AS content FROM b GROUP BY workspace)
        SELECT workspace, level, count(*) AS n, min(id) AS first, max(CASE WHEN starts_with(id, 'meta_') THEN sha256(content) END) AS h FROM (SELECT id, workspace, level, content FROM e WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, workspace, level, content FROM g) GROUP BY ALL""",
    "memory_store": f"""WITH {_T}, h AS (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn, text) AS said FROM t WHERE role IN ('user', 'assistant') GROUP BY conv_id),
        p AS (SELECT conv_id, array_to_string(list_filter(string_split(regexp_replace(said, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 20)[1:3], ' ') AS s FROM h)
        SELECT 's_' || conv_id AS id, 'w' || conv_id % 4 AS workspace, 'session_summary' AS level, sha256(s) AS h FROM p WHERE s <> ''""",
    "memory_delete": f"""WITH {_M}, o AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY ts, id) AS r, count(*) OVER (PARTITION BY workspace) AS c FROM m WHERE level = 'session_summary')
        SELECT workspace, level, count(*) AS n FROM m WHERE id NOT IN (SELECT id FROM o WHERE c >= 30 AND r <= 10) GROUP BY ALL""",
    "memory_reset": f"WITH {_M} SELECT workspace, level, count(*) AS n FROM m WHERE workspace <> 'w1' GROUP BY ALL",
    "memory_last": "SELECT conv_id, turn, back::INT AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 2",
}
