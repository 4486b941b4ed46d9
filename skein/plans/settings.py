"""Queries of small expressions, over inline fixtures and the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.text import normal_path
from ..operators import scope
from ..schema import fixture, table

VERSIONS = "(1, 'v0.11.63', '0.11.7'), (2, 'tool 1.2', 'v1.2.0'), (3, '2.0rc1', '2.0'), (4, 'x', '0.0.1'), (5, '1.10', '1.9.9')"


def version_compare(spark, d):
    x = fixture(spark, "id, a, b", VERSIONS)
    a, b = (scalars.version_tuple(F.col(c)) for c in "ab")
    return x.select("id", F.array_join(a, ".").alias("a"), F.array_join(b, ".").alias("b"), (a > b).alias("newer"))


TAGS = "(1, '@0.15.2'), (2, ' v1'), (3, '@ latest'), (4, 'HEAD'), (5, '2')"


def version_tag(spark, d):
    return fixture(spark, "id, x", TAGS).select("id", scalars.version_tag(F.col("x")).alias("tag"))


def safe_names(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.safe_name(F.col("text")).alias("name"), scalars.quoted(F.col("text")).alias("quoted"))


def retry_delays(spark, d):
    return fixture(spark, "attempt, jitter", "(0, 0.1), (1, 0.2), (4, 0.5)").select("attempt", F.round(scalars.retry_delay(F.col("attempt"), F.col("jitter")), 4).cast("double").alias("seconds"))


MESSAGES = "(1, 'Error 404'), (2, 'invalid_api_key'), (3, 'Quota gone'), (4, 'HTTP 429'), (5, 'Connection refused'), (6, 'this tool is not supported'), (7, 'zlib error -5'), (8, 'what'), (9, 'billing: 401')"


def error_kind(spark, d):
    return fixture(spark, "id, x", MESSAGES).select("id", scalars.error_kind(F.col("x")).alias("kind"))


COMMANDS = """(1, '/folder add "my notes" x'), (2, '/web https://a/b'), (3, '  /hepl  me '), (4, '/zzzzqq'), (5, '/Folder')"""
KNOWN = ["/help", "/exit", "/folder", "/folders", "/web", "/switch", "/model"]


def command_words(spark, d):
    return fixture(spark, "id, x", COMMANDS).select("id", F.array_join(scalars.command_words(F.col("x")), "|").alias("words"))


def command_suggestion(spark, d):
    return fixture(spark, "id, x", COMMANDS).select("id", scalars.suggested(F.col("x"), KNOWN).alias("nearest"))


JSON_ROWS = """(1, '["a", "b"]'), (2, '[]'), (3, NULL), (4, 'no json')"""


def settings_json(spark, d):
    """JSON lists of settings read, what is no list as none, and written again."""
    x = fixture(spark, "id, x", JSON_ROWS).withColumn("l", F.coalesce(F.from_json("x", "array<string>"), F.array().cast("array<string>")))
    return x.select("id", F.size("l").alias("n"), F.to_json("l").alias("again"))


def props_json(spark, d):
    """Keys of the events' JSON properties."""
    e = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return e.groupBy("k").agg(F.count("*").alias("n"))


def paths_normal(spark, d):
    return table(spark, d, "documents").select("doc_id", normal_path(F.concat("lang", F.lit("\\"), "source")).alias("path"))


def ledger_lists(spark, d):
    """Rows of a ledger by when they were made, first and last."""
    p = table(spark, d, "pages").select("page_id", "url")
    return p.orderBy(F.asc("page_id")).limit(5).withColumn("list", F.lit("first")).unionByName(p.orderBy(F.desc("page_id")).limit(5).withColumn("list", F.lit("last")))


def url_contains(spark, d):
    """Ledger rows whose URL holds a domain or a prefix."""
    return table(spark, d, "pages").where(F.col("url").contains("example.org") | F.col("url").contains("/fr/")).select("page_id")


def composite_hash(spark, d):
    """One hash over a set of documents in order, as a gate for loading them again."""
    t = table(spark, d, "benchmark").groupBy().agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("l"))  # the fixed help pages
    return t.select(F.sha2(F.array_join(F.transform("l", lambda x: x["text"]), "\n\n"), 256).alias("hash"))


EMPTY = "(1, 'q', 'w', 0, false), (2, 'q', NULL, 7, false), (3, 'q', 'w', 7, false), (4, 'q', 'w', 7, true), (5, 'q', NULL, 7, true), (6, 'q', 'w', 0, true)"


def empty_states(spark, d):
    """What a search says that found nothing."""
    q, w, n = F.col("query"), F.col("workspace"), F.col("total")
    quoted = lambda head: F.concat(F.lit(head), q, F.lit("'"))
    memory = F.when(n == 0, "No long-term session memory summaries found in database yet.").when(w.isNotNull(), F.concat(quoted("No session memory records found for query '"), F.lit(" in workspace '"), w, F.lit("'."))).otherwise("No session memory records found.")
    docs = F.when(n == 0, "No documents found in vector database.").when(w.isNotNull(), F.concat(quoted("No relevant documents found for query '"), F.lit(" in workspace '"), w, F.lit("'. (Search executed across "), n, F.lit(" indexed chunks)."))).otherwise(F.concat(quoted("No relevant documents found for query '"), F.lit(".")))
    return fixture(spark, "id, query, workspace, total, memory", EMPTY).select("id", F.when(F.col("memory"), memory).otherwise(docs).alias("message"))




#: What the customers ask for, as SQL that Spark and the oracle share.
REQUESTS = """SELECT c_custkey AS q, CASE c_custkey % 5 WHEN 0 THEN 'tavily' WHEN 1 THEN 'serper' WHEN 2 THEN 'ddg' WHEN 3 THEN 'auto' END AS pref, CASE WHEN c_custkey % 2 = 0 THEN 'key' WHEN c_custkey % 4 = 1 THEN ' ' END AS tavily_key,
    CASE WHEN c_custkey % 3 = 0 THEN 'key' END AS serper_key, c_custkey % 7 < 4 AS domains, c_custkey % 11 <> 0 AS fallback FROM {customer}"""
ENGINES = (("tavily", 3), ("serper", 4), ("duckduckgo", 5))


def _answers(orders):
    """(q, engine, within, pos, url): what each engine would give a customer, by the numbers of the customer's orders."""
    o = orders.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("k"))
    wide = o.select("q", "k", F.inline(F.array(*(F.struct(F.lit(e).alias("engine"), F.lit(n).alias("n"), F.lit(w).alias("within")) for e, n in ENGINES for w in (True, False)))))
    kept = wide.where((F.col("k") % F.col("n") < 2) & ((F.col("k") + F.col("q")) % F.when(F.col("within"), 6).otherwise(2) == 0))
    return kept.select("q", "engine", "within", (F.col("k") % 100).cast("int").alias("pos"), F.concat(F.lit("https://"), "engine", F.lit("/"), (F.col("k") % 5).cast("string")).alias("url"))


def search_cascade(spark, d):
    """Results of a web search for every customer, three at most, by preference, keys and fallbacks."""
    asked = spark.sql(REQUESTS, customer=table(spark, d, "customer"))
    return scope.searched(asked, _answers(table(spark, d, "orders")), 3).select("q", "engine", "url", "rank", "widened")


def vector_width(spark, d):
    """Width of the embeddings, and how many have another one."""
    v = table(spark, d, "embeddings").select(F.size("embedding").alias("w"))
    return v.agg(F.max("w").alias("width"), F.sum((F.col("w") != 64).cast("long")).alias("n_other"))


QUERIES = {f.__name__: f for f in (
    version_compare, version_tag, safe_names, retry_delays, error_kind, command_words, command_suggestion, settings_json, props_json, paths_normal, ledger_lists, url_contains, composite_hash, empty_states,
    search_cascade, vector_width)}
_TUPLE = r"list_transform(list_filter(list_transform(string_split(regexp_replace(list_last(regexp_split_to_array(trim(regexp_replace({0}, '^v+', '')), '\s+')), '^v+', ''), '.'), lambda p: regexp_extract(p, '^([0-9]+)', 1)), lambda p: p <> ''), lambda p: p::INT)"
_ORDER = f"(SELECT id, CASE WHEN len(a) > 0 THEN a ELSE [0, 0, 0] END AS a, CASE WHEN len(b) > 0 THEN b ELSE [0, 0, 0] END AS b FROM (SELECT id, {_TUPLE.format('a')} AS a, {_TUPLE.format('b')} AS b FROM (VALUES {VERSIONS}) t(id, a, b)))"
ORACLE = {
    "version_compare": f"SELECT id, array_to_string(a, '.') AS a, array_to_string(b, '.') AS b, a > b AS newer FROM {_ORDER}",
    "version_tag": f"SELECT id, CASE WHEN lower(c) IN ('latest', 'current', 'head') THEN 'latest' WHEN starts_with(c, 'v') THEN c ELSE 'v' || c END AS tag FROM (SELECT id, trim(regexp_replace(trim(x), '^@', '')) AS c FROM (VALUES {TAGS}) t(id, x))",
    "safe_names": r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}_-]', '_', 'g') AS name, replace(text, chr(39), chr(39) || chr(39)) AS quoted FROM documents",
    "retry_delays": "SELECT attempt, round(1.5 * 2 ** attempt + jitter, 4)::DOUBLE AS seconds FROM (VALUES (0, 0.1), (1, 0.2), (4, 0.5)) t(attempt, jitter)",
    "error_kind": "SELECT id, CASE " + " ".join("WHEN " + " OR ".join([f"contains(lower(x), '{p}')" for p in parts] + ["(contains(lower(x), 'tool') AND contains(lower(x), 'not supported'))"] * (kind == "tools")) + f" THEN '{kind}'" for kind, parts in scalars.ERRORS) + f" ELSE 'other' END AS kind FROM (VALUES {MESSAGES}) t(id, x)",
    "command_words": f"""SELECT id, array_to_string(list_filter(list_transform(regexp_extract_all(x, '"[^"]*"|''[^'']*''|[^\\s"'']+'), lambda w: regexp_replace(w, '^[''"]|[''"]$', '', 'g')), lambda w: w <> ''), '|') AS words FROM (VALUES {COMMANDS}) t(id, x)""",
    "settings_json": f"""SELECT id, len(l)::INT AS n, to_json(l)::VARCHAR AS again FROM (SELECT id, CASE WHEN json_valid(x) AND json_type(x) = 'ARRAY' THEN from_json(x, '["VARCHAR"]') ELSE []::VARCHAR[] END AS l FROM (VALUES {JSON_ROWS}) t(id, x))""",
    "props_json": "SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k",
    "paths_normal": "SELECT doc_id, lang || '/' || source AS path FROM documents",
    "ledger_lists": "SELECT page_id, url, 'first' AS list FROM (SELECT * FROM pages ORDER BY page_id LIMIT 5) UNION ALL SELECT page_id, url, 'last' FROM (SELECT * FROM pages ORDER BY page_id DESC LIMIT 5)",
    "url_contains": "SELECT page_id FROM pages WHERE url LIKE '%example.org%' OR url LIKE '%/fr/%'",
    "composite_hash": "SELECT sha256(string_agg(text, chr(10) || chr(10) ORDER BY item_id)) AS hash FROM benchmark",
    "empty_states": f"""SELECT id, CASE WHEN memory THEN CASE WHEN total = 0 THEN 'No long-term session memory summaries found in database yet.' WHEN workspace IS NOT NULL THEN 'No session memory records found for query ''' || query || ''' in workspace ''' || workspace || '''.' ELSE 'No session memory records found.' END
        WHEN total = 0 THEN 'No documents found in vector database.' WHEN workspace IS NOT NULL THEN 'No relevant documents found for query ''' || query || ''' in workspace ''' || workspace || '''. (Search executed across ' || total || ' indexed chunks).' ELSE 'No relevant documents found for query ''' || query || '''.' END AS message
        FROM (VALUES {EMPTY}) t(id, query, workspace, total, memory)""",
    "search_cascade": f"""WITH req AS ({REQUESTS.format(customer="customer")}), ans AS (SELECT o_custkey AS q, engine, within, CAST(o_orderkey % 100 AS INTEGER) AS pos, 'https://' || engine || '/' || o_orderkey % 5 AS url
            FROM orders, (VALUES ('tavily', 3), ('serper', 4), ('duckduckgo', 5)) e(engine, n), (VALUES (true, 6), (false, 2)) w(within, m) WHERE o_orderkey % n < 2 AND (o_orderkey + o_custkey) % m = 0),
        turns AS (SELECT q, domains, fallback, t.within, t.again, t.step, e.engine, e.turn FROM req, (VALUES (true, false, 0), (false, true, 1), (false, false, 2)) t(within, again, step), (VALUES ('tavily', 0), ('serper', 1), ('duckduckgo', 2)) e(engine, turn)
            WHERE (step = 2) = (NOT domains) AND (step <> 1 OR fallback)
            AND CASE coalesce(pref, 'auto') WHEN 'tavily' THEN (engine = 'tavily' AND trim(coalesce(tavily_key, '')) <> '') OR (engine = 'duckduckgo' AND fallback AND step <> 1)
                WHEN 'serper' THEN (engine = 'serper' AND trim(coalesce(serper_key, '')) <> '') OR (engine = 'duckduckgo' AND fallback AND step <> 1) WHEN 'ddg' THEN engine = 'duckduckgo'
                ELSE engine = 'duckduckgo' OR engine = CASE WHEN trim(coalesce(tavily_key, '')) <> '' THEN 'tavily' WHEN trim(coalesce(serper_key, '')) <> '' THEN 'serper' END END),
        hit AS (SELECT t.*, row_number() OVER (PARTITION BY q ORDER BY step, turn) AS r FROM turns t WHERE EXISTS (SELECT 1 FROM ans a WHERE a.q = t.q AND a.engine = t.engine AND a.within = t.within))
        SELECT q, engine, url, rank, widened FROM (SELECT h.q, h.engine, h.again AS widened, a.url, CAST(row_number() OVER (PARTITION BY h.q ORDER BY min(a.pos), a.url) AS INTEGER) AS rank FROM hit h JOIN ans a USING (q, engine, within) WHERE r = 1 GROUP BY h.q, h.engine, h.again, a.url) WHERE rank <= 3""",
    "vector_width": "SELECT max(len(embedding)) AS width, count(*) FILTER (len(embedding) <> 64) AS n_other FROM embeddings",
}
