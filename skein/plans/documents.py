"""Queries over documents: hashes, enrichment, chunking, counts, sinks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..config import CHUNK_OVERLAP, CHUNK_WORDS
from ..functions import text as T
from ..functions.sentences import sentence_chunks
from ..operators.embedding import HashedWords, embedded
from ..operators.folders import under
from ..schema import CHUNKS_SQL, chunks, table

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _docs(spark, d):
    return table(spark, d, "documents").withColumn("file_name", F.concat("source", F.lit(".md")))


def content_hash(spark, d):
    return _docs(spark, d).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def chunk_id(spark, d):
    return _docs(spark, d).select("doc_id", T.chunk_id(F.col("lang"), F.col("text")).alias("chunk_id"))


def doc_title(spark, d):
    return _docs(spark, d).select("doc_id", T.title(F.col("text"), F.col("file_name")).alias("title"))


def summary(spark, d):
    return _docs(spark, d).select("doc_id", T.summary(F.col("text"), F.col("file_name")).alias("summary"))


def keyword_topn(spark, d):
    found = T.keywords(_docs(spark, d)).select("doc_id", F.posexplode("top").alias("pos", "t"))
    return found.select("doc_id", (F.col("pos") + 1).alias("rank"), "t.keyword", "t.freq")


def _enriched(spark, d):
    docs = T.keywords(_docs(spark, d)).withColumn("keywords", F.array_join(F.col("top.keyword"), ", "))
    return docs.withColumn("summary", T.summary(F.col("text"), F.col("file_name")))


def envelope_text(spark, d):
    return _enriched(spark, d).select("doc_id", F.sha2(T.envelope(F.col("summary"), F.col("keywords"), F.col("text")), 256).alias("h"))


def envelope_bypass(spark, d):
    """Rows of the system's own help are stored as they are; all others get their header."""
    x = _enriched(spark, d).withColumn("is_system_help", F.col("doc_id") % 11 == 0)
    return x.select("doc_id", F.sha2(F.when(F.col("is_system_help"), F.col("text")).otherwise(T.envelope(F.col("summary"), F.col("keywords"), F.col("text"))), 256).alias("h"))


def system_document(spark, d):
    """One document of the help pages: a heading and a text each, in order; and the hash by which loading it again is skipped."""
    pages = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("## Page "), "item_id", F.lit("\n"), "text").alias("part"))
    one = pages.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "part"))), lambda x: x["part"]), "\n\n").alias("text"))  # the fixed help pages
    return one.select(F.length("text").alias("n_chars"), F.sha2("text", 256).alias("hash"))


def bootstrap_gate(spark, d):
    """The system's chunks after a load: replaced where the composite hash is another one, else kept as they are."""
    gates = F.array(F.struct(F.lit("same").alias("gate"), F.lit(True).alias("keeps")), F.struct(F.lit("other").alias("gate"), F.lit(False).alias("keeps")))
    doc = system_document(spark, d).select("hash", F.explode(gates).alias("g")).select("hash", "g.*").withColumn("stored_hash", F.when(F.col("keeps"), F.col("hash")).otherwise("old"))
    return doc.select("gate", F.when(F.col("stored_hash") == F.col("hash"), "kept").otherwise("replaced").alias("action"), "hash")


def envelope_cache_join(spark, d):
    docs = _docs(spark, d).withColumn("h", T.content_hash(F.col("text")))
    cache = docs.where("doc_id % 3 = 0").groupBy("h").agg(F.min("doc_id").alias("cached_by"))
    return docs.join(cache, "h", "left").select("doc_id", F.col("cached_by").isNotNull().alias("hit"), F.coalesce("cached_by", "doc_id").alias("enriched_from"))


def chunk_split(spark, d):
    parts = _docs(spark, d).select("doc_id", F.explode(T.chunk_words(F.col("text"), 200, 40)).alias("c"))
    return parts.select("doc_id", "c.ord", F.sha2("c.text", 256).alias("h"))


def chunk_stats(spark, d):
    parts = _docs(spark, d).select("lang", "doc_id", F.explode(T.chunk_words(F.col("text"), CHUNK_WORDS, CHUNK_OVERLAP)).alias("c"))
    return parts.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.max("c.ord").alias("last"))


def sentence_split(spark, d):
    """Chunks of whole sentences, of 96 tokens at most, that overlap by up to 24."""
    parts = _docs(spark, d).select("doc_id", F.explode(sentence_chunks(F.col("text"), 96, 24)).alias("c"))
    return parts.select("doc_id", "c.ord", "c.start", "c.end", "c.tokens", F.sha2("c.text", 256).alias("h"))


def sentence_split_vocabulary(spark, d):
    """Chunks of at most 1024 tokens of a tokenizer file, which overlap by up to 200."""
    import public_tokenizers

    cut = sentence_chunks(F.col("text"), CHUNK_WORDS, CHUNK_OVERLAP, public_tokenizers.path("byte_bpe_50k.json"))
    return _docs(spark, d).select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.ord", "c.start", "c.end", "c.tokens")


def embed_chunks(spark, d):
    """Every chunk of every document with its vector: equal chunks are sent once, 50 at a time."""
    parts = _docs(spark, d).select("doc_id", F.explode(sentence_chunks(F.col("text"), 96, 24)).alias("c")).select("doc_id", "c.ord", "c.text")
    got = embedded(parts, "text", HashedWords())
    norm = F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3)
    return got.select("doc_id", "ord", F.size("vector").alias("width"), norm.alias("norm"), F.size(F.filter("vector", lambda x: x != 0)).alias("nonzero"), "error")


@F.arrow_udf(Ty.ArrayType(Ty.FloatType()))
def embed(text: pa.Array) -> pa.Array:
    """A deterministic stand-in for an embedding provider: hashed words, unit length, 64 wide."""
    import zlib

    rows = []
    for t in text.to_pylist():
        v = np.zeros(64)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h & 64 else -1
        n = np.linalg.norm(v)
        rows.append((v / n if n else v).astype("float32").tolist())
    return pa.array(rows, pa.list_(pa.float32()))


def embed_hash(spark, d):
    return _docs(spark, d).select("doc_id", embed("text").alias("vector")).select("doc_id", F.size("vector").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("norm"))


def index_documents(spark, d):
    """The whole indexing plan: enrichment, chunks under their header, ids, embeddings."""
    parts = _enriched(spark, d).select("doc_id", "lang", "summary", "keywords", F.explode(T.chunk_words(F.col("text"), CHUNK_WORDS, CHUNK_OVERLAP)).alias("c"))
    body = T.envelope(F.col("summary"), F.col("keywords"), F.col("c.text"))
    rows = parts.select("doc_id", "c.ord", F.col("lang").alias("workspace"), body.alias("text"), "keywords", F.sha2("c.text", 256).alias("content_hash"))
    return rows.select("doc_id", "ord", T.chunk_id(F.col("workspace"), F.col("text")).alias("id"), "workspace", "content_hash", F.size(embed("text")).alias("width"))


def count_by_workspace(spark, d):
    return chunks(spark, d).groupBy("workspace").agg(F.count("*").alias("n"))


def inspect_sample(spark, d):
    return chunks(spark, d).where("workspace = 'es'").select("doc_id", "id", "file_name", F.substring("text", 1, 80).alias("head")).orderBy("doc_id").limit(5)


def duplicates_by_hash(spark, d):
    return _docs(spark, d).groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def path_prefix_join(spark, d):
    """Files under any of a workspace's folders."""
    folders = spark.sql("SELECT * FROM VALUES ('w1', array('src1', 'src2')), ('w2', array('src1')) AS t(workspace, paths)").select("workspace", F.explode("paths").alias("folder"))
    return under(_docs(spark, d).select("doc_id", "source"), folders, "source").groupBy("workspace").agg(F.countDistinct("doc_id").alias("n"))


def folders_of_sources(spark, d):
    """Every document under the folders that the sources' own names make: a workspace for each language, with the sources of its documents."""
    docs = _docs(spark, d).select("doc_id", "lang", "source")
    folders = docs.select(F.col("lang").alias("workspace"), F.expr("substring(source, 1, length(source) - (length(source) > 4)::int)").alias("folder")).distinct()
    return under(docs.select("doc_id", "source"), folders, "source").select("doc_id", "workspace")


_LINES = f"list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: {STRIP.format('x')}), lambda x: x <> '')"
_TITLE = f"""coalesce(list_filter(list_transform(list_filter(({_LINES})[1:8], lambda x: starts_with(x, '#') OR length(x) < 120),
    lambda x: {STRIP.format(r"regexp_replace(x, '^[#*\-\s]+', '')")}), lambda x: length(x) > 3)[1], source || '.md')"""
_SENT = rf"""list_filter(list_transform(string_split(regexp_replace(array_to_string(({_LINES})[1:12], ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: length(x) > 20)"""
_SUMMARY_CTE = f"""parts AS (SELECT doc_id, {_TITLE} AS title, {_SENT} AS s, text FROM documents),
    full_text AS (SELECT doc_id, 'Document ''' || title || ''': ' || CASE WHEN len(s) > 0 THEN array_to_string(s[1:3], ' ') ELSE substr({STRIP.format('text')}, 1, 400) END AS f FROM parts),
    summaries AS (SELECT doc_id, CASE WHEN length(f) > 450 THEN substr(f, 1, 447) || '...' ELSE f END AS summary FROM full_text)"""
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-ZÀ-ÿ]{{4,}}') AND w NOT IN ({_STOP}))"


_KEYWORDS_CTE = f"""body AS (SELECT doc_id, unnest(w) AS keyword, generate_subscripts(w, 1) AS pos, 1 AS n FROM (SELECT doc_id, {_words('text')} AS w FROM documents)),
    head AS (SELECT doc_id, unnest(w) AS keyword, generate_subscripts(w, 1) + 1073741824 AS pos, 5 AS n FROM (SELECT doc_id, {_words(_TITLE)} AS w FROM documents)),
    freqs AS (SELECT doc_id, keyword, sum(n) AS freq, min(pos) AS first FROM (SELECT * FROM body UNION ALL SELECT * FROM head) GROUP BY ALL),
    keywords AS (SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, first) AS rank, keyword, freq::BIGINT AS freq FROM freqs) WHERE rank <= 7)"""


def _chunk_cte(size: int, overlap: int) -> str:
    step = size - overlap
    return rf"""w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array({STRIP.format('text')}, '\s+'), lambda x: x <> '') AS w FROM documents),
        c AS (SELECT doc_id, lang, w, unnest(generate_series(0, greatest(ceil((len(w) - {overlap}) / {step}::DOUBLE), 1)::BIGINT - 1)) AS ord FROM w WHERE len(w) > 0),
        chunked AS (SELECT doc_id, lang, ord::INT AS ord, array_to_string(w[ord * {step} + 1 : ord * {step} + {size}], ' ') AS text FROM c)"""


def _sentence_cte(budget: int, overlap: int) -> str:
    """Tokens with the white space before them, sentences, pieces of long ones, and windows by a recursion over each text."""
    return rf"""tok AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[ 	

]*(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ 	

])') AS t FROM documents)),
        placed AS (SELECT *, ltrim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS w, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) AS z FROM tok),
        marked AS (SELECT *, length(t) > length(w) AS gap, regexp_matches(t, '^[ 	

]*
[ 	
]*
') AS blank, contains('.!?…。！？', w) AS stop, contains('"'')]}}»”’', w) AS closer FROM placed),
        run AS (SELECT *, max(CASE WHEN NOT closer OR gap THEN k END) OVER (PARTITION BY doc_id ORDER BY k) AS head FROM marked),
        ended AS (SELECT r.*, h.stop AS after FROM run r JOIN marked h ON h.doc_id = r.doc_id AND h.k = r.head),
        sent AS (SELECT *, sum(CASE WHEN k = 1 OR blank OR (gap AND before) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS s FROM (SELECT *, lag(after) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM ended)),
        pieced AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, s ORDER BY k) - 1) // {budget} AS piece FROM sent),
        unit AS (SELECT doc_id, s, piece, min(z - length(w)) AS a, max(z) AS z, count(*) AS n FROM pieced GROUP BY doc_id, s, piece),
        lists AS MATERIALIZED (SELECT doc_id, list(a ORDER BY s, piece) AS a, list(z ORDER BY s, piece) AS z, list(n ORDER BY s, piece) AS n, list(total ORDER BY s, piece) AS total
            FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY s, piece) AS total FROM unit) GROUP BY doc_id),
        step AS (SELECT doc_id, 0 AS ord, 1 AS i, len(list_filter(total, lambda x: x <= {budget})) AS j FROM lists UNION ALL
            SELECT doc_id, ord + 1, i, len(list_filter(total, lambda x: x <= {budget} + CASE WHEN i > 1 THEN total[i - 1] ELSE 0 END)) AS j FROM (
                SELECT step.doc_id, ord, total, step.i + 1 + len(list_filter(list_slice(total, step.i, step.j - 1), lambda x: x < total[j] - {overlap} OR x < total[j + 1] - {budget})) AS i FROM step JOIN lists USING (doc_id) WHERE j < len(total))),
        windowed AS (SELECT step.doc_id, ord, CAST(a[i] AS INTEGER) AS start, CAST(z[j] AS INTEGER) AS "end", CAST(total[j] - CASE WHEN i > 1 THEN total[i - 1] ELSE 0 END AS INTEGER) AS tokens FROM step JOIN lists USING (doc_id))"""


QUERIES = {f.__name__: f for f in (
    content_hash, chunk_id, doc_title, summary, keyword_topn, envelope_text, envelope_bypass, system_document, bootstrap_gate, envelope_cache_join, chunk_split, chunk_stats, sentence_split, sentence_split_vocabulary, embed_chunks, embed_hash, index_documents,
    count_by_workspace, inspect_sample, duplicates_by_hash, path_prefix_join, folders_of_sources)}  # fmt: skip
ORACLE = {
    "content_hash": f"SELECT doc_id, sha256({STRIP.format('text')}) AS content_hash FROM documents",
    "chunk_id": "SELECT doc_id, lang || '_' || substr(sha256(text), 1, 20) AS chunk_id FROM documents",
    "doc_title": f"SELECT doc_id, {_TITLE} AS title FROM documents",
    "summary": f"WITH {_SUMMARY_CTE} SELECT * FROM summaries",
    "keyword_topn": f"WITH {_KEYWORDS_CTE} SELECT doc_id, rank::INT AS rank, keyword, freq FROM keywords",
    "envelope_text": f"""WITH {_SUMMARY_CTE}, {_KEYWORDS_CTE}, kw AS (SELECT doc_id, string_agg(keyword, ', ' ORDER BY rank) AS k FROM keywords GROUP BY doc_id)
        SELECT doc_id, sha256('[Context: ' || summary || ' | Keywords: ' || coalesce(k, 'general') || ']' || chr(10) || '---' || chr(10) || text) AS h
        FROM documents JOIN summaries USING (doc_id) LEFT JOIN kw USING (doc_id)""",
    "envelope_bypass": f"""WITH {_SUMMARY_CTE}, {_KEYWORDS_CTE}, kw AS (SELECT doc_id, string_agg(keyword, ', ' ORDER BY rank) AS k FROM keywords GROUP BY doc_id)
        SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text ELSE '[Context: ' || summary || ' | Keywords: ' || coalesce(k, 'general') || ']' || chr(10) || '---' || chr(10) || text END) AS h
        FROM documents JOIN summaries USING (doc_id) LEFT JOIN kw USING (doc_id)""",
    "system_document": "SELECT length(t) AS n_chars, sha256(t) AS hash FROM (SELECT string_agg('## Page ' || item_id || chr(10) || text, chr(10) || chr(10) ORDER BY item_id) AS t FROM benchmark)",
    "bootstrap_gate": """WITH h AS (SELECT sha256(string_agg('## Page ' || item_id || chr(10) || text, chr(10) || chr(10) ORDER BY item_id)) AS hash FROM benchmark)
        SELECT gate, CASE WHEN gate = 'same' THEN 'kept' ELSE 'replaced' END AS action, hash FROM h, (VALUES ('same'), ('other')) t(gate)""",
    "envelope_cache_join": f"""WITH h AS (SELECT doc_id, sha256({STRIP.format('text')}) AS h FROM documents), cache AS (SELECT h, min(doc_id) AS cached_by FROM h WHERE doc_id % 3 = 0 GROUP BY h)
        SELECT doc_id, cached_by IS NOT NULL AS hit, coalesce(cached_by, doc_id) AS enriched_from FROM h LEFT JOIN cache USING (h)""",
    "chunk_split": f"WITH {_chunk_cte(200, 40)} SELECT doc_id, ord, sha256(text) AS h FROM chunked",
    "chunk_stats": f"WITH {_chunk_cte(CHUNK_WORDS, CHUNK_OVERLAP)} SELECT lang, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, max(ord) AS last FROM chunked GROUP BY lang",
    "sentence_split": f"""WITH RECURSIVE {_sentence_cte(96, 24)} SELECT doc_id, ord, start, "end", tokens, sha256(substr(text, start + 1, "end" - start)) AS h FROM windowed JOIN documents USING (doc_id)""",
    "embed_chunks": f"""WITH RECURSIVE {_sentence_cte(96, 24)},
        words AS (SELECT doc_id, ord, unnest(string_split_regex(lower(substr(text, start + 1, "end" - start)), '\\s+')) AS w FROM windowed JOIN documents USING (doc_id)),
        hashed AS MATERIALIZED (SELECT w, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(0, length(hex(encode(w))) // 2), lambda i: [CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h FROM (SELECT DISTINCT w FROM words)),
        place AS (SELECT doc_id, ord, h % 64 AS p, sum(CASE WHEN (h // 64) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM words JOIN hashed USING (w) GROUP BY doc_id, ord, p)
        SELECT doc_id, ord, 64 AS width, CASE WHEN count(*) FILTER (v <> 0) > 0 THEN 1.0 ELSE 0.0 END AS norm, CAST(count(*) FILTER (v <> 0) AS INTEGER) AS nonzero, CAST(NULL AS VARCHAR) AS error FROM place GROUP BY doc_id, ord""",
    "count_by_workspace": f"WITH {CHUNKS_SQL} SELECT workspace, count(*) AS n FROM chunks GROUP BY workspace",
    "inspect_sample": f"WITH {CHUNKS_SQL} SELECT doc_id, id, file_name, substr(text, 1, 80) AS head FROM chunks WHERE workspace = 'es' ORDER BY doc_id LIMIT 5",
    "duplicates_by_hash": f"SELECT sha256({STRIP.format('text')}) AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "folders_of_sources": "WITH f AS (SELECT DISTINCT lang AS workspace, substr(source, 1, length(source) - (length(source) > 4)::INT) AS folder FROM documents) SELECT DISTINCT doc_id, workspace FROM documents JOIN f ON starts_with(source, folder)",
    "path_prefix_join": "SELECT workspace, count(DISTINCT doc_id) AS n FROM documents JOIN (VALUES ('w1', 'src1'), ('w1', 'src2'), ('w2', 'src1')) f(workspace, p) ON starts_with(source, p) GROUP BY workspace",
}
