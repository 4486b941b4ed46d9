"""Queries of table changes: each shows the table after the change."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cascade, dml
from ..schema import CHUNKS_SQL, chunks, fixture, table
from ..sources.manifest import Tables
from ..sources.scratch import folder

COLS = ["doc_id", "id", "workspace", "file_path"]


def _c(spark, d):
    return chunks(spark, d).drop("vector")


def _post(df):
    return df.groupBy("workspace", "file_path").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.sum("doc_id").alias("total"))


def append_chunks(spark, d):
    return _post(dml.append(_c(spark, d), _c(spark, d).where("doc_id % 20 = 7")))


def upsert_chunks(spark, d):
    return _post(dml.upsert(_c(spark, d), _c(spark, d).where("doc_id % 20 = 7").withColumn("file_path", F.lit("new")), "doc_id"))


def replace_pages(spark, d):
    """Changed sources: all their chunks go, then those of the new version come."""
    c = _c(spark, d)
    new = c.where("doc_id % 3 = 0 AND file_path IN ('src1', 'src2', 'src7')").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return _post(dml.replace_files(c, new))


def deleted_counts(spark, d):
    c = _c(spark, d)
    return dml.removed(c, {"workspace": dml.delete_workspace(c, "fr"), "file": dml.delete_file(c, "src3", "en"), "ids": dml.delete_ids(c, c.where("doc_id % 10 = 3"), "id")})


def delete_workspace(spark, d):
    return _post(dml.delete_workspace(_c(spark, d), "fr"))


def delete_local_docs(spark, d):
    return _post(dml.delete_local_docs(_c(spark, d), "de"))


def delete_file(spark, d):
    return _post(dml.delete_file(_c(spark, d), "src3", "en"))


def delete_id(spark, d):
    return _post(dml.delete_ids(_c(spark, d), _c(spark, d).where("doc_id % 10 = 3"), "id"))


def rename_workspace(spark, d):
    return _post(dml.rename_workspace(_c(spark, d), "es", "iberia"))


def transfer_source(spark, d):
    return _post(dml.transfer(_c(spark, d), "src5", "en", "de"))


ROOTS = "('w', 'https://a/x', NULL, 'X', 2), ('w', 'https://a', 'https://a', 'old', 1), ('w', 'https://b', NULL, 'B', 4), ('w', 'https://c/z', 'https://a', 'Z', 5), ('v', 'https://a/y', NULL, 'Y', 3), ('w', 'https://ab', NULL, 'AB', 9)"
ROOT_COLUMNS = "workspace, url, root_url, title, page_count"


def root_source_consolidate(spark, d):
    return dml.consolidate_root(fixture(spark, ROOT_COLUMNS, ROOTS), "w", "https://a", "A", 7)


def root_source_new(spark, d):
    return dml.consolidate_root(fixture(spark, ROOT_COLUMNS, ROOTS), "v", "https://a/", "A", 7)


def ledger_delete_root(spark, d):
    return dml.delete_root(fixture(spark, ROOT_COLUMNS, ROOTS), "w", "https://a")


def url_add_if_absent(spark, d):
    old = fixture(spark, ROOT_COLUMNS, ROOTS)
    new = fixture(spark, ROOT_COLUMNS, "('w', 'https://b', 'https://b', 'other', 1), ('v', 'https://b', 'https://b', 'B', 1), ('w', 'https://new', 'https://new', 'N', 1)")
    return dml.put(old, new, ["workspace", "url"], replace=False)


def envelope_cache_put(spark, d):
    """Enrichments by text hash, insert or replace."""
    docs = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    old, new = docs.where("doc_id % 2 = 0").withColumn("v", F.lit("old")), docs.where("doc_id % 3 = 0").withColumn("v", F.lit("new"))
    return dml.put(old, new, ["h"])


def _tables(spark, d):
    c = _c(spark, d)
    return {
        "chunks": c.select("workspace", "file_path", "doc_id"), "urls": c.where("doc_id % 5 = 0").select("workspace", F.col("file_path").alias("url")), "cache": c.groupBy("workspace", "file_path").agg(F.count("*").alias("size")),
        "workspaces": c.select(F.concat(F.lit("ws_"), "workspace").alias("workspace_id"), F.col("workspace").alias("name")).distinct(),
        "users": spark.sql("SELECT * FROM VALUES ('u1', array('es', 'FR')), ('u2', array('*', 'ws_es')), ('u3', array('de')) AS t(user, allowed)")}


def _counted(tables):
    parts = [df.groupBy("workspace").agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "workspace", "n") for t, df in tables.items() if t not in ("users", "workspaces")]
    parts.append(tables["users"].select(F.lit("users").alias("name"), F.explode("allowed").alias("workspace")).groupBy("name", "workspace").agg(F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cascade_rename(spark, d):
    t = _tables(spark, d)
    return _counted(t | cascade.rename(t, " ES ", "iberia")[0])


def cascade_delete(spark, d):
    t = _tables(spark, d)
    return _counted(t | cascade.delete(t, "es")[0])


ATTEMPTS = "('es', 'iberia'), ('ws_es', 'iberia'), ('ES', 'es'), ('es', 'ES'), ('es', 'fr'), ('es', 'FR'), ('es', ' es '), ('', 'x'), ('es', '  '), ('Default', 'x'), ('es', 'Shared Sources'), ('none', 'x')"


def cascade_outcomes(spark, d):
    """What comes of renaming a workspace, for attempts that may and that may not be made."""
    ws = _tables(spark, d)["workspaces"].cache()
    tries = fixture(spark, "name, renamed_to", ATTEMPTS).collect()
    return spark.createDataFrame([(r[0], r[1], cascade.renaming(ws, r[0], r[1])[0]) for r in tries], "name string, renamed_to string, outcome string")


def manifest_cascades(spark, d):
    """All tables in one store, after a rename and a deletion that were each committed for all of them at once, and a refused one."""
    store = Tables(spark, f"{folder(spark)}/skein/store-{uuid.uuid4().hex}")
    store.write(_tables(spark, d))
    store.change(lambda t: cascade.rename(t, "es", "iberia")[0])
    store.change(lambda t: cascade.rename(t, "iberia", "fr")[0])  # taken: nothing is committed
    store.change(lambda t: cascade.delete(t, "fr")[0])
    return _counted(store.read()).withColumn("version", F.lit(store.head().version))


def manifest_resets(spark, d):
    """Rows of each table after a clearing for another embedding model, and after a reset of everything: one commit each."""
    store = Tables(spark, f"{folder(spark)}/skein/store-{uuid.uuid4().hex}")
    store.write(_tables(spark, d))
    seen = []
    for step, f in (("all", lambda t: {}), ("cleared", cascade.cleared), ("reset", cascade.reset)):
        store.change(f)
        seen += [df.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(t).alias("name"), "n") for t, df in store.read().items()]
    return reduce(DataFrame.unionByName, seen)


def transfer_folder(spark, d):
    t = _tables(spark, d)
    paths = spark.sql("""SELECT * FROM VALUES ('en', array('src1', " 'src5/' ")), ('de', array('src9/')), ('fr', array('src5')) AS t(workspace, paths)""")
    p, cache, chunks = dml.transfer_folder(paths, t["cache"], t["chunks"], "src5", "en", "de")
    listed = p.select(F.lit("paths").alias("name"), "workspace", F.explode("paths").alias("x")).groupBy("name", "workspace").agg(F.count("*").alias("n"))
    return listed.unionByName(_counted({"cache": cache, "chunks": chunks, "users": t["users"].limit(0)}))


WEB = "('w', 'https://a/x', 'https://a', 2), ('w', 'https://a', NULL, 1), ('w', 'https://b', NULL, 4), ('v', 'https://a/y', NULL, 3), ('w', 'https://c/docs', 'https://c', 9), ('w', 'https://c', 'https://c', 9)"
WEB_COLUMNS = "workspace, url, root_url, page_count"


def transfer_web(spark, d):
    urls = fixture(spark, WEB_COLUMNS, WEB)
    u, p = dml.transfer_web(urls, urls, "https://a", "w", "v")
    u2, p2 = dml.transfer_web(urls, urls, "docs", "w", "v")
    rows = [x.select(F.lit(n).alias("name"), "workspace", "url") for n, x in (("urls", u), ("pages", p), ("urls_like", u2), ("pages_like", p2))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


LINKS = "('w', 'folder', '/a', 'A'), ('w', 'web', 'https://x', 'X'), ('v', 'folder', '/a', 'A')"
LINK_COLUMNS = "workspace, source_type, identifier, title"


def link_unlink(spark, d):
    links = dml.link(fixture(spark, LINK_COLUMNS, LINKS), fixture(spark, LINK_COLUMNS, "('w', 'folder', '/a', 'A2'), ('u', 'web', 'https://x', 'X')"))
    return dml.unlink(links, "w", "web", "https://x")


def links_of_workspace(spark, d):
    """By the workspace's name as it is written."""
    return fixture(spark, LINK_COLUMNS, LINKS + ", ('W', 'web', 'https://y', 'Y')").where("workspace = 'w'").select("source_type", "identifier")


def urls_listed(spark, d):
    """Registered URLs: of a workspace, and one by its own."""
    u = fixture(spark, WEB_COLUMNS, WEB)
    return u.where("workspace = 'v'").select(F.lit("workspace").alias("by"), "url").unionByName(u.where("url = 'https://b'").select(F.lit("url").alias("by"), "url"))


def url_hash_update(spark, d):
    """What a page's last reading leaves in the registry."""
    new = fixture(spark, WEB_COLUMNS, "('w', 'https://b', 'https://b', 6)")
    return dml.put(fixture(spark, WEB_COLUMNS, WEB), new, ["workspace", "url"])


def _sql(rel: str) -> str:
    return f"WITH {CHUNKS_SQL} SELECT workspace, file_path, count(*) AS n, min(doc_id) AS first, sum(doc_id)::BIGINT AS total FROM ({rel}) GROUP BY ALL"


_TABLES_SQL = """chunk AS (SELECT workspace, file_path, doc_id FROM chunks), urls AS (SELECT workspace, file_path AS url FROM chunks WHERE doc_id % 5 = 0), cache AS (SELECT workspace, file_path, count(*) AS size FROM chunks GROUP BY ALL),
    users AS (SELECT unnest(string_split(a, ',')) AS workspace FROM (VALUES ('es,FR'), ('*,ws_es'), ('de')) t(a)),
    every AS (SELECT 'chunks' AS name, workspace FROM chunk UNION ALL SELECT 'urls', workspace FROM urls UNION ALL SELECT 'cache', workspace FROM cache UNION ALL SELECT 'users', workspace FROM users)"""
_ROOTS_SQL = f"r AS (SELECT * FROM (VALUES {ROOTS}) t({ROOT_COLUMNS}))"


def _root_sql(workspace: str, root: str) -> str:
    stem = root.rstrip("/")
    return f"""WITH {_ROOTS_SQL}, kept AS (SELECT * FROM r WHERE NOT (workspace = '{workspace}' AND url <> '{root}' AND (coalesce(root_url, '') = '{root}' OR starts_with(url, '{stem}/'))))
        SELECT workspace, url, root_url, CASE WHEN workspace = '{workspace}' AND url = '{root}' THEN 'A' ELSE title END AS title, CASE WHEN workspace = '{workspace}' AND url = '{root}' THEN 7 ELSE page_count END AS page_count FROM kept
        UNION ALL SELECT '{workspace}', '{root}', '{root}', 'A', 7 WHERE NOT EXISTS (SELECT 1 FROM r WHERE workspace = '{workspace}' AND url = '{root}')"""


def _web_sql(root: str, suffix: str) -> str:
    return f"""SELECT 'urls{suffix}' AS name, CASE WHEN workspace = 'w' AND (contains(url, '{root}') OR coalesce(root_url, '') = '{root}') THEN 'v' ELSE workspace END AS workspace, url FROM w
        UNION ALL SELECT 'pages{suffix}', CASE WHEN workspace = 'w' AND (contains(url, '{root}') OR contains(coalesce(root_url, ''), '{root}')) THEN 'v' ELSE workspace END, url FROM w"""


QUERIES = {f.__name__: f for f in (
    append_chunks, upsert_chunks, replace_pages, deleted_counts, delete_workspace, delete_local_docs, delete_file, delete_id, rename_workspace, transfer_source, root_source_consolidate, root_source_new,
    ledger_delete_root, url_add_if_absent, envelope_cache_put, cascade_rename, cascade_delete, cascade_outcomes, manifest_cascades, manifest_resets, transfer_folder, transfer_web, link_unlink, links_of_workspace, urls_listed, url_hash_update)}
ORACLE = {
    "append_chunks": _sql("SELECT * FROM chunks UNION ALL SELECT * FROM chunks WHERE doc_id % 20 = 7"),
    "upsert_chunks": _sql("SELECT doc_id, workspace, CASE WHEN doc_id % 20 = 7 THEN 'new' ELSE file_path END AS file_path FROM chunks"),
    "replace_pages": _sql("""SELECT doc_id, workspace, file_path FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks n WHERE n.doc_id % 3 = 0 AND n.file_path IN ('src1', 'src2', 'src7') AND n.workspace = c.workspace AND n.file_path = c.file_path)
        UNION ALL SELECT doc_id + 1000000, workspace, file_path FROM chunks WHERE doc_id % 3 = 0 AND file_path IN ('src1', 'src2', 'src7')"""),
    "deleted_counts": f"""WITH {CHUNKS_SQL} SELECT 'workspace' AS change, count(*) AS n FROM chunks WHERE workspace = 'fr' UNION ALL SELECT 'file', count(*) FROM chunks WHERE workspace = 'en' AND file_path = 'src3'
        UNION ALL SELECT 'ids', count(*) FROM chunks WHERE id IN (SELECT id FROM chunks WHERE doc_id % 10 = 3)""",
    "delete_workspace": _sql("SELECT * FROM chunks WHERE workspace <> 'fr'"),
    "delete_local_docs": _sql("SELECT * FROM chunks WHERE workspace <> 'de'"),
    "delete_file": _sql("SELECT * FROM chunks WHERE NOT (workspace = 'en' AND file_path = 'src3')"),
    "delete_id": _sql("SELECT * FROM chunks WHERE id NOT IN (SELECT id FROM chunks WHERE doc_id % 10 = 3)"),
    "rename_workspace": _sql("SELECT * REPLACE (CASE WHEN workspace = 'es' THEN 'iberia' ELSE workspace END AS workspace) FROM chunks"),
    "transfer_source": _sql("SELECT * REPLACE (CASE WHEN workspace = 'en' AND contains(file_path, 'src5') THEN 'de' ELSE workspace END AS workspace) FROM chunks"),
    "root_source_consolidate": _root_sql("w", "https://a"),
    "root_source_new": _root_sql("v", "https://a/"),
    "ledger_delete_root": f"WITH {_ROOTS_SQL} SELECT * FROM r WHERE NOT (workspace = 'w' AND (url = 'https://a' OR coalesce(root_url, '') = 'https://a'))",
    "url_add_if_absent": f"""WITH {_ROOTS_SQL}, n AS (SELECT * FROM (VALUES ('w', 'https://b', 'https://b', 'other', 1), ('v', 'https://b', 'https://b', 'B', 1), ('w', 'https://new', 'https://new', 'N', 1)) t({ROOT_COLUMNS}))
        SELECT * FROM r UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.workspace = n.workspace AND r.url = n.url)""",
    "envelope_cache_put": """WITH h AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT h, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM h WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""",
    "cascade_rename": f"""WITH {CHUNKS_SQL}, {_TABLES_SQL} SELECT name, workspace, count(*) AS n FROM (SELECT name, CASE WHEN name = 'users' AND lower(workspace) IN ('es', 'ws_es') THEN 'ws_es' WHEN name <> 'users' AND workspace = 'es' THEN 'iberia' ELSE workspace END AS workspace FROM every) GROUP BY ALL""",
    "cascade_delete": f"WITH {CHUNKS_SQL}, {_TABLES_SQL} SELECT name, workspace, count(*) AS n FROM every WHERE workspace <> 'es' OR name IN ('chunks', 'users') GROUP BY ALL",
    "cascade_outcomes": f"""WITH t AS (SELECT name, renamed_to, trim(name) AS o, trim(renamed_to) AS n FROM (VALUES {ATTEMPTS}) t(name, renamed_to)), m AS (SELECT t.*, (SELECT min(lang) FROM documents WHERE lower(lang) = lower(o) OR 'ws_' || lang = o) AS own FROM t)
        SELECT name, renamed_to, CASE WHEN o = '' OR n = '' THEN 'empty' WHEN o = n THEN 'same' WHEN lower(o) IN ('default', 'global', 'shared sources') OR lower(n) IN ('default', 'global', 'shared sources') THEN 'protected' WHEN own IS NULL THEN 'missing'
            WHEN EXISTS (SELECT 1 FROM documents WHERE lower(lang) = lower(n) AND lang <> own) THEN 'taken' ELSE 'renamed' END AS outcome FROM m""",
    "manifest_cascades": f"""WITH {CHUNKS_SQL}, {_TABLES_SQL} SELECT name, workspace, count(*) AS n, 3 AS version FROM (SELECT name, CASE WHEN name = 'users' AND lower(workspace) IN ('es', 'ws_es') THEN 'ws_es' WHEN name <> 'users' AND workspace = 'es' THEN 'iberia' ELSE workspace END AS workspace FROM every)
        WHERE workspace <> 'fr' OR name IN ('chunks', 'users') GROUP BY ALL""",
    "manifest_resets": f"""WITH {CHUNKS_SQL}, {_TABLES_SQL}, n AS (SELECT name, count(*) AS n FROM every WHERE name <> 'users' GROUP BY name UNION ALL SELECT 'users', 3 UNION ALL SELECT 'workspaces', count(DISTINCT lang) FROM documents)
        SELECT step, name, CASE step WHEN 'all' THEN n WHEN 'cleared' THEN CASE WHEN name IN ('chunks', 'cache') THEN 0 ELSE n END ELSE CASE WHEN name = 'workspaces' THEN 1 ELSE 0 END END AS n FROM n, (VALUES ('all'), ('cleared'), ('reset')) t(step)""",
    "transfer_folder": f"""WITH {CHUNKS_SQL}, {_TABLES_SQL}, p AS (SELECT workspace, unnest(string_split(x, ',')) AS x FROM (VALUES ('en', 'src1,src5'), ('de', 'src9'), ('fr', 'src5')) t(workspace, x))
        SELECT 'paths' AS name, workspace, count(*) AS n FROM (SELECT CASE WHEN workspace = 'en' AND x = 'src5' THEN 'de' ELSE workspace END AS workspace FROM p) GROUP BY ALL
        UNION ALL SELECT 'cache', workspace, count(*) FROM (SELECT CASE WHEN workspace = 'en' AND (file_path = 'src5' OR starts_with(file_path, 'src5/')) THEN 'de' ELSE workspace END AS workspace FROM cache) GROUP BY ALL
        UNION ALL SELECT 'chunks', workspace, count(*) FROM (SELECT CASE WHEN workspace = 'en' AND contains(file_path, 'src5') THEN 'de' ELSE workspace END AS workspace FROM chunk) GROUP BY ALL""",
    "transfer_web": f"WITH w AS (SELECT * FROM (VALUES {WEB}) t({WEB_COLUMNS})) {_web_sql('https://a', '')} UNION ALL {_web_sql('https://c', '_like')}",
    "link_unlink": f"""WITH l AS (SELECT * FROM (VALUES {LINKS}) t({LINK_COLUMNS})), n AS (SELECT * FROM (VALUES ('w', 'folder', '/a', 'A2'), ('u', 'web', 'https://x', 'X')) t({LINK_COLUMNS})),
        j AS (SELECT * FROM n UNION ALL SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.workspace = l.workspace AND n.source_type = l.source_type AND n.identifier = l.identifier))
        SELECT * FROM j WHERE NOT (workspace = 'w' AND source_type = 'web' AND identifier = 'https://x')""",
    "links_of_workspace": f"SELECT source_type, identifier FROM (VALUES {LINKS}, ('W', 'web', 'https://y', 'Y')) t({LINK_COLUMNS}) WHERE workspace = 'w'",
    "urls_listed": f"WITH w AS (SELECT * FROM (VALUES {WEB}) t({WEB_COLUMNS})) SELECT 'workspace' AS by, url FROM w WHERE workspace = 'v' UNION ALL SELECT 'url', url FROM w WHERE url = 'https://b'",
    "url_hash_update": f"SELECT workspace, url, CASE WHEN url = 'https://b' THEN 'https://b' ELSE root_url END AS root_url, CASE WHEN url = 'https://b' THEN 6 ELSE page_count END AS page_count FROM (VALUES {WEB}) t({WEB_COLUMNS})",
}
