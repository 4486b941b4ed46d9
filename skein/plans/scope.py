"""Queries of workspaces and permissions, over inline fixtures and re-labelled tables; and of event streams read as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scope
from ..schema import fixture, table
from ..streaming import events

WORKSPACES = "(1, 'wid1', 'Default'), (2, 'wid2', 'Global'), (3, 'wid3', 'Research')"
WS = f"w AS (SELECT * FROM (VALUES {WORKSPACES}) t(id, workspace_id, name))"


def _ws(spark):
    return fixture(spark, "id, workspace_id, name", WORKSPACES)


def _lists(spark, columns, values, name):
    """A fixture whose last column is a list written with commas."""
    return fixture(spark, columns, values).withColumn(name, F.when(F.col(name) == "", F.array().cast("array<string>")).otherwise(F.split(name, ",")))


ASKED = "('default'), ('wid2'), ('ws_3'), ('RESEARCH'), ('none'), ('ws_9')"


def resolve_workspace(spark, d):
    return scope.resolve_workspace(fixture(spark, "x", ASKED), _ws(spark))


TOKENS = "('t1', 'admin', ''), ('t2', 'analyst', 'Research,wid1'), ('t3', 'viewer', '*')"
REQUESTS = "('t1', 'wid9', 'X', 'admin'), ('t2', 'wid3', 'research', 'viewer'), ('t2', 'wid1', 'Default', 'analyst'), ('t2', 'wid2', 'Global', 'viewer'), ('t2', 'wid1', 'Default', 'admin'), ('t3', 'wid2', 'Global', 'viewer'), ('t3', 'wid2', 'Global', 'analyst'), ('t4', 'wid1', 'Default', 'viewer')"


def token_access(spark, d):
    return scope.allowed(_lists(spark, "token, role, allowed", TOKENS, "allowed"), fixture(spark, "token, workspace_id, name, role", REQUESTS))


LISTS = "('u1', 'wid3,Other,wid1,Research'), ('u2', 'wid2')"


def allowlist_names(spark, d):
    return scope.live_names(_lists(spark, "user, allowed", LISTS, "allowed"), _ws(spark)).select("user", F.array_join("allowed", ",").alias("allowed"))


FOLDERS = "('w1', '/a', ''), ('w2', '/b', 'B'), ('lib', '/a', 'Lib A')"
WEB = "('w1', 'https://x', 'X'), ('lib', 'https://x', 'X'), ('lib2', 'https://x', 'Y')"
DRIVES = "('lib', 'd1', NULL)"
LINKED = "('lib', '/c', 'C')"
_SOURCE = "workspace, identifier, title"


def _sources(spark):
    drives = fixture(spark, _SOURCE, DRIVES).withColumn("title", F.col("title").cast("string")).withColumn("details", F.create_map(F.lit("provider"), F.lit("p")))
    return scope.unified_sources(fixture(spark, _SOURCE, FOLDERS), fixture(spark, _SOURCE, WEB), drives, fixture(spark, _SOURCE, LINKED))


def unified_sources(spark, d):
    return _sources(spark).select("workspace", "family", "type", "identifier", "title", F.size("details").alias("n_details"))


def library_sources(spark, d):
    return scope.library_sources(_sources(spark), ["lib", "lib2"]).select("workspace", "type", "identifier", "title")


SETTINGS = "(1, 'Hybrid', 'strict'), (2, NULL, 'proactive'), (3, 'odd', NULL), (4, '', 'odd'), (5, 'hybrid', 'strict'), (6, 'proactive', NULL)"


def grounding_mode(spark, d):
    return fixture(spark, "id, own, shared", SETTINGS).select("id", scope.grounding_mode(F.col("own"), F.col("shared")).alias("mode"))


MODES_ASKED = "(1, ' Hybrid'), (2, 'balanced'), (3, 'PRO'), (4, 'creative'), (5, 'x'), (6, NULL), (7, 'strict')"


def mode_asked(spark, d):
    return fixture(spark, "id, x", MODES_ASKED).select("id", scope.mode_asked(F.col("x")).alias("mode"), scope.role_asked(F.col("x"), "viewer").alias("role"))


FLAGS = "(1, true, false), (2, false, true), (3, NULL, true), (4, NULL, NULL)"


def web_search_flag(spark, d):
    return fixture(spark, "id, own, shared", FLAGS).select("id", scope.web_search(F.col("own"), F.col("shared")).alias("on"))


ENGINES = "(1, 'ddg', 'tavily', true, true), (2, NULL, ' Serper', true, true), (3, 'odd', NULL, true, false), (4, 'tavily', NULL, false, true), (5, NULL, NULL, false, false), (6, 'auto', 'serper', false, true), (7, 'serper', NULL, false, false)"


def search_engine(spark, d):
    x = fixture(spark, "id, own, shared, tavily, serper", ENGINES).withColumn("engine", scope.search_engine(F.col("own"), F.col("shared")))
    return x.select("id", "engine", scope.active_engine(F.col("engine"), F.col("tavily"), F.col("serper")).alias("label"))


MODELS = "(1, 'gpt-4o', false, false), (2, 'Gemini-2', true, true), (3, 'llama-3', true, false), (4, 'llama-3', false, true), (5, 'gemma2', false, false), (6, 'own', false, true), (7, '', true, true), (8, 'open-mistral-7b', false, false), (9, 'openrouter/x', false, false), (10, 'o1-x', false, false)"


def model_provider(spark, d):
    return fixture(spark, "id, model, groq, local", MODELS).select("id", scope.provider(F.col("model"), F.col("groq"), F.col("local")).alias("provider"))


def usable_models(spark, d):
    models = fixture(spark, "provider, model", "('a', 'm1'), ('a', 'm2'), ('b', 'm3'), ('c', 'm4')")
    return scope.usable_models(models, fixture(spark, "provider, key", "('a', 'k'), ('a', 'k2'), ('b', '')"))


INVITES = "('a', 'w1', 'viewer', 2, 0, true), ('b', 'w1', 'editor', 0, 5, true), ('c', 'w2', 'viewer', 3, 2, true), ('d', 'w2', 'editor', 1, 0, false), ('e', 'w3', 'viewer', 4, 4, true)"
INVITE_COLUMNS = "code, workspace, level, max_uses, current_uses, is_active"
USES = "('a', 'x', 1), ('a', 'y', 2), ('a', 'z', 3), ('b', 'x', 4), ('c', 'x', 5), ('c', 'x', 6), ('d', 'x', 7)"
PERMISSIONS = "('w1', 'y', 'owner'), ('w1', 'q', 'viewer'), ('w2', 'p', 'editor')"


def invite_state(spark, d):
    return scope.accept_invites(fixture(spark, INVITE_COLUMNS, INVITES), fixture(spark, "code, user, ts", USES))


def invite_permissions(spark, d):
    return scope.accepted(fixture(spark, "workspace, user, level", PERMISSIONS), fixture(spark, INVITE_COLUMNS, INVITES), fixture(spark, "code, user, ts", USES))


def invite_lookup(spark, d):
    return fixture(spark, INVITE_COLUMNS, INVITES).where("is_active AND code IN ('a', 'd')").select("code", "workspace", "level")


def grant_revoke(spark, d):
    p = scope.granted(fixture(spark, "workspace, user, level", PERMISSIONS), fixture(spark, "workspace, user, level", "('w1', 'q', 'editor'), ('w3', 'n', 'viewer')"))
    return scope.revoked(p, "w2", "p")


ACCESS = "(1, 'admin', NULL), (2, 'u', 'viewer'), (3, 'u', 'editor'), (4, 'u', NULL), (5, '', 'viewer')"


def sharing_access(spark, d):
    return fixture(spark, "id, user, level", ACCESS).select("id", scope.access(F.col("level"), F.col("user")).alias("a")).select("id", "a.level", "a.may_chat", "a.may_add")


SHARED = "('f1', 'w', '/a', 'u'), ('f2', 'w', '/b', 'admin'), ('f3', 'w', '/c', 'v')"
SHARED_COLUMNS = "id, workspace, path, added_by"


def folder_view(spark, d):
    return scope.folder_view(fixture(spark, SHARED_COLUMNS, SHARED), "u").withColumn("may_manage", scope.may_manage(F.col("added_by"), F.lit("u")))


def folder_upsert_delete(spark, d):
    added = scope.folder_added(fixture(spark, SHARED_COLUMNS, SHARED), fixture(spark, SHARED_COLUMNS, "('f4', 'w', '/a', 'u'), ('f5', 'w', '/a', 'v')"))
    return scope.folder_deleted(scope.folder_deleted(added, F.lit("f3"), "u"), F.lit("f2"), "u")


PATHS = "('Default', '/a,/b/'), ('Research', '/c')"


def workspace_paths(spark, d):
    w = scope.paths_added(_lists(spark, "name, paths", PATHS, "paths"), _lists(spark, "name, paths", "('default', ''' /b '',/d'), ('New', '/e/')", "paths"))
    return scope.path_removed(scope.seeded(w), "Research", "/c/").select("name", F.array_join("paths", ",").alias("paths"))


FOLDER_ROWS = "('w', 0, '/a'), ('w', 1, '/b'), ('v', 0, '/c')"
MORE_FOLDERS = "('w', 0, '/b'), ('w', 1, '/z'), ('w', 2, ''), ('u', 0, '/y')"


def folder_list(spark, d):
    return scope.folder_list(fixture(spark, "workspace, pos, path", FOLDER_ROWS), fixture(spark, "workspace, pos, path", MORE_FOLDERS))


GATES = "('community', 'Local', 1), ('community', 'vpc_custom', 999), ('pro', 'web', 998), ('team', ' drive ', 0), ('enterprise', 'vpc_custom', 10), ('none', 'web', 0)"
TIER_COLUMNS = "tier, source_types, max_workspaces, ocr, multi_context, collaboration, server"


def entitlements(spark, d):
    return scope.entitled(fixture(spark, "tier, source_type, n_workspaces", GATES), _lists(spark, TIER_COLUMNS, scope.TIERS, "source_types"))


def tier_lines(spark, d):
    """A line for each tier: its sources, and what it opens."""
    t = _lists(spark, TIER_COLUMNS, scope.TIERS, "source_types")
    opens = [F.when(F.col(c), F.lit(c)) for c in ("ocr", "multi_context", "collaboration", "server")]
    return t.select("tier", F.concat_ws(" | ", F.concat(F.lit("sources: "), F.array_join("source_types", ", ")), F.concat(F.lit("up to "), "max_workspaces", F.lit(" workspaces")), F.concat_ws(", ", *opens)).alias("line"))


USERS = "('u1', 'admin', '*'), ('u2', 'analyst', 'Default'), ('u3', 'viewer', 'Default,Research')"
USER_TOKENS = "('k1', 'u1'), ('k2', 'u2'), ('k3', 'u2'), ('k4', 'u3')"


def user_cascade(spark, d):
    """Users and tokens after one user is made and another goes with all tokens."""
    users = fixture(spark, "user, role, allowed", USERS).unionByName(fixture(spark, "user, role, allowed", "('u4', 'boss', 'Default')").withColumn("role", scope.role_asked(F.col("role"), "analyst")))
    left = users.where("user <> 'u2'")
    return left.join(fixture(spark, "token, user", USER_TOKENS), "user", "left").select("user", "role", "token")


SEATS = "(1), (5), (8)"


def seat_price(spark, d):
    return fixture(spark, "seats", SEATS).select("seats", (F.lit(79) + 15 * F.greatest(F.col("seats") - 5, F.lit(0))).alias("price"))


def table_counts(spark, d):
    """Row counts of the dimension tables."""
    names = ("customer", "supplier", "nation", "region")
    out = None
    for n in names:
        one = table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def event_windows(spark, d):
    return events.windows(table(spark, d, "events"), "1 day")


def session_counts(spark, d):
    return events.sessions(table(spark, d, "events"), "2 hours").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


_SRC = f"""src AS (SELECT workspace, 0 AS family, 'folder' AS type, identifier, coalesce(nullif(title, ''), identifier) AS title, 0 AS n_details FROM (VALUES {FOLDERS}) t({_SOURCE})
    UNION ALL SELECT workspace, 1, 'web', identifier, coalesce(nullif(title, ''), identifier), 0 FROM (VALUES {WEB}) t({_SOURCE}) UNION ALL SELECT workspace, 2, 'cloud_drive', identifier, coalesce(nullif(title, ''), identifier), 1 FROM (VALUES {DRIVES}) t({_SOURCE})
    UNION ALL SELECT workspace, 3, 'link', identifier, coalesce(nullif(title, ''), identifier), 0 FROM (VALUES {LINKED}) t({_SOURCE}))"""
_RANK = "CASE {} WHEN 'viewer' THEN 1 WHEN 'analyst' THEN 2 WHEN 'admin' THEN 3 ELSE 0 END"
_INV = f"inv AS (SELECT * FROM (VALUES {INVITES}) t({INVITE_COLUMNS})), uses AS (SELECT * FROM (VALUES {USES}) t(code, \"user\", ts))"
_MODE = "CASE WHEN {0} IN ('strict', 'hybrid', 'proactive') THEN {0} END"
_ENGINE = "CASE WHEN lower(trim({0})) = 'ddg' THEN 'duckduckgo' WHEN lower(trim({0})) IN ('auto', 'tavily', 'serper', 'duckduckgo') THEN lower(trim({0})) END"
QUERIES = {f.__name__: f for f in (
    resolve_workspace, token_access, allowlist_names, unified_sources, library_sources, grounding_mode, mode_asked, web_search_flag, search_engine, model_provider, usable_models, invite_state, invite_permissions,
    invite_lookup, grant_revoke, sharing_access, folder_view, folder_upsert_delete, workspace_paths, folder_list, entitlements, tier_lines, user_cascade, seat_price, table_counts, event_windows, session_counts)}
ORACLE = {
    "resolve_workspace": f"""WITH {WS}, j AS (SELECT x, w.id, w.name, coalesce((w.workspace_id = x OR lower(w.name) = lower(x))::INT, 0) AS best FROM (VALUES {ASKED}) t(x)
        LEFT JOIN w ON w.workspace_id = x OR lower(w.name) = lower(x) OR (regexp_matches(x, '^ws_[0-9]+$') AND w.id::VARCHAR = regexp_extract(x, '^ws_([0-9]+)$', 1)))
        SELECT x, name AS workspace FROM j QUALIFY row_number() OVER (PARTITION BY x ORDER BY best DESC, id) = 1""",
    "token_access": f"""WITH k AS (SELECT token, role, string_split(lower(allowed), ',') AS allowed FROM (VALUES {TOKENS}) t(token, role, allowed))
        SELECT r.*, coalesce(k.role = 'admin' OR ({_RANK.format('k.role')} >= {_RANK.format('r.role')} AND (list_contains(k.allowed, '*') OR list_contains(k.allowed, lower(r.workspace_id)) OR list_contains(k.allowed, lower(r.name)))), false) AS allowed
        FROM (VALUES {REQUESTS}) r(token, workspace_id, name, role) LEFT JOIN k USING (token)""",
    "allowlist_names": f"""WITH {WS}, i AS (SELECT "user", unnest(string_split(allowed, ',')) AS item, generate_subscripts(string_split(allowed, ','), 1) AS pos FROM (VALUES {LISTS}) t("user", allowed)),
        n AS (SELECT "user", coalesce(w.name, item) AS name, min(pos) AS pos FROM i LEFT JOIN w ON w.workspace_id = item GROUP BY ALL) SELECT "user", string_agg(name, ',' ORDER BY pos) AS allowed FROM n GROUP BY "user\"""",
    "unified_sources": f"WITH {_SRC} SELECT * FROM src",
    "library_sources": f"WITH {_SRC} SELECT workspace, type, identifier, title FROM src WHERE workspace IN ('lib', 'lib2') AND type <> 'link' QUALIFY row_number() OVER (PARTITION BY type, identifier ORDER BY workspace <> 'lib', title) = 1",
    "grounding_mode": f"SELECT id, coalesce({_MODE.format('own')}, {_MODE.format('shared')}, 'strict') AS mode FROM (VALUES {SETTINGS}) t(id, own, shared)",
    "mode_asked": f"""SELECT id, CASE WHEN m IN ('strict', 'hybrid', 'proactive') THEN m WHEN contains(m, 'hybrid') OR contains(m, 'balanc') THEN 'hybrid' WHEN contains(m, 'pro') OR contains(m, 'creat') THEN 'proactive' ELSE 'strict' END AS mode,
        CASE WHEN x IN ('viewer', 'analyst', 'admin') THEN x ELSE 'viewer' END AS role FROM (SELECT *, lower(trim(coalesce(x, 'strict'))) AS m FROM (VALUES {MODES_ASKED}) t(id, x))""",
    "web_search_flag": f'SELECT id, coalesce(own, shared, false) AS "on" FROM (VALUES {FLAGS}) t(id, own, shared)',
    "search_engine": f"""SELECT id, engine, CASE WHEN engine = 'tavily' AND tavily THEN 'Tavily Search API' WHEN engine = 'serper' AND serper THEN 'Serper Google Search API' WHEN engine = 'duckduckgo' THEN 'DuckDuckGo (Free Engine)'
        WHEN tavily THEN 'Tavily Search API (Auto)' WHEN serper THEN 'Serper Google Search API (Auto)' ELSE 'DuckDuckGo (Free Engine • Auto)' END AS label
        FROM (SELECT *, coalesce({_ENGINE.format('own')}, {_ENGINE.format('shared')}, 'auto') AS engine FROM (VALUES {ENGINES}) t(id, own, shared, tavily, serper))""",
    "model_provider": "SELECT id, CASE WHEN model = '' THEN 'openai' " + " ".join("WHEN " + " OR ".join(f"starts_with(lower(model), '{x}')" for x in xs) + f" THEN '{n}'" for n, xs in scope.PROVIDERS.items())
        + f" WHEN (starts_with(lower(model), 'llama-') OR starts_with(lower(model), 'mixtral-') OR starts_with(lower(model), 'gemma')) AND groq THEN 'groq' WHEN local THEN 'local' ELSE 'openai' END AS provider FROM (VALUES {MODELS}) t(id, model, groq, local)",
    "usable_models": "SELECT * FROM (VALUES ('a', 'm1'), ('a', 'm2'), ('b', 'm3'), ('c', 'm4')) m(provider, model) WHERE provider IN (SELECT provider FROM (VALUES ('a', 'k'), ('a', 'k2'), ('b', '')) k(provider, key) WHERE key <> '')",
    "invite_state": f"""WITH {_INV}, n AS (SELECT inv.*, (SELECT count(*) FROM uses WHERE uses.code = inv.code) AS n FROM inv), s AS (SELECT *, CASE WHEN NOT is_active THEN 0 WHEN max_uses = 0 THEN n ELSE least(n, greatest(0, max_uses - current_uses)) END AS taken FROM n)
        SELECT code, (current_uses + taken)::BIGINT AS current_uses, CASE WHEN taken > 0 THEN max_uses = 0 OR current_uses + taken < max_uses ELSE is_active END AS is_active FROM s""",
    "invite_permissions": f"""WITH {_INV}, p AS (SELECT * FROM (VALUES {PERMISSIONS}) t(workspace, "user", level)), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts) AS r FROM uses),
        n AS (SELECT workspace, "user", max_by(level, ts) AS level FROM r JOIN inv USING (code) WHERE is_active AND (max_uses = 0 OR r <= max_uses - current_uses) GROUP BY ALL)
        SELECT * FROM n UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.workspace = p.workspace AND n."user" = p."user")""",
    "invite_lookup": f"WITH {_INV} SELECT code, workspace, level FROM inv WHERE is_active AND code IN ('a', 'd')",
    "grant_revoke": f"""WITH p AS (SELECT * FROM (VALUES {PERMISSIONS}) t(workspace, "user", level)), n AS (SELECT * FROM (VALUES ('w1', 'q', 'editor'), ('w3', 'n', 'viewer')) t(workspace, "user", level))
        SELECT * FROM (SELECT * FROM n UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.workspace = p.workspace AND n."user" = p."user")) WHERE NOT (workspace = 'w2' AND "user" = 'p')""",
    "sharing_access": f"""SELECT id, lv AS level, lv IS NOT NULL AS may_chat, coalesce(lv IN ('owner', 'editor'), false) AS may_add FROM (SELECT id, CASE WHEN coalesce("user", '') IN ('', 'admin', 'local_owner') THEN 'owner' ELSE level END AS lv FROM (VALUES {ACCESS}) t(id, "user", level))""",
    "folder_view": f"""SELECT *, added_by = 'u' AS is_owner, CASE WHEN added_by = 'u' THEN '👑 Your Folder - Editable' ELSE '🔒 Read-Only (Added by: ' || added_by || ')' END AS tag, added_by IN ('u', 'admin') AS may_manage FROM (VALUES {SHARED}) t({SHARED_COLUMNS})""",
    "folder_upsert_delete": f"""WITH f AS (SELECT * FROM (VALUES {SHARED}) t({SHARED_COLUMNS})), n AS (SELECT * FROM (VALUES ('f4', 'w', '/a', 'u'), ('f5', 'w', '/a', 'v')) t({SHARED_COLUMNS})),
        j AS (SELECT * FROM f UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.workspace = n.workspace AND f.path = n.path AND f.added_by = n.added_by)) SELECT * FROM j WHERE NOT (id IN ('f3', 'f2') AND added_by IN ('u', 'admin'))""",
    "workspace_paths": f"""WITH a AS (SELECT name, unnest(string_split(paths, ',')) AS p, generate_subscripts(string_split(paths, ','), 1) AS pos FROM (VALUES {PATHS}) t(name, paths)),
        b AS (SELECT name, unnest(string_split(paths, ',')) AS p, 100 + generate_subscripts(string_split(paths, ','), 1) AS pos FROM (VALUES ('default', ''' /b '',/d'), ('New', '/e/')) t(name, paths)),
        c AS (SELECT coalesce((SELECT min(a.name) FROM a WHERE lower(a.name) = lower(x.name)), x.name) AS name, regexp_replace(regexp_replace(trim(p), '^[''"]+|[''"]+$', '', 'g'), '(.)/+$', '\\1') AS p, pos FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x),
        g AS (SELECT name, p, min(pos) AS pos FROM c GROUP BY ALL), named AS (SELECT DISTINCT name FROM g UNION SELECT n FROM (VALUES ('Default'), ('Global'), ('Shared Sources')) s(n) WHERE lower(n) NOT IN (SELECT lower(name) FROM g))
        SELECT named.name, coalesce(string_agg(p, ',' ORDER BY pos) FILTER (NOT (named.name = 'Research' AND p = '/c')), '') AS paths FROM named LEFT JOIN g USING (name) GROUP BY named.name""",
    "folder_list": f"""WITH b AS (SELECT *, 0 AS t FROM (VALUES {FOLDER_ROWS}) x(workspace, pos, path) UNION ALL SELECT *, 1 FROM (VALUES {MORE_FOLDERS}) x(workspace, pos, path)),
        f AS (SELECT workspace, path, min(t * 1000 + pos) AS seen FROM b WHERE path <> '' GROUP BY ALL) SELECT workspace, path, row_number() OVER (PARTITION BY workspace ORDER BY seen, path) - 1 AS pos FROM f""",
    "entitlements": f"""SELECT a.*, coalesce(list_contains(string_split(source_types, ','), lower(trim(source_type))), false) AS may_use_source, coalesce(n_workspaces < max_workspaces, false) AS may_add_workspace, coalesce(ocr, false) AS may_ocr,
        coalesce(multi_context, false) AS may_multi_context, coalesce(collaboration, false) AS may_collaboration, coalesce(server, false) AS may_server FROM (VALUES {GATES}) a(tier, source_type, n_workspaces) LEFT JOIN (VALUES {scope.TIERS}) t({TIER_COLUMNS}) USING (tier)""",
    "tier_lines": f"""SELECT tier, 'sources: ' || replace(source_types, ',', ', ') || ' | up to ' || max_workspaces || ' workspaces | ' || concat_ws(', ', CASE WHEN ocr THEN 'ocr' END, CASE WHEN multi_context THEN 'multi_context' END,
        CASE WHEN collaboration THEN 'collaboration' END, CASE WHEN server THEN 'server' END) AS line FROM (VALUES {scope.TIERS}) t({TIER_COLUMNS})""",
    "user_cascade": f"""WITH u AS (SELECT * FROM (VALUES {USERS}) t("user", role, allowed) UNION ALL SELECT 'u4', 'analyst', 'Default'), k AS (SELECT * FROM (VALUES {USER_TOKENS}) t(token, "user"))
        SELECT u."user", role, token FROM u LEFT JOIN k USING ("user") WHERE u."user" <> 'u2'""",
    "seat_price": f"SELECT seats, 79 + 15 * greatest(seats - 5, 0) AS price FROM (VALUES {SEATS}) t(seats)",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("customer", "supplier", "nation", "region")),
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "session_counts": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)
        SELECT user_id, sum(fresh)::BIGINT AS n_sessions, count(*) AS n_events FROM e GROUP BY user_id""",
}
