"""Workspaces, sources, permissions and entitlements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("strict", "hybrid", "proactive")
RANKS = {"viewer": 1, "analyst": 2, "admin": 3}
ENGINES = ("auto", "tavily", "serper", "duckduckgo")
#: What the names of each provider's models begin with (fixed values).
PROVIDERS = {
    "openai": ("gpt-", "o1-", "o3-", "text-embedding-", "chatgpt-"), "anthropic": ("claude-",), "google_genai": ("gemini-",), "deepseek": ("deepseek-",), "xai": ("grok-",),
    "openrouter": ("openrouter/",), "mistral": ("mistral-", "open-mistral-")}
#: Capabilities of the tiers (fixed values): source types, workspaces, scans, contexts of several kinds, collaboration, server.
TIERS = """('community', 'local,drive,web', 999, true, true, false, false), ('starter', 'local,drive,web', 999, true, true, false, false), ('pro', 'local,drive,web', 999, true, true, false, true),
    ('team', 'local,drive,web', 999, true, true, true, true), ('enterprise', 'local,drive,web,vpc_custom', 999, true, true, true, true)"""
SYSTEM_ADMIN = "admin@system.local"


def resolve_workspace(asked: DataFrame, workspaces: DataFrame) -> DataFrame:
    """asked: x; workspaces: id, workspace_id, name. By id or name without case, else `ws_<n>` by number; null if none."""
    w = workspaces.alias("w")
    by = (F.col("w.workspace_id") == F.col("x")) | (F.lower("w.name") == F.lower("x"))
    number = F.regexp_extract("x", r"^ws_(\d+)$", 1)
    either = by | ((number != "") & (F.col("w.id").cast("string") == number))
    hits = asked.join(w, either, "left").withColumn("_by", F.coalesce(by.cast("int"), F.lit(0)))
    best = Window.partitionBy("x").orderBy(F.desc("_by"), "id")
    return hits.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("x", F.col("name").alias("workspace"))


def grounding_mode(own: Column, shared: Column) -> Column:
    """The workspace's mode if it is one as it is written, else the shared one, else strict."""
    valid = lambda c: F.when(c.isin(*MODES), c)
    return F.coalesce(valid(own), valid(shared), F.lit("strict"))


def mode_asked(x: Column) -> Column:
    """The mode that a setting's text means."""
    m = F.lower(F.trim(F.coalesce(x, F.lit("strict"))))
    like = lambda *parts: m.rlike("|".join(parts))
    return F.when(m.isin(*MODES), m).when(like("hybrid", "balanc"), "hybrid").when(like("pro", "creat"), "proactive").otherwise("strict")


def role_asked(x: Column, default: str) -> Column:
    return F.when(x.isin(*RANKS), x).otherwise(default)


def web_search(own: Column, shared: Column) -> Column:
    """The workspace's flag if it has one, 0 too, else the shared one, else false."""
    return F.coalesce(own.cast("boolean"), shared.cast("boolean"), F.lit(False))


def search_engine(own: Column, shared: Column) -> Column:
    def valid(c: Column) -> Column:
        m = F.lower(F.trim(c))
        return F.when(m == "ddg", "duckduckgo").when(m.isin(*ENGINES), m)

    return F.coalesce(valid(own), valid(shared), F.lit("auto"))


def active_engine(wanted: Column, tavily: Column, serper: Column) -> Column:
    """The label of the engine that answers, by preference and by which keys there are."""
    return (
        F.when((wanted == "tavily") & tavily, "Tavily Search API").when((wanted == "serper") & serper, "Serper Google Search API").when(wanted.isin("duckduckgo", "ddg"), "DuckDuckGo (Free Engine)")
        .when(tavily, "Tavily Search API (Auto)").when(serper, "Serper Google Search API (Auto)").otherwise("DuckDuckGo (Free Engine • Auto)"))


def provider(model: Column, groq: Column, local: Column, fallback: str = "openai") -> Column:
    """The provider that a model's name belongs to; groq, local: whether these are set up."""
    m = F.lower(F.trim(model))
    out = F.when(F.coalesce(model, F.lit("")) == "", fallback)
    for name, starts in PROVIDERS.items():
        out = out.when(m.rlike("^(" + "|".join(s.replace(".", r"\.") for s in starts) + ")"), name)
    shared = m.rlike("^(llama-|mixtral-|gemma)")
    return out.when(shared & groq, "groq").when(local, "local").otherwise(fallback)


def usable_models(models: DataFrame, keys: DataFrame) -> DataFrame:
    """models (provider, model) of the providers that have a key."""
    return models.join(keys.where("key <> ''").select("provider"), "provider", "left_semi")


def allowed(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """tokens: token, role, allowed (array); asked: token, workspace_id, name, role. Whether each request may pass."""
    level = lambda c: sum((F.when(c == r, n).otherwise(0) for r, n in RANKS.items()), F.lit(0))
    t = tokens.select("token", F.col("role").alias("_role"), F.transform("allowed", lambda x: F.lower(x)).alias("_allowed"))
    ok_role = level(F.col("_role")) >= level(F.col("role"))
    ok_scope = F.array_contains("_allowed", "*") | F.array_contains("_allowed", F.lower("workspace_id")) | F.array_contains("_allowed", F.lower("name"))
    j = asked.join(t, "token", "left")
    return j.withColumn("allowed", F.coalesce((F.col("_role") == "admin") | (ok_role & ok_scope), F.lit(False))).drop("_role", "_allowed")


def live_names(users: DataFrame, workspaces: DataFrame) -> DataFrame:
    """users: user, allowed (array of ids or names). The list with ids replaced by names, in its order, each name once."""
    items = users.select("user", F.posexplode("allowed").alias("pos", "item"))
    named = items.join(workspaces.select(F.col("workspace_id").alias("item"), "name"), "item", "left")
    listed = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("name", "item").alias("n"))))  # one user's list
    return named.groupBy("user").agg(F.array_distinct(F.transform(listed, lambda x: x["n"])).alias("allowed"))


def unified_sources(folders: DataFrame, web: DataFrame, drives: DataFrame, links: DataFrame) -> DataFrame:
    """All sources of workspaces in one shape, families in a fixed order."""
    parts = []
    for n, (kind, df) in enumerate((("folder", folders), ("web", web), ("cloud_drive", drives), ("link", links))):
        details = df.details if "details" in df.columns else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        parts.append(df.select("workspace", F.lit(n).alias("family"), F.lit(kind).alias("type"), "identifier", F.coalesce(F.nullif("title", F.lit("")), "identifier").alias("title"), details.alias("details")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def library_sources(sources: DataFrame, libraries: list[str]) -> DataFrame:
    """The first of each (type, identifier) among the library workspaces, in their order, links left out."""
    rank = F.array_position(F.array(*map(F.lit, libraries)), F.col("workspace"))
    kept = sources.where(F.col("workspace").isin(*libraries) & (F.col("type") != "link"))
    w = Window.partitionBy("type", "identifier").orderBy(rank, "title")
    return kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def accept_invites(invites: DataFrame, uses: DataFrame) -> DataFrame:
    """invites: code, max_uses, current_uses, is_active; uses: code. State after all uses that still fit; 0 uses is no limit."""
    n = uses.groupBy("code").agg(F.count("*").alias("n"))
    j = invites.join(n, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    room = F.when(F.col("max_uses") == 0, F.col("n")).otherwise(F.greatest(F.col("max_uses") - F.col("current_uses"), F.lit(0)))
    taken = F.when(F.col("is_active"), F.least("n", room)).otherwise(0)
    used = F.col("current_uses") + taken
    active = F.when(taken > 0, (F.col("max_uses") == 0) | (used < F.col("max_uses"))).otherwise(F.col("is_active"))
    return j.select("code", used.cast("long").alias("current_uses"), active.alias("is_active"))


def accepted(permissions: DataFrame, invites: DataFrame, uses: DataFrame) -> DataFrame:
    """permissions (workspace, user, level) after the uses (code, user, ts) that fit their invite: the last level of each user counts."""
    r = F.row_number().over(Window.partitionBy("code").orderBy("ts"))
    j = uses.withColumn("_r", r).join(invites.where("is_active"), "code")
    fits = j.where((F.col("max_uses") == 0) | (F.col("_r") <= F.col("max_uses") - F.col("current_uses")))
    new = fits.groupBy("workspace", "user").agg(F.max_by("level", "ts").alias("level"))
    return permissions.join(new, ["workspace", "user"], "left_anti").unionByName(new)


def granted(permissions: DataFrame, new: DataFrame) -> DataFrame:
    """permissions with new ones (workspace, user, level) in place of those of the same user and workspace."""
    return permissions.join(new, ["workspace", "user"], "left_anti").unionByName(new)


def revoked(permissions: DataFrame, workspace: str, user: str) -> DataFrame:
    return permissions.where(~((F.col("workspace") == workspace) & (F.col("user") == user)))


def access(level: Column, user: Column) -> Column:
    """Struct of what a user may do with a shared workspace; level: viewer, editor, owner or null."""
    owner = F.coalesce(user, F.lit("")).isin("", "admin", "local_owner")
    lv = F.when(owner, "owner").otherwise(level)
    return F.struct(lv.alias("level"), lv.isNotNull().alias("may_chat"), F.coalesce(lv.isin("owner", "editor"), F.lit(False)).alias("may_add"))


def may_manage(added_by: Column, user: Column) -> Column:
    """Whether a user may take a shared folder away: who added it, the owner's own names, and all of an admin's folders."""
    return F.coalesce(user, F.lit("")).isin("", "admin", "local_owner", SYSTEM_ADMIN) | F.coalesce((added_by == user) | (added_by == "admin"), F.lit(False))


def folder_view(folders: DataFrame, user: str) -> DataFrame:
    """folders (id, workspace, path, added_by) with is_owner and a tag for one user."""
    own = (F.col("added_by") == user) | F.lit(user in ("admin", "local_owner"))
    return folders.withColumns({"is_owner": own, "tag": F.when(own, "👑 Your Folder - Editable").otherwise(F.concat(F.lit("🔒 Read-Only (Added by: "), "added_by", F.lit(")")))})


def folder_added(folders: DataFrame, new: DataFrame) -> DataFrame:
    """Each (workspace, path, added_by) once; one that is there stays as it is."""
    return folders.unionByName(new.join(folders, ["workspace", "path", "added_by"], "left_anti"))


def folder_deleted(folders: DataFrame, folder_id: Column, user: str) -> DataFrame:
    mine = (F.col("added_by") == user) | (F.col("added_by") == "admin") | F.lit(user == SYSTEM_ADMIN)
    return folders.where(~((F.col("id") == folder_id) & mine))


def clean_path(p: Column) -> Column:
    """A folder as it is kept: without spaces and quotes around it, with no slash at its end."""
    return F.regexp_replace(F.regexp_replace(F.trim(p), "^['\"]+|['\"]+$", ""), "(.)/+$", "$1")


def paths_added(workspaces: DataFrame, new: DataFrame) -> DataFrame:
    """workspaces (name, paths) with new ones: paths join those of the same name, whatever its case, each once in order; other names come anew."""
    n = new.select(F.trim("name").alias("_name"), F.filter(F.transform("paths", clean_path), lambda p: p != "").alias("_paths"))
    j = workspaces.join(n, F.lower("name") == F.lower("_name"), "full_outer")
    paths = F.array_distinct(F.concat(F.transform(F.coalesce("paths", F.array().cast("array<string>")), clean_path), F.coalesce("_paths", F.array().cast("array<string>"))))
    return j.select(F.coalesce("name", "_name").alias("name"), paths.alias("paths"))


def path_removed(workspaces: DataFrame, name: str, path: str) -> DataFrame:
    left = F.filter("paths", lambda p: clean_path(p) != clean_path(F.lit(path)))
    return workspaces.withColumn("paths", F.when(F.col("name") == name, left).otherwise(F.col("paths")))


def seeded(workspaces: DataFrame, names: tuple[str, ...] = ("Default", "Global", "Shared Sources")) -> DataFrame:
    """workspaces (name, paths) with the system's own where they are missing."""
    own = workspaces.sparkSession.createDataFrame([(n, []) for n in names], "name string, paths array<string>")
    have = workspaces.select(F.lower("name").alias("_n")).distinct()
    return workspaces.unionByName(own.join(have, F.lower("name") == F.col("_n"), "left_anti"))


def folder_list(first: DataFrame, second: DataFrame) -> DataFrame:
    """(workspace, path, pos): the paths of two tables (workspace, pos, path), those of the first one before, each once."""
    both = first.withColumn("_t", F.lit(0)).unionByName(second.withColumn("_t", F.lit(1))).where("path <> ''")
    seen = both.groupBy("workspace", "path").agg(F.min(F.struct("_t", "pos")).alias("at"))
    return seen.select("workspace", "path", (F.row_number().over(Window.partitionBy("workspace").orderBy("at", "path")) - 1).alias("pos"))


def entitled(asked: DataFrame, tiers: DataFrame) -> DataFrame:
    """asked: tier, source_type, n_workspaces; tiers: tier, source_types (array), max_workspaces, ocr, multi_context, collaboration, server. The six gates."""
    t = tiers.select("tier", "source_types", "max_workspaces", *(F.col(c).alias(f"may_{c}") for c in ("ocr", "multi_context", "collaboration", "server")))
    j = asked.join(t, "tier", "left")
    no = F.lit(False)
    gates = [F.coalesce(f"may_{c}", no).alias(f"may_{c}") for c in ("ocr", "multi_context", "collaboration", "server")]
    source = F.coalesce(F.array_contains("source_types", F.lower(F.trim("source_type"))), no)
    return j.select(*asked.columns, source.alias("may_use_source"), F.coalesce(F.col("n_workspaces") < F.col("max_workspaces"), no).alias("may_add_workspace"), *gates)


def searched(requests: DataFrame, results: DataFrame, most: int) -> DataFrame:
    """requests (q, pref, tavily_key, serper_key, domains, fallback) with (engine, url, rank, widened) of the results each of them gets.

    results: q, engine, within (whether the search was kept to the request's domains), pos, url: what an engine would give.
    A preference for tavily or serper falls back to duckduckgo alone, where a fallback is allowed; auto asks the one engine that
    has a key, tavily before serper, and then duckduckgo. If a search within domains gives nothing and a fallback is allowed, it
    is made once more without domains and without further fallback. An engine without a key gives nothing. At most `most` rows,
    an engine's repeated URLs once. Counts by request decide; no request's results are gathered.
    """
    key = lambda e: F.coalesce(F.trim(f"{e}_key"), F.lit("")) != ""
    pref = F.lower(F.coalesce("pref", F.lit("auto")))
    each = [(e, w) for e in ("tavily", "serper", "duckduckgo") for w in ("true", "false")]
    counts = results.groupBy(F.col("q").alias("_q")).agg(*(F.count_if((F.col("engine") == e) & (F.col("within") == (w == "true"))).alias(f"{e}_{w}") for e, w in each))
    asked = requests.join(counts, F.col("q") == F.col("_q"), "left")

    def engine(within: str, fallback: Column) -> Column:
        has = {e: (F.coalesce(F.col(f"{e}_{within}"), F.lit(0)) > 0) & (F.lit(True) if e == "duckduckgo" else key(e)) for e in ("tavily", "serper", "duckduckgo")}
        last = F.when(has["duckduckgo"], "duckduckgo")
        own = lambda e: F.when(has[e], e).when(fallback, last)
        auto = F.when(key("tavily"), F.when(has["tavily"], "tavily").otherwise(last)).when(key("serper"), F.when(has["serper"], "serper").otherwise(last)).otherwise(last)
        return F.when(pref == "tavily", own("tavily")).when(pref == "serper", own("serper")).when(pref.isin("duckduckgo", "ddg"), last).otherwise(auto)

    narrow, wide = F.when(F.col("domains"), engine("true", F.col("fallback"))), engine("false", F.lit(False))
    first = F.when(F.col("domains"), narrow).otherwise(engine("false", F.col("fallback")))
    again = F.col("domains") & F.col("fallback") & first.isNull()
    chosen = asked.select("q", F.when(again, wide).otherwise(first).alias("engine"), (F.col("domains") & ~again).alias("within"), again.alias("widened")).where("engine IS NOT NULL")
    once = results.groupBy("q", "engine", "within", "url").agg(F.min("pos").alias("pos")).join(chosen, ["q", "engine", "within"])
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("pos", "url"))).where(F.col("rank") <= most)
    return requests.join(ranked.select("q", "engine", "url", "rank", "widened"), "q")
