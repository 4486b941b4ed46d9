"""Changes of a workspace in all its tables at once, with the conditions under which nothing changes.

`workspaces` has workspace_id and name. Other tables are a workspace's if they have a column `workspace`, and name workspaces in
allow-lists if they have an array column `allowed`. The functions take tables by name and return those that change, with what
came of it; with `manifest.Tables.change` all of them are committed together or not at all.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of workspaces that always are (fixed values).
PROTECTED = ("default", "global", "shared sources")


def _named(name: str) -> Column:
    return F.lower(F.trim("name")) == name.lower()


def renaming(workspaces: DataFrame, name: str, to: str) -> tuple[str, dict[str, str]]:
    """(outcome, names): "renamed" with the workspace's id and its name as it is written; or why it stays: empty, same, protected, missing, taken."""
    old, new = (name or "").strip(), (to or "").strip()
    if not old or not new:
        return "empty", {}
    if old == new:
        return "same", {}
    if old.lower() in PROTECTED or new.lower() in PROTECTED:
        return "protected", {}
    mine = workspaces.where((F.col("workspace_id") == old) | _named(old)).orderBy("name").first()
    if mine is None:
        return "missing", {}
    other = workspaces.where(_named(new) & ~F.col("name").eqNullSafe(F.lit(mine["name"])))
    if not other.isEmpty():
        return "taken", {}
    return "renamed", {"id": mine["workspace_id"] or "ws_" + hashlib.sha256(mine["name"].encode()).hexdigest()[:8], "name": mine["name"], "asked": old, "to": new}


def rename(tables: dict[str, DataFrame], name: str, to: str) -> tuple[dict[str, DataFrame], str]:
    """(changed tables, outcome). Rows go over under the name as it is written or was asked for; allow-lists hold the id from then on."""
    outcome, n = renaming(tables["workspaces"], name, to)
    if outcome != "renamed":
        return {}, outcome
    ws = tables["workspaces"]
    mine = F.col("name").eqNullSafe(F.lit(n["name"]))
    out = {"workspaces": ws.withColumns({"workspace_id": F.when(mine, n["id"]).otherwise(F.col("workspace_id")), "name": F.when(mine, n["to"]).otherwise(F.col("name"))})}
    low = [n["name"].lower(), n["asked"].lower()]
    for t, df in tables.items():
        if t == "workspaces":
            continue
        new = df
        if "workspace" in df.columns:
            new = new.withColumn("workspace", F.when(F.col("workspace").isin(n["name"], n["asked"]), n["to"]).otherwise(F.col("workspace")))
        if "allowed" in df.columns:
            new = new.withColumn("allowed", F.transform("allowed", lambda w: F.when((w != "*") & ((w == n["id"]) | F.lower(w).isin(*low)), F.lit(n["id"])).otherwise(w)))
        if new is not df:
            out[t] = new
    return out, outcome


def delete(tables: dict[str, DataFrame], name: str, keep: tuple[str, ...] = ("chunks",)) -> tuple[dict[str, DataFrame], str]:
    """(changed tables, outcome): all rows of a workspace go, but for those of tables in keep, as its vectors stay. Names count letter by letter."""
    asked = (name or "").strip()
    if not asked:
        return {}, "empty"
    if asked.lower() in PROTECTED:
        return {}, "protected"
    ws = tables["workspaces"]
    if ws.where(F.col("name") == asked).isEmpty():
        return {}, "missing"
    out = {"workspaces": ws.where(~F.col("name").eqNullSafe(F.lit(asked)))}
    for t, df in tables.items():
        if t not in keep and t != "workspaces" and "workspace" in df.columns:
            out[t] = df.where(~F.col("workspace").eqNullSafe(F.lit(asked)))
    return out, "deleted"


def cleared(tables: dict[str, DataFrame], names: tuple[str, ...] = ("chunks", "cache")) -> dict[str, DataFrame]:
    """The named tables without rows, as after a change of the embedding model: vectors and stat cache go, sources and settings stay."""
    return {t: tables[t].limit(0) for t in names if t in tables}


def reset(tables: dict[str, DataFrame], default: str = "Default") -> dict[str, DataFrame]:
    """All tables without rows, but for the default workspace."""
    out = cleared(tables, tuple(tables))
    if "workspaces" in out:
        one = out["workspaces"].sparkSession.range(1).select(F.lit("ws_" + default.lower()).alias("workspace_id"), F.lit(default).alias("name"))
        out["workspaces"] = out["workspaces"].unionByName(one, allowMissingColumns=True)
    return out


def settled(old: DataFrame, changes: dict[str, object]) -> DataFrame:
    """A table of one row of settings, its id 1, with some of them changed; where there is no row, one is made. Other settings stay."""
    one = old.sparkSession.range(1, 2).select(F.col("id").cast(old.schema["id"].dataType).alias("id"))
    row = one.join(old.where("id = 1").dropDuplicates(["id"]), "id", "left")
    return row.select(*((F.lit(changes[c]).cast(f.dataType) if c in changes else F.col(c)).alias(c) for c, f in ((f.name, f) for f in old.schema.fields)))
