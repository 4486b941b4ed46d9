"""Rename matching against a plain greedy loop, and plans that do not multiply."""

import os.path
import random

import pytest

from skein.operators import sync
from skein.plans import sync as plans


def plain(rows):
    """rows: (workspace, path, status, size). Deleted files in order, each with the first new one left that fits."""
    out = []
    for w in {r[0] for r in rows}:
        gone = sorted((r[1], r[3]) for r in rows if r[0] == w and r[2] == "deleted" and r[3] is not None)
        left = sorted((r[1], r[3]) for r in rows if r[0] == w and r[2] == "new" and r[3] is not None)
        lone = len(gone) == 1 or len(left) == 1
        for p, size in gone:
            for q in left:
                same = os.path.splitext(p)[1].lower() == os.path.splitext(q[0])[1].lower() and (lone or os.path.dirname(p) == os.path.dirname(q[0]))
                if size == q[1] and (os.path.basename(p) == os.path.basename(q[0]) or same):
                    out.append((w, p, q[0]))
                    left.remove(q)
                    break
    return sorted(out, key=str)


def pairs(spark, rows):
    return sorted(map(tuple, sync.rename_pairs(spark.createDataFrame(rows, "workspace string, file_path string, status string, size long")).collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_pairs_equal_the_greedy_order(spark, seed):
    rng = random.Random(seed)
    rows, seen = [], set()
    for _ in range(400):
        path = "/".join(rng.choice("AB") for _ in range(rng.randint(0, 2))) + ("/" if rng.random() < 0.9 else "") + rng.choice(["x", "y", ".z", "..q", "a.b"]) + rng.choice(["", ".md", ".MD", ".txt", "."])
        w = rng.choice(["u", "v", "v", None])
        if (w, path) not in seen:
            seen.add((w, path))
            rows.append((w, path, rng.choice(["new", "deleted", "modified", "unchanged"]), rng.choice([0, 0, 5, None])))
    rows += [("one", "a/b.md", "deleted", 7), ("one", "c/d.md", "new", 7), ("one", "c/e.md", "new", 7), ("one", "c/e.txt", "new", 7), ("two", "a/b.md", "deleted", 7), ("two", "a/c.md", "deleted", 7), ("two", "q/z.md", "new", 7)]
    assert pairs(spark, rows) == plain(rows)


def test_a_hot_name_and_empty_tables(spark):
    rows = [("w", f"old/{i:05d}/__init__.py", "deleted", 0) for i in range(3000)] + [("w", f"src/{i:05d}/__init__.py", "new", 0) for i in range(2990)]
    assert pairs(spark, rows) == [("w", f"old/{i:05d}/__init__.py", f"src/{i:05d}/__init__.py") for i in range(2990)]
    assert pairs(spark, []) == [] and pairs(spark, [("w", "a", "deleted", 1)]) == []


@pytest.mark.parametrize("name", ["rename_diff", "folder_index", "change_summary", "change_summary_sources", "stat_cache_rename"])
def test_few_scans_are_planned(spark, sf_dir, name):
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() < 10


def test_folder_index_of_files_that_move_change_and_go(spark):
    stat = "workspace string, file_path string, mtime double, size long"
    cache = spark.createDataFrame([("w", f"a/{x}.md", 1.0, n) for x, n in (("keep", 1), ("move", 2), ("edit", 3), ("drop", 4))] + [("v", "a/keep.md", 1.0, 1)], stat)
    disk = spark.createDataFrame([("w", "a/keep.md", 1.0, 1), ("w", "b/move.md", 1.0, 2), ("w", "a/edit.md", 2.0, 3), ("w", "a/add.md", 1.0, 9), ("v", "a/keep.md", 1.0, 1)], stat)
    chunks = cache.selectExpr("workspace", "file_path", "concat(file_path, '#1') AS id").unionByName(cache.selectExpr("workspace", "file_path", "concat(file_path, '#2') AS id"))
    got, now = sync.index_folders(chunks, disk, cache, lambda files: files.selectExpr("workspace", "file_path", "'read' AS id"))
    assert sorted(map(tuple, got.collect())) == sorted(
        [(w, "a/keep.md", f"a/keep.md#{i}") for w in "vw" for i in (1, 2)] + [("w", "b/move.md", f"a/move.md#{i}") for i in (1, 2)] + [("w", "a/edit.md", "read"), ("w", "a/add.md", "read")])
    assert now.count() == 5
    again, _ = sync.index_folders(got, disk, disk, lambda files: files.selectExpr("workspace", "file_path", "'read' AS id"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
