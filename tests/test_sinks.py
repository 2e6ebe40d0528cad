"""Commits of several writers, change feeds, and listings of whole trees."""

import os
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tempora.operators import changefeed as C
from tempora.operators import rollback
from tempora.plans.sizing import scratch_path
from tempora.schemas import TABLES
from tempora.sources import commits, files, walk
from tempora.sources.feeds import activity_before


@pytest.fixture
def first(spark, store):
    at = scratch_path(spark, "commits")
    roots = [r[0] for r in store.roots.select("root_id").collect()]
    # some tasks name root 6, which the table of roots does not have
    assert commits.commit(spark, at, store, [*roots, 6, None], 0) == 1
    return at


def per_root(state):
    return dict(rows(state.versions.groupBy("root_id").count()))


def test_commit_reads_back_every_table(spark, store, first):
    got = commits.read(spark, first)
    for name, df in store.tables().items():
        assert got.tables()[name].schema.names == TABLES[name].names
        assert rows(got.tables()[name], *df.columns) == rows(df), name


def test_writers_of_other_roots_both_succeed_and_of_the_same_one_does_not(spark, first):
    seen = commits.read(spark, first, 1)
    fewer = seen.with_(versions=seen.versions.where("not is_deleted"))
    all_rows, alive = per_root(seen), per_root(fewer)
    # both have written their rows before either of them publishes
    one, two = commits.write_rows(spark, first, fewer, [1]), commits.write_rows(spark, first, fewer, [2])
    again = commits.write_rows(spark, first, fewer, [2])
    assert commits.publish(spark, first, two, [2], 1) == 2
    assert commits.publish(spark, first, one, [1], 1) == 3
    with pytest.raises(commits.CommitConflict):
        commits.publish(spark, first, again, [2], 1)
    assert commits.publish(spark, first, again, [2], 3) == 4  # read again, tried again
    assert per_root(commits.read(spark, first)) == {**all_rows, 1: alive[1], 2: alive[2]}
    assert per_root(commits.read(spark, first, 2)) == {**all_rows, 2: alive[2]}
    assert per_root(commits.read(spark, first, 1)) == all_rows


def test_a_writer_lost_between_tables_leaves_nothing_visible(spark, first):
    seen = commits.read(spark, first)
    commits.write_rows(spark, first, seen.with_(versions=seen.versions.limit(1)), [1])
    assert commits.versions(spark, first) == [1]
    assert per_root(commits.read(spark, first)) == per_root(seen)


def test_vacuum_honours_readers_and_commits_under_way(spark, first):
    seen = commits.read(spark, first, 1)
    want = per_root(seen)
    none = seen.with_(versions=seen.versions.where("false"))
    for version in (1, 2):
        commits.commit(spark, first, none, [version], version)
    token = commits.write_rows(spark, first, seen, [1])  # not yet named by any entry
    with commits.hold(spark, first, 1) as held:
        assert commits.vacuum(spark, first) == [2]
        assert per_root(held) == want
    assert commits.vacuum(spark, first) == [1]
    assert commits.versions(spark, first) == [3]
    with pytest.raises(FileNotFoundError):
        with commits.hold(spark, first, 1):
            pass
    assert not os.listdir(f"{first}/readers") or all(n.startswith(".") for n in os.listdir(f"{first}/readers"))
    assert commits.publish(spark, first, token, [1], 3) == 4
    assert per_root(commits.read(spark, first)) == {r: n for r, n in want.items() if r != 2}


def test_empty_store_has_version_zero(spark):
    at = scratch_path(spark, "commits")
    assert commits.versions(spark, at) == []
    assert all(df.isEmpty() for df in commits.read(spark, at).tables().values())


def test_root_is_pruned_at_the_files(spark, first):
    plan = commits.read(spark, first).versions.where("root_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "root_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


# ---- change feeds -----------------------------------------------------------------------------


def test_undo_and_redo_are_inverse(spark):
    rng = random.Random(5)
    schema = "id long, part long, a long, b string, c binary"

    def table():
        keys = rng.sample([(i, j) for i in range(8) for j in range(4)], 20)
        return spark.createDataFrame(
            [(*k, rng.choice([None, 1, 2]), rng.choice([None, "x"]), rng.choice([None, b"", b"z"])) for k in keys], schema)

    for _ in range(4):
        old, new = table(), table()
        changes = C.table_changes(old, new, ["id", "part"])
        assert rows(C.undo_table(new, changes, ["id", "part"])) == rows(old)
        assert rows(C.redo_table(old, changes, ["id", "part"])) == rows(new)
        assert C.overtaken(new, changes, ["id", "part"]).isEmpty()
        assert C.table_changes(old, old, ["id", "part"]).isEmpty()


def test_overtaken_changes_are_named(spark):
    cols = "id long, v long"
    old, new = spark.createDataFrame([(1, 1), (2, 1)], cols), spark.createDataFrame([(1, 2), (2, 2), (3, 2)], cols)
    later = spark.createDataFrame([(1, 2), (2, 3)], cols)
    assert rows(C.overtaken(later, C.table_changes(old, new, ["id"]), ["id"]), "id") == [(2,), (3,)]
    kinds = C.table_changes(old, new, ["id"]).select("id", C.change_kind())
    assert rows(kinds) == [(1, "update"), (2, "update"), (3, "insert")]


def test_undone_scan_equals_the_version_before(spark, store):
    from helpers import SMALL

    before = activity_before(spark, SMALL, 3003)
    after = store.with_(**{n: df.where("root_id = 3") for n, df in store.tables().items()})
    undone = rollback.undo_scan(after, C.store_changes(before, after), 3003, "disk gone")
    for name in ("items", "versions", "hashes"):
        assert rows(undone.tables()[name]) == rows(before.tables()[name].select(*undone.tables()[name].columns)), name
    assert rows(undone.scans.where("scan_id = 3003"), "state", "error") == [(6, "disk gone")]


# ---- listings ---------------------------------------------------------------------------------


def test_any_spelling_of_a_path_lists_the_same(spark, tmp_path, monkeypatch):
    (tmp_path / "a b" / "c").mkdir(parents=True)
    (tmp_path / "a b" / "c" / "one.txt").write_text("hello")
    plain = rows(files.list_tree(spark, str(tmp_path), 1, 1), "item_path", "item_type", "size")
    assert [(p.removeprefix(str(tmp_path)), t, s) for p, t, s in plain] == [
        ("/a b", 1, 5), ("/a b/c", 1, 5), ("/a b/c/one.txt", 0, 5)]
    for other in (f"file:{tmp_path}", f"file://{tmp_path}/", f"{tmp_path}//", f"{tmp_path}/a b/.."):
        assert rows(files.list_tree(spark, other, 1, 1), "item_path", "item_type", "size") == plain, other


def test_walk_lists_hidden_empty_linked_and_failing_entries(spark, tmp_path):
    (tmp_path / "a" / "empty").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "_x").write_text("12")
    (tmp_path / "a" / "one").write_text("hello")
    (tmp_path / "a" / "round").symlink_to(tmp_path)
    (tmp_path / "a" / "lost").symlink_to(tmp_path / "nothing")
    os.mkfifo(tmp_path / "a" / "pipe")
    got = {r.item_path.removeprefix(str(tmp_path)): (r.item_type, r.access, r.size)
           for r in walk.walk_tree(spark, f"file:{tmp_path}/", 1, 1).collect()}
    assert got == {"/a": (1, 0, 5), "/a/empty": (1, 0, 0), "/.hidden": (1, 0, 2), "/.hidden/_x": (0, 0, 2),
                   "/a/one": (0, 0, 5), "/a/round": (2, 0, None), "/a/lost": (2, 0, None), "/a/pipe": (3, 0, None)}
    assert rows(walk.walk(spark, f"{tmp_path}/gone")) == [(f"{tmp_path}/gone", 1, 2, None, None)]


def test_one_wide_folder_is_listed_in_batches(spark, tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"f{i}").write_text("x")
    monkeypatch.setattr(walk, "BATCH", 7)
    assert walk.walk(spark, str(tmp_path)).agg(F.count("*"), F.sum("size")).first() == (300, 300)
