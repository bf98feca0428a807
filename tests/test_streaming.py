"""Incremental analysis: two arrivals, one registry."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from f6_files import write_f6
from typesift.streaming import incremental as INC


def test_incremental_upsert(spark, scratch):
    inbox = os.path.join(scratch, "inbox")
    os.makedirs(inbox)
    src = os.path.join(scratch, "src")
    os.makedirs(src)
    write_f6(src)
    reg = os.path.join(scratch, "registry")
    ckpt = os.path.join(scratch, "ckpt")
    for name in ("a_utf8.csv", "b_cp932.txt"):
        os.link(os.path.join(src, name), os.path.join(inbox, name))
    q = INC.start(spark, inbox, reg, checkpoint=ckpt, trigger_once=True)
    q.awaitTermination(300)
    first = INC.read_registry(spark, reg).count()
    os.link(os.path.join(src, "c_sjis.txt"), os.path.join(inbox, "c_sjis.txt"))
    q = INC.start(spark, inbox, reg, checkpoint=ckpt, trigger_once=True)
    q.awaitTermination(300)
    rows = INC.read_registry(spark, reg).collect()
    assert first == 10
    assert len(rows) == 15
    assert {r["file_name"] for r in rows} == {"a_utf8.csv", "b_cp932.txt", "c_sjis.txt"}


def test_registry_versions(spark, scratch):
    from typesift.operators import registry as R
    reg = os.path.join(scratch, "registry")
    assert INC.read_registry(spark, reg).count() == 0
    one = spark.createDataFrame([("f", "c", "TEXT", "TEXT", "utf-8", ",")], R.REGISTRY_SCHEMA)
    kept = R.store(spark, reg)
    assert R.upsert_into(kept, one) == 1
    # the new version is computed from the current one
    R.upsert_into(kept, one.selectExpr("'g' file_name", "column_name", "data_type"))
    assert sorted(r["file_name"] for r in INC.read_registry(spark, reg).collect()) == ["f", "g"]
    # data that no line names is not read, and hinders nobody
    one.limit(0).write.parquet(f"{reg}/data/unfinished")
    assert INC.read_registry(spark, reg).count() == 2 and kept.read(1).count() == 1


def test_interleaved_upserts_are_both_kept(spark, scratch):
    import pytest

    from typesift.operators import registry as R
    from typesift.sources.versioned import Conflict
    kept = R.store(spark, os.path.join(scratch, "registry"))

    def row(name):
        return spark.createDataFrame([(name, "c", "TEXT", "TEXT", "utf-8", ",")], R.REGISTRY_SCHEMA)

    began = []

    def slow(base):  # another writer commits between this one's read and its commit
        began.append(base.count())
        if len(began) == 1:
            R.upsert_into(kept, row("other"))
        return R.upsert(base, row("mine"))

    assert kept.update(slow) == 2 and began == [0, 1]
    assert sorted(r["file_name"] for r in kept.read().collect()) == ["mine", "other"]
    with pytest.raises(Conflict):
        kept.commit(row("late"), 1)
    assert kept.version() == 2 and kept.read().count() == 2


def test_state_merges_to_the_full_run(spark, scratch):
    from typesift.operators import profile as P
    from typesift.operators import profile_state as PS
    from typesift.sources import files as S
    folder, store = os.path.join(scratch, "in"), os.path.join(scratch, "state")
    os.makedirs(folder)

    def put(name, text):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)

    def full():
        cells, _ = S.read_cells(S.probe(S.list_files(spark, folder)))
        return sorted(map(str, P.profile_cells(cells.select(F.split("file_name", "_")[0].alias("file_name"), "column_name", "value")).collect()))

    def merged(state):
        return sorted(map(str, PS.merge(state, "split(file_name, '_')[0]").collect()))

    put("x_1.csv", "a,b\n1,2024-01-01\n02,\n")
    put("x_2.csv", "a,b,c\n3.5,n/a,1\n")
    put("y_1.csv", "a\nabc\n")
    put("z.csv", "only\n")
    state = PS.refresh(spark, folder, store)
    assert merged(state) == full() and state.where("status = 'empty'").count() == 1
    # an old file is not read again: its new bytes, of the same length and time, are not seen
    old = os.path.join(folder, "x_1.csv")
    at = os.stat(old)
    put("x_1.csv", "a,b\nq,2024-01-01\n02,\n")
    os.utime(old, ns=(at.st_atime_ns, at.st_mtime_ns))
    before = merged(state)
    assert merged(PS.refresh(spark, folder, store)) == before
    # new, changed and deleted files
    os.remove(os.path.join(folder, "y_1.csv"))
    put("x_1.csv", "a,b\n1,2024-01-01\n02,\n9,x\n")
    put("w_1.csv", "k\n20240101\n")
    state = PS.refresh(spark, folder, store)
    assert merged(state) == full() and state.where("file_name = 'y_1.csv'").count() == 0
    # other rules: everything is read again
    assert PS.refresh(spark, folder, store, date_patterns=()).where("n_datepat > 0").count() == 0
