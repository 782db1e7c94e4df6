"""The bucketed table: what an upsert touches, repeats, crashes and clean-up."""

import datetime as dt
import random

import pytest

from postwright.sources.store import BucketStore

ROW = "id long, n int, at timestamp, extra map<string,string>"


def rows_of(store):
    return {r.id: r.n for r in store.read().collect()}


def test_upserts_equal_a_dictionary_and_keep_few_folders(spark, tmp_path):
    rnd, want, path = random.Random(3), {}, str(tmp_path / "t")
    for batch in range(5):
        new = [(rnd.randrange(60), batch * 100 + i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), {"a": "b"}) for i in range(40)]
        BucketStore(spark, path, buckets=4).upsert(spark.createDataFrame(new, ROW), ["at"], "w", batch)
        want |= {k: n for k, n, _, _ in new}
        assert rows_of(BucketStore(spark, path)) == want
    folders = [b for d in (tmp_path / "t" / "data").iterdir() for b in d.glob("bucket=*")]
    assert len(folders) <= 2 * 4 and len(BucketStore(spark, path).versions()) == 2
    store = BucketStore(spark, path, buckets=99)
    assert store.buckets == 4 and {r.id: r.n for r in store.read(keys=[7, 8, -1]).collect()} == {k: want[k] for k in (7, 8) if k in want}


def test_only_touched_buckets_are_rewritten_and_repeats_change_nothing(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "t"), buckets=8)
    store.upsert(spark.createDataFrame([(i, i, None, None) for i in range(100)] + [(None, 5, None, None)], ROW), writer="w", batch=0)
    before = store.commit()["folders"]
    one = spark.createDataFrame([(3, -3, None, None), (None, 6, None, None)], ROW)
    version = store.upsert(one, writer="w", batch=1)
    assert sum(before[b] != f for b, f in store.commit()["folders"].items()) in (1, 2)
    assert store.upsert(one, writer="w", batch=1) == version == store.upsert(one.limit(0), writer="w", batch=0)
    got = store.read().collect()
    assert len(got) == 101 and {r.id: r.n for r in got}[3] == -3 and [r.n for r in got if r.id is None] == [6]
    wider = spark.createDataFrame([(3, "x")], "id long, note string")
    store.upsert(wider, writer="other", batch=0)
    row = {r.id: r for r in store.read().collect()}
    assert row[3].note == "x" and row[3].n is None and row[4].note is None and row[4].n == 4
    assert {r.id: r.n for r in store.read(version=version).collect()}[3] == -3


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    BucketStore(spark, path, buckets=2).upsert(spark.createDataFrame([(1, 1, None, None)], ROW), writer="w", batch=0)
    new = spark.createDataFrame([(1, 2, None, None), (2, 2, None, None)], ROW)

    def die(self, version, commit):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(BucketStore, "_publish", die)
        with pytest.raises(OSError, match="lost"):
            BucketStore(spark, path).upsert(new, writer="w", batch=1)
    assert rows_of(BucketStore(spark, path)) == {1: 1} and len(list((tmp_path / "t" / "data").iterdir())) == 2
    slow, fast = BucketStore(spark, path), BucketStore(spark, path)
    fast.upsert(new, writer="w", batch=1)
    with pytest.raises(RuntimeError, match="another job"):
        slow._publish(2, {})
    assert rows_of(slow) == {1: 2, 2: 2}
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # the orphan is gone
    assert all(p.name.isdigit() for p in (tmp_path / "t" / "commits").iterdir() if not p.name.startswith("."))


def test_an_empty_table(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="nothing"):
        store.read()
    store.upsert(spark.createDataFrame([], ROW))
    assert store.read().count() == 0 and store.read(keys=[1]).count() == 0
