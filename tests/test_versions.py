"""Versions under several writers, crashes and a grace period."""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest

from pricewright.operators import versions as V


@pytest.fixture(params=["file", "viewfs"])
def folder(request, spark, tmp_path):
    """A folder on the local disk, and one that is only reached through another file system."""
    if request.param == "file":
        return f"file://{tmp_path}/t"
    name = f"m{uuid.uuid4().hex}"
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./x", f"file://{tmp_path}")
    return f"viewfs://{name}/x/t"


def test_repeated_and_refused_versions(spark, folder):
    assert V.head(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        V.read(spark, folder)
    first = V.publish(spark.range(3), folder, "1")
    reader = V.read(spark, folder)
    second = V.publish(spark.range(5), folder, "1")
    assert (second.number, second.replaces) == (first.number + 1, first.version)
    assert (reader.count(), V.read(spark, folder).count(), V.read(spark, folder, pointer=first).count()) == (3, 5, 3)
    before = V._names(spark, f"{folder}/*")
    with pytest.raises(ValueError, match="too few"):
        V.publish(spark.range(0), folder, "1")
    assert V._names(spark, f"{folder}/*") == before and V.read(spark, folder).count() == 5
    assert V.publish(spark.range(0), folder, "none", min_rows=0).number == 3 and V.read(spark, folder).count() == 0


def test_the_second_of_two_writers_fails(spark, folder):
    base = V.publish(spark.range(1), folder)
    mine, other = V.stage(folder, "mine", spark.range(2)), V.stage(folder, "other", spark.range(9))
    V.commit(spark, folder, other, base)
    with pytest.raises(V.Conflict):
        V.commit(spark, folder, mine, base)
    assert V.head(spark, folder).version == other and V.read(spark, folder).count() == 9
    assert not [x for x in V._names(spark, f"{folder}/.*") if not x.endswith(".crc")]


def test_no_update_is_lost_and_no_reader_fails(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    V.publish(spark.range(1), folder)
    seen, errors, done = [], [], threading.Event()

    def look():
        while not done.is_set():
            try:
                seen.append(V.read(spark, folder).count())
            except Exception as error:
                errors.append(error)

    reader = threading.Thread(target=look)
    reader.start()
    add = lambda k: V.update(spark, folder, lambda base: V.read(spark, folder, pointer=base).union(spark.range(k, k + 1)), tries=20)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(1, 9)))
    done.set()
    reader.join()
    assert not errors and seen == sorted(seen)
    assert sorted(r.id for r in V.read(spark, folder).collect()) == list(range(9))
    with pytest.raises(V.Conflict):
        V.update(spark, folder, lambda base: V.publish(spark.range(2), folder) and spark.range(3), tries=2)
    assert V.update(spark, folder, lambda base: None) == V.head(spark, folder)


def test_a_crash_leaves_what_is_served(spark, folder):
    base = V.publish(spark.range(4), folder)

    def change(base):
        return {"a": spark.range(2), "b": lambda at: spark.read.parquet(f"{at}/a").selectExpr("raise_error('lost') AS x", "id")}

    with pytest.raises(Exception, match="lost"):
        V.update(spark, folder, change)
    V.stage(folder, "orphan", spark.range(1))
    assert V.head(spark, folder) == base and V.read(spark, folder).count() == 4
    assert V.clean(spark, folder, grace=3600) == []
    assert len(V.clean(spark, folder, grace=-1)) == 2 and V.read(spark, folder).count() == 4


def test_replaced_versions_stay_for_the_grace(spark, folder):
    pointers = [V.publish(spark.range(k), folder) for k in (1, 2, 3)]
    assert V.clean(spark, folder, grace=1000) == []
    assert sorted(V.clean(spark, folder, grace=10, now=pointers[-1].at + 11)) == sorted(p.version for p in pointers[:2])
    assert V.head(spark, folder) == pointers[-1] and V.read(spark, folder).count() == 3
    assert V.publish(spark.range(4), folder).number == 4 and len(V._names(spark, f"{folder}/_current-*")) == 2


def test_several_tables_are_one_version(spark, folder):
    V.update(spark, folder, lambda base: {"a": spark.range(3), "b": lambda at: spark.read.parquet(f"{at}/a").where("id > 0")}, notes={"run": 7})
    at = V.head(spark, folder)
    assert (V.read(spark, folder, "a", at).count(), V.read(spark, folder, "b", at).count(), at.notes) == (3, 2, {"run": 7})
