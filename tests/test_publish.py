"""Versions that are seen whole or not at all."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from lapsight.sources import publish as p


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/out"


def values(df):
    return sorted(r[0] for r in df.select("v").collect())


def frame(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "v long")


@pytest.mark.parametrize("form", p.FORMATS)
def test_versions_and_forms(spark, root, form):
    with pytest.raises(LookupError):
        p.read_table(spark, root, "a")
    assert p.publish(spark, root, {"a": frame(spark, 1), "b": frame(spark, 5)}, {"bundle": {"ä": [1, None]}}, form) == 1
    first = p.read_table(spark, root, "a")
    assert p.publish(spark, root, {"a": frame(spark, 2, 3)}, form=form) == 2
    assert values(p.read_table(spark, root, "a")) == [2, 3] and values(first) == [1]  # who has begun keeps its version
    assert values(p.read_table(spark, root, "b", 1)) == [5] and p.read_document(spark, root, "bundle", 1) == {"ä": [1, None]}
    with pytest.raises(LookupError, match="no table b"):
        p.read_table(spark, root, "b")


def test_a_failed_write_leaves_the_old_version(spark, root):
    p.publish(spark, root, {"a": frame(spark, 1), "b": frame(spark, 1)})
    broken = frame(spark, 7).select(F.raise_error(F.lit("planted")).cast("long").alias("v"))
    with pytest.raises(Exception, match="planted"):
        p.publish(spark, root, {"a": frame(spark, 2), "b": broken})
    assert p.versions(spark, root) == [1] and values(p.read_table(spark, root, "a")) == [1]
    assert len(os.listdir(root.removeprefix("file://") + "/versions")) == 1


def test_a_killed_write_is_never_seen_and_cleaned(spark, root):
    p.publish(spark, root, {"a": frame(spark, 1)})
    folder = root.removeprefix("file://") + "/versions/dead"
    frame(spark, 9).write.parquet(f"{root}/versions/dead/a")  # a writer that died before its entry
    assert values(p.read_table(spark, root, "a")) == [1]
    assert p.clean(spark, root) == [] and os.path.isdir(folder)  # it might still be writing
    assert p.clean(spark, root, older_s=0) == ["dead"] and values(p.read_table(spark, root, "a")) == [1]


def test_roll_back_and_clean(spark, root):
    for v in (1, 2, 3):
        p.publish(spark, root, {"a": frame(spark, v)})
    assert p.roll_back(spark, root, 1) == 4 and values(p.read_table(spark, root, "a")) == [1]
    assert p.publish(spark, root, {"a": frame(spark, 5)}) == 5
    assert len(p.clean(spark, root, keep=2, older_s=0)) == 2
    assert values(p.read_table(spark, root, "a")) == [5] and values(p.read_table(spark, root, "a", 4)) == [1]


def test_one_of_two_writers_wins(spark, root):
    p.publish(spark, root, {"a": frame(spark, 0)})
    with pytest.raises(p.Conflict, match="expected"):
        p.publish(spark, root, {"a": frame(spark, 1)}, expected=0)
    gate, found = threading.Barrier(2), []
    move = p._Files.move

    def both(self, source, target):
        gate.wait()
        return move(self, source, target)

    def write(v):
        try:
            found.append(p.publish(spark, root, {"a": frame(spark, v)}))
        except p.Conflict as error:
            found.append(error)

    p._Files.move = both
    try:
        threads = [threading.Thread(target=write, args=(v,)) for v in (1, 2)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    finally:
        p._Files.move = move
    # local disks check and rename in two steps, so both may have renamed; the log still has one entry 2 with one whole version
    assert p.versions(spark, root) == [1, 2] and values(p.read_table(spark, root, "a")) in ([1], [2]) and 2 in found


def test_a_changed_document_is_an_error(spark, root):
    p.publish(spark, root, {}, {"bundle": [1]})
    folder = p.manifest_of(spark, root)["folder"]
    with open(f"{root.removeprefix('file://')}/{folder}/bundle.json", "w") as f:
        f.write("[2]")
    os.remove(f"{root.removeprefix('file://')}/{folder}/.bundle.json.crc")
    with pytest.raises(ValueError, match="checksum"):
        p.read_document(spark, root, "bundle")
