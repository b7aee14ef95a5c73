"""Batch objects: many small files, written and listed by tasks."""

import os

from tidewater.sinks import objects
from tidewater.sinks import spool as S

LINES = "tenant_id string, dataset_id string, data_hint string, batch_no long, seq long, line_no long, line string"


def _lines(spark):
    keys = [("01", "a/b=c%", "csv"), ("t", None, "x y"), ("t", "d", "")]
    rows = [(*k, b, i, n, f"{b}-{i}-{n}" if n else None) for k in keys for b in range(3) for i in range(20) for n in range(2)]
    return spark.createDataFrame(rows[::-1], LINES)


def test_objects_come_back_whole_with_the_keys_as_written(spark, tmpdir_path):
    S.write_batches(_lines(spark), tmpdir_path)
    got = S.read_batches(spark, tmpdir_path).collect()
    want = "".join(f"{{0}}-{i}-1\n" if n else "\n" for i in range(20) for n in range(2))
    keys = {("01", "a/b=c%", "csv"), ("t", None, "x y"), ("t", "d", None)}
    assert {(r.tenant_id, r.dataset_id, r.data_hint, r.batch_no) for r in got} == {(*k, b) for k in keys for b in range(3)}
    assert len(got) == 9 and all(r.value == want.format(r.batch_no) for r in got)


def test_layout_is_that_of_the_partitioned_writer(spark, tmpdir_path):
    ours, theirs = os.path.join(tmpdir_path, "a"), os.path.join(tmpdir_path, "b")
    S.write_batches(_lines(spark), ours)
    S.write_batches(_lines(spark), theirs, mode="overwrite")  # Spark's writer
    folders = lambda p: {os.path.relpath(d, p) for d, _, names in os.walk(p) if any(n.endswith(".gz") for n in names)}
    assert folders(ours) == folders(theirs)
    both = [sorted(map(str, S.read_batches(spark, p).collect())) for p in (ours, theirs)]
    assert both[0] == both[1]


def test_append_adds_objects_and_nothing_half_written_is_left(spark, tmpdir_path):
    for _ in range(2):
        S.write_batches(_lines(spark), tmpdir_path)
    assert S.read_batches(spark, tmpdir_path).count() == 18
    assert not [n for _, _, names in os.walk(tmpdir_path) for n in names if not n.endswith(".txt.gz") or n.startswith("_")]


def test_folders_of_other_schemes_are_left_to_spark(spark):
    assert objects.shared_folder(spark, "file:///a/b#c") == "/a/b#c"
    assert objects.shared_folder(spark, "/a/b") == "/a/b"
    assert objects.shared_folder(spark, "hdfs://host:1/a") is None
