"""Artifact files at their keys, and runs read back from their files."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import artifacts
from corpusloom.sources.records import expected_files, read_run_lines


def files_below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_each_artifact_is_a_file_at_its_key(spark, tmp_path):
    rows = [("runs/2026/05/04/p/1/output.md", "one\ntwo é"), ("runs/2026/05/04/p 2/2/output.csv", "a,b"), ("runs/2026/05/04/p+%/3/output.md", None)]
    path = str(tmp_path / "out")
    artifacts.write_files(spark.createDataFrame(rows, "key string, text string").repartition(3), path, "key", "text")
    assert files_below(path) == sorted(k for k, _ in rows)
    assert {r.key: r.text for r in artifacts.read_files(spark, path).collect()} == {k: t for k, t in rows if t}
    assert {(r.key, r.bytes) for r in artifacts.list_files(spark, path, "*.md").collect()} == {(rows[0][0], len(rows[0][1].encode()))}
    # written again: the same files
    artifacts.write_files(spark.createDataFrame(rows, "key string, text string"), f"file://{path}", "key", "text")
    assert files_below(path) == sorted(k for k, _ in rows)


@pytest.mark.parametrize("bad", [None, "", "../up.md", "/abs.md", "a//b", "_staging/x"])
def test_a_failed_task_leaves_none_of_its_files(spark, tmp_path, bad):
    path = str(tmp_path / "out")
    rows = spark.range(40).select(F.concat(F.lit("k/"), F.col("id").cast("string")).alias("key"), F.lit("text").alias("text")).coalesce(1)
    broken = rows.unionByName(spark.createDataFrame([(bad, "x")], "key string, text string")).coalesce(1)
    with pytest.raises(Exception, match="artifact needs a key|not a key below"):
        artifacts.write_files(broken, path, "key", "text")
    assert files_below(path) == []


def test_lines_are_numbered_in_file_order_though_files_are_split(spark, tmp_path):
    for run in ("a b", "c"):
        os.makedirs(tmp_path / f"run={run}")
        for part in range(2):
            with open(tmp_path / f"run={run}" / f"part-{part}.jsonl", "w") as out:
                out.writelines(f"{run} {part} {k} {'x' * 200}\n" for k in range(3000))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "65536")
        got = read_run_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for run in ("a b", "c"):
        lines = [r.line.rsplit(" ", 1)[0] for r in sorted((r for r in got if r.run_id == run), key=lambda r: r.line_no)]
        assert lines == [f"{run} {part} {k}" for part in range(2) for k in range(3000)]
    manifest = spark.createDataFrame([("a b", 1), ("gone", 2)], "run_id string, chunk_id int")
    found = {r.run_id: (r.status, r.files) for r in expected_files(manifest, artifacts.list_files(spark, str(tmp_path))).collect()}
    assert found == {"a b": ("ok", 2), "gone": ("MISSING", 0)}


@pytest.fixture
def jobs(spark):
    """Runs a step and says how many jobs it took, and the most tasks in one."""
    def run(step):
        sc, group = spark.sparkContext, f"files-{step}"
        sc.setLocalProperty("spark.jobGroup.id", group)
        try:
            step()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        found = sc.statusTracker().getJobIdsForGroup(group)
        stages = [sc.statusTracker().getStageInfo(s) for j in found for s in sc.statusTracker().getJobInfo(j).stageIds]
        return len(found), max(s.numTasks for s in stages if s)
    return run


def test_files_are_written_by_many_tasks_and_listed_in_few_rounds(spark, tmp_path, jobs):
    path = str(tmp_path / "out")
    keys = [f"runs/{a}/{b}/output.md" for a in range(20) for b in range(40)]
    rows = spark.createDataFrame([(k, k) for k in keys], "key string, text string").coalesce(1)
    assert jobs(lambda: artifacts.write_files(rows, path, "key", "text"))[1] > 1
    assert jobs(lambda: artifacts.list_files(spark, path))[0] < 10
    assert {(r.key, r.text) for r in artifacts.read_files(spark, path).collect()} == {(k, k) for k in keys}


def test_folders_left_by_a_task_are_dealt_out_again(spark, tmp_path):
    path = str(tmp_path / "out")
    keys = [f"a{i % 3}/b{i % 7}/c{i}/{name}" for i in range(60) for name in ("x.md", "y.txt", "_z.md", ".w.md")]
    artifacts.write_files(spark.createDataFrame([(k, k) for k in keys], "key string, text string"), path, "key", "text")
    seen = [k for k in keys if "/_" not in k and "/." not in k]
    for pattern, ends in (("*", (".md", ".txt")), ("*.md", (".md",)), ("?.{txt,csv}", (".txt",)), ("[^x]*", ("y.txt",))):
        got = sorted((r.key, r.bytes) for r in artifacts.list_files(spark, path, pattern, walk=5).collect())
        assert got == sorted((k, len(k)) for k in seen if k.endswith(ends))
        old = sorted((r.key, r.bytes, r.modified) for r in artifacts.list_data(spark, path, pattern).collect())
        assert sorted((r.key, r.bytes, r.modified) for r in artifacts.list_files(spark, path, pattern).collect()) == old
