"""Sinks with manifests: what was written verifies, what was changed does not, nothing is written over."""

import glob
import json
import os

import pytest

from quarrylens.sources import sinks


@pytest.fixture
def frames(spark):
    graphs = spark.createDataFrame([(f"f{i % 7}.c", f"fn{i}", [1, 2], None) for i in range(25)], "file string, function string, edges array<int>, label int")
    files = spark.createDataFrame([(f"f{i}.c",) for i in range(10)] + [("f9.c",), (None,)], "file string")
    return graphs, files


def test_graphs_are_written_verified_and_listed(spark, frames, tmp_path):
    graphs, files = frames
    folder = f"file://{tmp_path}/out"
    summary = sinks.write_graphs(graphs.repartition(3), files, folder, {"parser": "text"})
    assert summary["tables"]["graphs"]["rows"] == 25 and summary["label_status"] == "unlabeled" and summary["parser"] == "text"
    assert json.load(open(f"{tmp_path}/out/manifest/summary.json")) == summary
    got = sinks.read_verified(spark, folder, "graphs", graphs.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, graphs.collect()))
    without = sinks.read_verified(spark, folder, "files_without_graphs", "file string")
    assert {r.file for r in without.collect()} == {"f7.c", "f8.c", "f9.c", None}
    with pytest.raises(Exception, match="exists"):
        sinks.write_graphs(graphs, files, folder)
    assert sinks.manifest_problems(spark, folder, ["graphs", "files_without_graphs"]).count() == 0


def test_changes_are_found(spark, frames, tmp_path):
    folder = f"file://{tmp_path}/out"
    sinks.write_with_manifest({"graphs": frames[0].repartition(3)}, folder, rows_per_file=5)
    parts = sorted(glob.glob(f"{tmp_path}/out/graphs/*.json"))
    assert len(parts) >= 5
    with open(parts[0], "a") as f:
        f.write("{}\n")
    for crc in glob.glob(f"{tmp_path}/out/graphs/.*.crc"):  # the local file system's own check
        os.unlink(crc)
    open(f"{tmp_path}/out/graphs/more.json", "w").write("{}\n")
    os.unlink(parts[1])
    got = {(r.file, r.problem) for r in sinks.manifest_problems(spark, folder, ["graphs"]).collect()}
    assert got == {(os.path.basename(parts[0]), "changed"), (os.path.basename(parts[1]), "missing"), ("more.json", "unlisted")}
    with pytest.raises(ValueError):
        sinks.read_verified(spark, folder, "graphs", frames[0].schema)


def test_a_dataset_and_its_splits(spark, tmp_path):
    records = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "sample_id string, label int")
    splits = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "sample_id string, split string")
    summary = sinks.write_dataset(records, splits, f"file://{tmp_path}/d", {"seed": 42})
    assert summary["class_counts"] == {"train": {"0": 1, "1": 1}, "test": {"1": 1}} and summary["seed"] == 42
    for wrong in (splits.limit(2), splits.unionByName(splits.limit(1)), splits.unionByName(spark.createDataFrame([("d", "test")], splits.schema))):
        with pytest.raises(ValueError, match="sample"):
            sinks.write_dataset(records, wrong, f"file://{tmp_path}/e")
    assert not glob.glob(f"{tmp_path}/e/*")


def test_an_empty_table(spark, frames, tmp_path):
    summary = sinks.write_with_manifest({"graphs": frames[0].limit(0)}, f"file://{tmp_path}/none")
    assert summary["tables"]["graphs"]["rows"] == 0 and summary["tables"]["graphs"]["sha256"] is None
    assert sinks.read_verified(spark, f"file://{tmp_path}/none", "graphs", frames[0].schema).count() == 0


def test_a_pair_corpus_and_its_manifest(spark, tmp_path):
    from test_programs import CASE

    from quarrylens.operators import pairs

    rows = [(f"t/CWE121_Stack__x_01.c", 121, CASE), ("t/CWE121_Other__y_01.c", 121, "")]
    extracted = pairs.extract_pairs(spark.createDataFrame(rows, "source_file string, cwe int, text string"))
    selection = pairs.select_cases(extracted, 5)
    summary = pairs.write_pairs(extracted, selection, f"file://{tmp_path}/c", {"seed": 42})
    assert summary["cases"] == {"selected": 1, "rejected": 1} and {k: v["rows"] for k, v in summary["tables"].items()} == {"functions": 2, "labels": 2, "provenance": 2, "rejected": 1}
    labels = sinks.read_verified(spark, f"file://{tmp_path}/c", "labels", "sample_id string, file string, label int, group_id string").collect()
    code = {r.file: r.code for r in sinks.read_verified(spark, f"file://{tmp_path}/c", "functions", "file string, code string").collect()}
    assert {r.label for r in labels} == {0, 1} and len({r.group_id for r in labels}) == 1 and all("void process(void)" in code[r.file] for r in labels)


def test_command_files_near_the_root(spark, tmp_path):
    from quarrylens.sources import inventory

    for place in ("", "a/b/c", "a/b/c/d", ".git", "x/node_modules/y", "build"):
        os.makedirs(tmp_path / place, exist_ok=True)
        (tmp_path / place / "compile_commands.json").write_text("[]" if place else "")
    got = [r.path.split(tmp_path.name, 1)[1] for r in inventory.command_files(spark, f"file://{tmp_path}").collect()]
    assert got == ["/a/b/c/compile_commands.json", "/build/compile_commands.json"]
