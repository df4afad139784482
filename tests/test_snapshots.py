from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarrylens.operators import reports
from quarrylens.plans.select import select
from quarrylens.sources import inventory, snapshots
from quarrylens.streaming import changes

FILES = [("a.cpp", "C++", 2, 20, 0, "ha"), ("b.cpp", "C++", 10, 30, 0, "hb"), ("中文/O'Brien.h", "C++", 10, 40, 0, "hc")]
SYMBOLS = [("a", "alpha", "a.cpp", 1), ("b", "beta", "b.cpp", 2), ("c", "gamma", "b.cpp", 8)]
METRICS = [("a", 3, 20, 1), ("b", 12, 80, 3), ("c", -1, 100, 0)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, snapshots.VIEWS["files"])


@pytest.fixture(scope="module")
def functions(spark):
    symbols = spark.createDataFrame(SYMBOLS, "symbol_id string, name string, file string, line long")
    metrics = spark.createDataFrame(METRICS, "symbol_id string, complexity long, lines long, parameters long").withColumns({c: F.lit(-1) for c in ("max_nesting", "fan_in", "fan_out")})
    return snapshots.conform(snapshots.functions_view(metrics, symbols), "functions")


def rows(selection):
    return [tuple(r) for r in selection.frame.collect()]


def test_filter_sort_limit_project(functions):
    got = select(functions, "functions", ["name", "file", "complexity"], "complexity > 10 AND lines > 50", [("complexity", True)], 20)
    assert rows(got) == [("beta", "b.cpp", 12)]
    assert got.plan == "Scan(functions) -> Filter -> StableSort(complexity DESC) -> Limit(20) -> Project(name, file, complexity)"
    assert got.matched.count() == 1


def test_precedence(functions):
    n = lambda where: select(functions, "functions", ["name"], where).frame.count()
    assert n("name = 'alpha' OR complexity > 10 AND lines > 90") == 1
    assert n("(name = 'alpha' OR complexity > 10) AND lines > 90") == 0
    assert n("complexity != -1 AND (lines <= 20 OR parameters >= 3)") == 2


def test_order_is_total(files):
    assert rows(select(files, "files", ["file"], None, [("lines", True), ("size", False)], 2)) == [("b.cpp",), ("中文/O'Brien.h",)]
    assert rows(select(files, "files", ["file"], None, [("lines", True)], 2**63 - 1)) == [("b.cpp",), ("中文/O'Brien.h",), ("a.cpp",)]
    assert rows(select(files, "files", None, None, None, 0)) == []
    assert rows(select(files, "files", ["file"], F.col("file") == "中文/O'Brien.h")) == [("中文/O'Brien.h",)]


@pytest.mark.parametrize(("args", "message"), [(("files", ["missing"]), "unknown field"), (("secrets",), "unknown table"), (("files", None, None, [("missing", False)]), "unknown field"), (("files", None, None, None, -1), "non-negative")])
def test_rejections_before_running(files, args, message):
    with pytest.raises(ValueError, match=message):
        select(files, *args)


def test_gates(files, functions):
    assert select(files, "files", status="not_requested").frame.count() == 3
    with pytest.raises(ValueError, match="analysed"):
        select(functions, "functions", status="not_requested")
    with pytest.raises(ValueError, match="reference index"):
        select(files, "references", has_references=False)
    empty = select(files.limit(0), "files", ["file"])
    assert empty.frame.columns == ["file"] and empty.frame.count() == 0


def test_orphan_metric_is_an_error(spark):
    symbols = spark.createDataFrame(SYMBOLS[:1], "symbol_id string, name string, file string, line long")
    metrics = spark.createDataFrame(METRICS, "symbol_id string, complexity long, lines long, parameters long")
    assert {r.symbol_id for r in snapshots.orphan_metrics(metrics, symbols).collect()} == {"b", "c"}
    with pytest.raises(PySparkException, match="missing symbol"):
        snapshots.functions_view(metrics, symbols).collect()


def test_store(spark, files, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.latest("/p") is None and store.manifest().count() == 0
    store.save(1, "/p", "10", {"files": files})
    store.save(2, "/p", "20", {"files": files.limit(1)}, status="partial")
    store.save(3, "/q", "30", {"files": files.limit(2)})
    assert store.latest("/p") == 2 and store.read(1, "files").count() == 3 and store.read(2, "files").count() == 1
    assert store.read(2, "issues").count() == 0
    assert {(r.root, r.scan_id, r.scanned_at) for r in store.projects().collect()} == {("/p", 2, "20"), ("/q", 3, "30")}
    with pytest.raises(ValueError, match="already saved"):
        store.save(2, "/p", "20", {"files": files})
    with pytest.raises(ValueError, match="no saved scan"):
        store.read(9, "files")
    page = snapshots.history_page(store.manifest().select("scan_id"), {"files": spark.createDataFrame([(1,), (1,), (3,)], "scan_id long")}, 3, 1)
    assert [tuple(r) for r in page.collect()] == [(2, 0)]


def test_stream_publishes_batches_once(spark, files, tmp_path):
    source, point = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    files.coalesce(1).write.parquet(source)
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        stream = spark.readStream.schema(files.schema).parquet(source)
        changes.publish_snapshots(stream, store, "/p", point).awaitTermination(60)
    assert [r.scan_id for r in store.manifest().collect()] == [1] and store.read(1, "files").count() == 3


def test_inventory_of_a_tree(spark, tmp_path):
    root = tmp_path / "src"
    for name, data in (("a.cpp", b"x\ny"), ("sub/B.HPP", b"x\n"), ("c.C", b"q"), ("notes.txt", b"z"), (".git/d.cpp", b"z"), ("CMake-Build-x/e.c", b"z")):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    got = {r.file: (r.language, r.lines, r.size) for r in inventory.scan_files(spark, f"file:{root}").collect()}
    assert got == {"a.cpp": ("C++", 2, 3), "sub/B.HPP": ("header", 1, 2), "c.C": ("C", 1, 1)}
    hashes = {r.file: r.hash for r in inventory.scan_files(spark, f"file:{root}").collect()}
    assert spark.range(1).select(inventory.fnv1a64(F.lit("").cast("binary"))).first()[0] == "fnv1a64-v1:cbf29ce484222325"
    h = 0xCBF29CE484222325
    for b in b"x\ny":
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert hashes["a.cpp"] == f"fnv1a64-v1:{h:016x}"


def test_small_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"directory": "/p", "file": "a.cpp", "command": "cc a.cpp"}, {"directory": "/p", "file": "/q/b.cpp", "arguments": ["cc", "b.cpp"]}]')
    got = {r.file: r for r in inventory.compile_commands(spark, f"file:{tmp_path}/c.json").collect()}
    assert set(got) == {"/p/a.cpp", "/q/b.cpp"} and got["/p/a.cpp"].command_id != got["/q/b.cpp"].command_id
    (tmp_path / "r.jsonl").write_text('﻿{"a": 1}\n\n{"a": 2}\n', encoding="utf-8")
    assert sorted(r.a for r in inventory.read_jsonl(spark, f"file:{tmp_path}/r.jsonl", "a int").collect()) == [1, 2]
    text = spark.createDataFrame([("90% tests passed, 1 tests failed out of 10\n 3 ***Skipped",), ("nothing",)], "t string")
    assert [tuple(r.c) for r in text.select(inventory.test_counts(F.col("t")).alias("c")).collect()] == [(10, 1, 1), (-1, -1, -1)]


def test_reports(spark, functions, tmp_path):
    html = [r.html for r in reports.metric_rows_html(functions).orderBy(F.desc("complexity"), "symbol_id").collect()]
    assert html[0].startswith("<tr><td>beta</td>") and "<td>unknown</td>" in html[-1]
    nested = reports.nested_report(spark.createDataFrame([(1,)], "scan_id long"), {"rows": (spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "scan_id long, k string, v int"), ["k"])})
    assert [tuple(x) for x in nested.first().rows] == [("a", 1), ("b", 2)]
    reports.export(functions, f"file:{tmp_path}/report", ["symbol_id"])
    with pytest.raises(PySparkException):
        reports.export(functions, f"file:{tmp_path}/report", ["symbol_id"])


def test_inventory_holds_empty_files_and_ignores_folders_in_any_case(spark, tmp_path):
    for name, data in (("a.cpp", b""), ("Build/b.cpp", b"x"), ("sub/c.h", b"x")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    got = {r.file: (r.lines, r.size, r.hash) for r in inventory.scan_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.cpp", "sub/c.h"} and got["a.cpp"] == (0, 0, "fnv1a64-v1:cbf29ce484222325")


def test_conditions_compare_like_with_like(spark):
    source = spark.createDataFrame([], snapshots.VIEWS["files"])
    for bad in ("lines = '2'", "'2' = lines", "lines IN ('2')", "lines LIKE '2'", F.col("lines") == "2", "file < 3", "lines > 1.5", F.col("lines") + F.lit(0.5) > 2, "lines = NULL", "lines > (SELECT 1)", "missing = 1", "lines"):
        with pytest.raises(ValueError):
            select(source, "files", None, bad)
    assert select(source, "files", None, "file = 'lines = 2' AND lines = 2").frame.count() == 0


def test_build_needs_its_scan(spark, tmp_path):
    from quarrylens.sources.snapshots import save_build

    manifest = spark.createDataFrame([(1, "/p")], "scan_id long, root string")
    run = lambda root: spark.createDataFrame([(5, 1, root)], "run_id long, scan_id long, root string")
    steps = spark.createDataFrame([(5, 0, "build")], "run_id long, ordinal long, stage string")
    with pytest.raises(ValueError):
        save_build(manifest, run("/other"), steps, str(tmp_path / "b"))
    save_build(manifest, run("/p"), steps, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b/build_step")).count() == 1
    with pytest.raises(ValueError, match="already saved"):
        save_build(manifest, run("/p"), steps, str(tmp_path / "b"))


def test_a_build_whose_run_was_not_written_can_be_saved_again(spark, tmp_path):
    from quarrylens.sources.snapshots import builds_view, save_build

    folder = str(tmp_path / "b")
    manifest = spark.createDataFrame([(1, "/p")], "scan_id long, root string")
    run = lambda i: spark.createDataFrame([(i, 1, "/p")], "run_id long, scan_id long, root string")
    steps = lambda i, *names: spark.createDataFrame([(i, k, n) for k, n in enumerate(names)], "run_id long, ordinal long, stage string")
    save_build(manifest, run(4), steps(4, "configure"), folder)
    with pytest.raises(Exception):  # noqa: B017 (the run's write fails, its steps are there)
        save_build(manifest, run(5).withColumn("run_id", F.when(F.rand() < 2, F.raise_error(F.lit("lost")).cast("long"))), steps(5, "configure", "build", "test"), folder)
    spark.createDataFrame([(5, 9, "left over")], "run_id long, ordinal long, stage string").write.mode("append").partitionBy("run_id").parquet(f"{folder}/build_step")
    save_build(manifest, run(5), steps(5, "configure", "build"), folder)
    got = builds_view(spark.read.parquet(f"{folder}/build_run"), spark.read.parquet(f"{folder}/build_step"))
    assert sorted((r.run_id, r.ordinal, r.stage) for r in got.collect()) == [(4, 0, "configure"), (5, 0, "configure"), (5, 1, "build")]


def _tables(spark, files):
    symbols = spark.createDataFrame([("s1", "f", "a.cpp", 1, 1, "function", 1, 0)], "symbol_id string, name string, file string, line long, column long, kind string, definition long, external long")
    functions = spark.createDataFrame([("f", "a.cpp", 1, 2, 3, 0, "s1", -1, -1, -1)], snapshots.VIEWS["functions"])
    references = spark.createDataFrame([("s1", "", "call", "a.cpp", 1, 2, "a.cpp")], snapshots.VIEWS["references"])
    return {"files": files, "symbols": symbols, "functions": functions, "references": references}


def test_a_sound_snapshot_with_all_tables(spark, files, tmp_path):
    store, tables = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s p"), _tables(spark, files)
    store.save(7, "/p", "10", tables, scope="x")
    assert store.read(7, "references", "/p").count() == 1 and store.manifest().first().scope == "x"
    with pytest.raises(ValueError, match="no saved scan 7 of /q"):
        store.read(7, "files", "/q")


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda t: {**t, "files": t["files"].unionByName(t["files"].limit(1))}, "files: key twice"),
        (lambda t: {**t, "symbols": t["symbols"].withColumn("symbol_id", F.lit("other"))}, "dangling"),
        (lambda t: {k: v for k, v in t.items() if k != "symbols"}, "dangling"),
        (lambda t: {**t, "references": t["references"].unionByName(t["references"])}, "references: key twice"),
    ],
)
def test_a_snapshot_that_does_not_hold_together_publishes_nothing(spark, files, tmp_path, change, message):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError, match=message):
        store.save(1, "/p", "10", change(_tables(spark, files)))
    assert store.manifest().count() == 0 and store.latest("/p") is None
    store.save(1, "/p", "10", _tables(spark, files))  # the id is still free
    assert store.latest("/p") == 1


def test_incomplete_inventories_and_empty_roots_are_not_saved(spark, files, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/store")
    for args, more in (((1, "", "10"), {}), ((1, "/p", "10"), {"diagnostics": ["unreadable: x"]}), ((0, "/p", "10"), {})):
        with pytest.raises(ValueError):
            store.save(*args, {"files": files}, **more)
    assert store.manifest().count() == 0


def test_of_concurrent_writers_of_one_id_one_publishes(spark, files, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/store")

    def save(k):
        try:
            store.save(5, f"/p{k}", "10", {"files": files.limit(k)})
            return k
        except ValueError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [k for k in pool.map(save, (1, 2, 3, 3)) if k]
    assert len(won) == 1 and store.manifest().count() == 1
    assert store.read(5, "files").count() == won[0]
    assert [snapshots.create_once(spark, f"file://{tmp_path}/once", x) for x in "ab"] == [True, False]


def test_every_view_from_its_relations(spark):
    from quarrylens.sources import views

    rel = {
        "file": spark.createDataFrame([(1, "a.c", "C", "h", Decimal(5), None, 2), (2, "b.c", "C", "h", Decimal(5), 0, 2)], "scan_id long, path string, language string, hash string, size decimal(20,0), mtime long, lines int"),
        "symbol": spark.createDataFrame([(1, "u", "function", "f", "a.c", 1, 2, True, False)], "scan_id long, usr string, kind string, name string, file string, line int, col int, definition boolean, external boolean"),
        "function_metric": spark.createDataFrame([(1, "u", 3, 1, 2, None, 0, 0)], "scan_id long, usr string, lines int, parameters int, complexity int, max_nesting int, fan_in int, fan_out int"),
        "build_run": spark.createDataFrame([(9, 1, "r")], "id long, scan_id long, root string"),
        "build_step": spark.createDataFrame([(9, 0, "configure", "passed", 0, 12, -1, -1, -1, "all")], "run_id long, ordinal int, name string, status string, exit_code int, duration_ms long, tests_total int, tests_failed int, tests_skipped int, target string"),
    }
    of = lambda v: [tuple(r) for r in views.logical_view(v, rel, 1).select(*snapshots.VIEWS[v].names).collect()]
    assert of("files") == [("a.c", "C", 2, 5, -1, "h")]
    assert of("symbols") == [("f", "a.c", 1, 2, "function", 1, 0, "u")]
    assert of("functions") == [("f", "a.c", 1, 2, 3, 1, "u", -1, 0, 0)]
    assert of("builds") == [(9, 1, "configure", "passed", 0, 12, -1, -1, -1, "all")]
    with pytest.raises(ValueError, match="no relation symbol_reference"):
        of("references")
    with pytest.raises(ValueError, match="unknown table"):
        views.logical_view("secrets", rel)
    rel["file"] = rel["file"].withColumn("size", F.lit("18446744073709551615").cast("decimal(20,0)"))
    with pytest.raises(PySparkException):
        of("files")
    rel["symbol"] = rel["symbol"].limit(0)
    with pytest.raises(PySparkException, match="missing symbol"):
        of("functions")
    orphan = views.metrics_with_symbols(rel["function_metric"].withColumnRenamed("usr", "symbol_id"), rel["symbol"].withColumnRenamed("usr", "symbol_id"))
    assert [(r.name, r.place) for r in orphan.collect()] == [("u", "")]
