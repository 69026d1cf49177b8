import os

import pytest
from pyspark.sql import functions as F

from typeaudit.functions import text as tx
from typeaudit.plans import analysis
from typeaudit.sources import config as cfg
from typeaudit.sources import files, listing


def write(root, name, content):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "Build" / "app")
    write(root, "Sources/A.swift", "class A {}")
    write(root, "Sources/Deep/er/B.swift", "struct B {}")
    write(root, "Other/B.swift", "class OtherB {}")
    write(root, "Carthage/Build/Lib.swift", "class Lib {}")
    write(root, "Generated/G.swift", "class G {}")
    write(root, ".hidden/H.swift", "class H {}")
    write(root, "Sources/Notes.txt", "class N {}")
    write(root, "Sources/Upper.SWIFT", "class U {}")
    write(root, "Sources/Broken.swift", b"class X {\xff}")
    return root


def names(df):
    return sorted(r.file_name for r in df.select("file_name").collect())


def test_scan_prunes_ignored_folders_and_suffixes(spark, tree):
    sources = files.scan_sources(spark, tree)
    assert names(sources) == ["A.swift", "B.swift", "B.swift", "Broken.swift", "G.swift"]
    assert {r.project for r in sources.select("project").collect()} == {"app"}
    more = files.scan_sources(spark, tree, ignored=files.default_ignored(["Generated"]))
    assert "G.swift" not in names(more)
    # The scan root lies below a folder named Build: absolute mode then drops everything.
    assert files.scan_sources(spark, tree, absolute=True).count() == 0


def test_single_file_bypasses_the_ignore_list(spark, tree):
    path = f"{tree}/Carthage/Build/Lib.swift"
    rows = files.single_source(spark, path).collect()
    assert [(r.file_name, r.text) for r in rows] == [("Lib.swift", "class Lib {}")]
    assert files.single_source(spark, f"{tree}/Sources/Upper.SWIFT").count() == 1
    with pytest.raises(ValueError, match="must be a .swift file"):
        files.single_source(spark, f"{tree}/Sources/Notes.txt")


def test_unreadable_files_are_kept_with_their_error(spark, tree):
    sources = files.scan_sources(spark, tree)
    assert [r.path.split("/")[-1] for r in files.read_errors(sources).collect()] == ["Broken.swift"]
    assert files.any_error(sources).first().has_errors
    run = analysis.analyze(sources, keep_types=False)
    totals = run.summary().first()
    assert (totals.total_files, totals.total_types, totals.total_issues) == (5, 4, 0)


def test_same_base_name_in_two_folders_stays_apart(spark, tree):
    run = analysis.analyze(files.scan_sources(spark, tree), keep_types=False)
    assert sorted(r.name for r in run.types.where("file_name = 'B.swift'").collect()) == ["B", "OtherB"]


def test_prune_by_table_is_per_project(spark):
    paths = spark.createDataFrame(
        [("p", "a/Gen/x.swift"), ("q", "a/Gen/x.swift"), ("p", "a/b.swift"), ("p", "Gen/Gen/y.swift")],
        "project string, path string",
    )
    ignored = spark.createDataFrame([("p", "Gen")], "project string, component string")
    kept = {tuple(r) for r in files.prune_by_table(paths, ignored).select("project", "path").collect()}
    assert kept == {("q", "a/Gen/x.swift"), ("p", "a/b.swift")}


@pytest.mark.parametrize(
    "path, is_directory, expected",
    [
        ("/tmp/MyFile.swift", False, None),
        ("/tmp/MyFile.SWIFT", False, None),
        ("/tmp/Notes.txt", False, files.NOT_A_SOURCE_FILE),
        ("/tmp/swift", False, files.NOT_A_SOURCE_FILE),
        ("/tmp/.swift", False, files.NOT_A_SOURCE_FILE),
        ("/tmp/some-folder", True, None),
    ],
)
def test_input_check(spark, path, is_directory, expected):
    inputs = spark.createDataFrame([(path, is_directory)], "path string, is_directory boolean")
    assert files.check_inputs(inputs).first().input_error == expected


def merged(spark, text):
    row = cfg.merge(spark.createDataFrame([("p", text)], "project string, config_text string")).first()
    rules = {key: (row.rules[key].enabled, row.rules[key].threshold) for key in row.rules.asDict()}
    return set(row.ignore_directories), rules


DEFAULTS = {
    "largeClass": (True, 10), "highMethodDensity": (True, 10), "godObject": (True, None), "dataHeavyClass": (True, 5),
}


@pytest.mark.parametrize(
    "text, extra, changed",
    [
        (None, set(), {}),
        ("{}", set(), {}),
        ("not json", set(), {}),
        ("[1]", set(), {}),
        ('{"ignoreDirectories":["Gen","Pods"]}', {"Gen"}, {}),
        ('{"ignoreDirectories":[1,2]}', set(), {}),
        ('{"ignoreDirectories":["Gen"],"rules":{"largeClass":{"threshold":"x"}}}', set(), {}),
        ('{"rules":{"largeClass":{"enabled":null,"threshold":15}},"more":{"a":1}}', set(), {"largeClass": (True, 15)}),
        ('{"rules":{"godObject":{"enabled":false,"threshold":1}}}', set(), {"godObject": (False, None)}),
        ('{"rules":{"highMethodDensity":{"threshold":8},"dataHeavyClass":{"enabled":false}}}', set(),
         {"highMethodDensity": (True, 8), "dataHeavyClass": (False, 5)}),
    ],
)
def test_config_merge(spark, text, extra, changed):
    folders, rules = merged(spark, text)
    assert folders == set(cfg.DEFAULT_IGNORED) | extra
    assert rules == {**DEFAULTS, **changed}


def test_config_files_and_projects(spark, tmp_path):
    roots = {"one": str(tmp_path / "one"), "two": str(tmp_path / "two")}
    body = "\n".join(f"    func m{i}() {{ }}" for i in range(12))
    for root in roots.values():
        write(root, "Src/Big.swift", f"class Big {{\n{body}\n}}")
        write(root, "Gen/Big.swift", f"class Big {{\n{body}\n}}")
    write(roots["one"], ".audit.json", '{"ignoreDirectories":["Gen"],"rules":{"largeClass":{"threshold":20}}}')
    projects = spark.createDataFrame(list(roots.items()), "project string, folder string")
    configs = cfg.read_configs(projects, ".audit.json")
    assert configs.count() == 2
    sources = files.scan_sources(spark, roots)
    run = analysis.analyze(sources, configs, keep_types=True)
    assert [(r.project, r.rule) for r in run.issues.orderBy("project", "path").collect()] == [
        ("two", "LargeClass"), ("two", "LargeClass"),
    ]
    assert run.sources.count() == 3


def test_json_records_by_project(spark, tmp_path):
    body = "\n".join(f"  func m{i}() {{ }}" for i in range(12))
    for name in ("one", "two"):
        write(str(tmp_path), f"{name}/A.swift", f"class Big {{\n{body}\n}}\nclass Large {{\n{body}\n}}")
    sources = files.scan_sources(spark, {name: str(tmp_path / name) for name in ("one", "two")})
    out = str(tmp_path / "out")
    analysis.write_json_report(analysis.analyze(sources), out, by_project=True)
    assert sorted(n for n in os.listdir(out) if n.startswith("project=")) == ["project=one", "project=two"]
    rows = spark.read.json(out).where("project = 'two'").collect()
    assert [(r.file, r.typeName) for r in rows] == [("A.swift", "Big"), ("A.swift", "Large")]
    assert rows[0].path.endswith("/two/A.swift")


def test_ignored_folders_above_the_root_do_not_count_with_configs(spark, tree):
    sources = files.scan_sources(spark, tree)
    configs = cfg.merge(spark.createDataFrame([("app", '{"ignoreDirectories":["Generated"]}')], "project string, config_text string"))
    run = analysis.analyze(sources, configs, keep_types=False)
    assert names(run.sources) == ["A.swift", "B.swift", "B.swift", "Broken.swift"]
    assert {r.relative_path for r in run.sources.collect()} >= {"Sources/A.swift", "Other/B.swift"}


def test_no_text_meets_the_configs(spark):
    sources = spark.createDataFrame([("p", "a/A.swift", "A.swift", "class A {}", None)], "project string, path string, file_name string, text string, read_error string")
    configs = cfg.merge(spark.createDataFrame([("p", None)], "project string, config_text string"))
    met = cfg.with_config(sources.select("project", "path"), configs)
    assert "text" not in met.columns
    plan = files.prune_by_config(sources, configs)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert ["LeftAnti" in line for line in joins] == [True, False]


def test_nested_roots_go_to_the_longest(spark, tree):
    found = files.scan_sources(spark, {"outer": tree, "inner": f"{tree}/Sources"})
    rows = {(r.project, r.relative_path) for r in found.where("text is not null").collect()}
    assert ("inner", "Deep/er/B.swift") in rows and ("outer", "Other/B.swift") in rows and ("outer", "Sources/A.swift") not in rows


def test_configs_through_a_file_system_of_the_caller(spark, tmp_path):
    write(str(tmp_path), "one/.audit.json", '{"rules":{"largeClass":{"threshold":7}}}')

    def opened(folder):
        from pyarrow import fs

        return fs.LocalFileSystem(), str(tmp_path / folder.removeprefix("store:"))

    projects = spark.createDataFrame([("p", "store:one")], "project string, folder string")
    assert cfg.read_configs(projects, ".audit.json", opened).first().rules.largeClass.threshold == 7


def test_text_helpers(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    assert value(tx.line_count(F.lit("a\r\nb"))) == 3
    assert value(tx.line_count(F.lit("a b\u0085c\x0bd"))) == 4
    assert value(tx.line_count(F.lit(""))) == 1
    assert value(tx.head_lines(F.lit("a\nb\nc"), 2)) == "a\nb"
    assert value(tx.head_lines(F.lit("a\r\nb\nc"), 1)) == "a\r\nb"
    assert value(tx.head_lines(F.lit("a\n\nc\n"), 9)) == "a\n\nc\n"
    assert value(tx.clean_markdown(F.lit("  **`x` y**\t\n"))) == "x y"
    assert value(tx.strip_bullets(F.lit("- a - b"))) == "a b"
    with pytest.raises(ValueError):
        tx.head_lines(F.lit("a"), -1)


def entered(monkeypatch):
    """Folders that are listed from now on, in this process."""
    seen, entries = [], listing.ListingReader._entries

    def noted(self, system, folder, base, others):
        seen.append(folder)
        return entries(self, system, folder, base, others)

    monkeypatch.setattr(listing.ListingReader, "_entries", noted)
    return seen


def walk(monkeypatch, filters=(), **options):
    """All rows of a listing, and the folders that were entered for them."""
    seen = entered(monkeypatch)
    reader = listing.ListingReader(options)
    list(reader.pushFilters(list(filters)))
    return [row for part in reader.partitions() for row in reader.read(part)], set(seen)


def test_nothing_below_ignored_folders_is_opened(spark, tmp_path, monkeypatch):
    """An oversized file below Pods, one beside good files, a link to nothing, a pipe, and a link to a folder."""
    root = str(tmp_path / "app")
    write(root, "Good.swift", "class Good {}")
    write(root, "_Under/_Score.swift", "class Under {}")
    write(root, "Empty.swift", "")
    for name in ("Pods/Huge.swift", "Sources/Huge.swift"):
        write(root, name, "")
        os.truncate(f"{root}/{name}", 3 << 30)
    os.symlink(f"{root}/nowhere", f"{root}/Gone.swift")
    os.mkfifo(f"{root}/Pipe.swift")
    os.symlink(root, f"{root}/Loop")
    sources = files.scan_sources(spark, root)
    found = {r.relative_path: (r.text, r.read_error) for r in sources.collect()}
    assert found == {
        "Good.swift": ("class Good {}", None), "_Under/_Score.swift": ("class Under {}", None), "Empty.swift": ("", None),
        "Sources/Huge.swift": (None, listing.TOO_LARGE.format(listing.MAX_BYTES)), "Gone.swift": (None, listing.NOT_READ),
        "Pipe.swift": (None, listing.NOT_READ),
    }
    run = analysis.analyze(sources, keep_types=False)
    assert sorted(r.name for r in run.types.collect()) == ["Good", "Under"] and run.file_counts() == (6, 3)
    _, folders = walk(monkeypatch, roots='{"app": "%s"}' % root, ignored='["Pods"]', suffix=".swift")
    assert folders == {root, f"{root}/_Under", f"{root}/Sources"}


@pytest.mark.parametrize("tasks", [1, 2, 3, 50])
def test_listing_is_whole_for_any_number_of_tasks(tmp_path, monkeypatch, tasks):
    want = set()
    for i in range(40):
        name = "/".join([*(f"d{(i * 7 + k) % 3}" for k in range(i % 5)), f"F{i}.swift"])
        write(str(tmp_path), name, "")
        want.add(name)
    rows, _ = walk(monkeypatch, roots='{"p": "%s"}' % tmp_path, suffix=".swift", tasks=str(tasks))
    assert sorted(r[2] for r in rows) == sorted(want)


def test_filters_reach_the_listing(spark, tree, monkeypatch):
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    roots = '{"app": "%s", "other": "%s/Other"}' % (tree, tree)
    asked = [StringStartsWith(("relative_path",), "Sources/De"), EqualTo(("project",), "app")]
    rows, folders = walk(monkeypatch, asked, roots=roots, suffix=".swift")
    assert "Sources/Deep/er/B.swift" in {r[2] for r in rows} and {r[0] for r in rows} == {"app"}
    assert folders == {tree, f"{tree}/Sources", f"{tree}/Sources/Deep", f"{tree}/Sources/Deep/er"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    where = F.col("relative_path").startswith("Sources/De") & (F.col("project") == "app")
    found = files.scan_sources(spark, {"app": tree, "other": f"{tree}/Other"}, where=where)
    assert names(found) == ["B.swift"]


def test_a_folder_that_cannot_be_listed_is_a_row(tmp_path, monkeypatch):
    write(str(tmp_path), "a/A.swift", "")
    write(str(tmp_path), "b/B.swift", "")
    entries = listing.ListingReader._entries

    def failing(self, system, folder, base, others):
        if folder.endswith("/a"):
            raise PermissionError(folder)
        return entries(self, system, folder, base, others)

    monkeypatch.setattr(listing.ListingReader, "_entries", failing)
    for tasks in ("1", "9"):
        reader = listing.ListingReader({"roots": '{"p": "%s"}' % tmp_path, "tasks": tasks})
        rows = [row for part in reader.partitions() for row in reader.read(part)]
        assert sorted((r[2], r[5]) for r in rows) == [("a", listing.NOT_LISTED), ("b/B.swift", None)]


def test_files_that_go_away_or_fill_the_limit(spark, tmp_path):
    write(str(tmp_path), "A.swift", "class A {}")
    rows = [("p", f"{tmp_path}/{name}", name, size, str(tmp_path), None) for name, size in (("A.swift", 10), ("Lost.swift", 5), ("A.swift", None))]
    listed = spark.createDataFrame(rows, listing.COLUMNS)
    found = sorted(tuple(r) for r in listing.read_listed(listed, 10, 1).select("relative_path", "content", "read_error").collect())
    assert [(n, e) for n, _, e in found] == [("A.swift", None), ("A.swift", None), ("Lost.swift", listing.NOT_READ)]
    assert {r.read_error for r in listing.read_listed(listed, 9, 1).collect()} == {listing.NOT_READ, listing.TOO_LARGE.format(9)}


def test_missing_roots_are_named(spark, tmp_path):
    with pytest.raises(Exception, match="is no folder"):
        files.scan_sources(spark, str(tmp_path / "none")).count()
