"""Structure, hotspots, co-change, authorship, risk, entry points and conventions on small literals."""

import pytest
from pyspark.sql import functions as F

from stratum.functions import paths
from stratum.functions import lexing
from stratum.operators import gold, imports, serving


def log(spark, commits):
    rows = [(sha, author, date, k, files) for k, (sha, author, date, files) in enumerate(commits)]
    return gold.touches_of(spark.createDataFrame(rows, "sha string, author string, date string, ord int, files array<string>"))


def files(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "ord int, path string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_last_touched_is_first_in_the_log(spark):
    t = log(spark, [("a", "x", "2026-01-01", ["a.py", "b.py"]), ("b", "x", "2026-01-02", ["a.py"]), ("c", "x", "2026-01-03", ["a.py"])])
    assert rows(gold.hotspots(t)) == [("a.py", 3, "2026-01-01"), ("b.py", 1, "2026-01-01")]


def test_large_commits_and_rare_pairs_are_noise(spark):
    many = ("z", "x", "d", [f"f{k}" for k in range(51)])
    t = log(spark, [many, *((s, "x", "d", ["b.py", "a.py", "a.py"]) for s in "abc"), ("d", "x", "d", ["a.py", "c.py"])])
    assert rows(gold.co_changes(t)) == [("a.py", "b.py", 3)]


def test_one_hotspot_is_medium(spark):
    spots = spark.createDataFrame([("a.py", 5, None)], "path string, touch_count long, last_touched string")
    none = spark.createDataFrame([], "file_a string, file_b string, co_change_count long")
    owners = spark.createDataFrame([("a.py", 2)], "path string, distinct_authors long")
    assert rows(gold.risk_levels(spots, none, owners).select("risk_level", "risk_score")) == [("medium", 0.5)]
    assert rows(gold.risk_levels(spots.limit(0), none, owners)) == []


def test_risk_orders_hot_warm_cold(spark):
    spots = spark.createDataFrame([("hot", 100, None), ("warm", 50, None), ("cold", 1, None)], "path string, touch_count long, last_touched string")
    pairs = spark.createDataFrame([("hot", "warm", 3)], "file_a string, file_b string, co_change_count long")
    owners = spark.createDataFrame([("hot", 10), ("warm", 5), ("cold", 1)], "path string, distinct_authors long")
    got = {r["path"]: (r["risk_level"], r["risk_score"]) for r in gold.risk_levels(spots, pairs, owners).collect()}
    assert got == {"hot": ("high", 1.0), "warm": ("medium", 0.5808), "cold": ("low", 0.0)}


def test_whole_small_repository(spark):
    app, util = "src/app.py", "src/utils.py"
    t = log(spark, [("c5", "T", "5", [app, util]), ("c4", "T", "4", [app, util]), ("c3", "T", "3", ["pytest.ini", app]), ("c2", "T", "2", [app, util]), ("c1", "T", "1", ["README.md", app])])
    spots, pairs = gold.hotspots(t), gold.co_changes(t)
    assert [r[:2] for r in rows(spots)] == [(app, 5), (util, 3), ("README.md", 1), ("pytest.ini", 1)]
    assert rows(pairs) == [(app, util, 3)]
    risk = {r["path"]: (r["risk_score"], r["risk_level"]) for r in gold.risk_levels(spots, pairs, gold.authorship(t)).collect()}
    assert risk == {app: (0.85, "high"), util: (0.6, "medium"), "README.md": (0.15, "low"), "pytest.ini": (0.15, "low")}
    f = files(spark, "README.md", "pytest.ini", app, util)
    assert rows(gold.directory_counts(f)) == [(".", 2), ("src", 2)]
    assert rows(gold.suffix_counts(f)) == [(".py", 2), (".ini", 1), (".md", 1)]
    assert rows(gold.start_here(f).select("path", "score")) == [("README.md", 100), (app, 70)]


def test_authors_tie_by_first_seen_and_deleted_files_are_left_out(spark):
    t = log(spark, [("1", "zoe", "d", ["a"]), ("2", "amy", "d", ["a", "gone"]), ("3", "bob", "d", ["a"]), ("4", "bob", "d", ["a"]), ("5", "eve", "d", ["a"])])
    got = gold.authorship(t, files(spark, "a")).collect()
    assert [(r["path"], r["total_commits"], r["distinct_authors"], [tuple(p) for p in r["primary_contributors"]]) for r in got] == [("a", 5, 4, [("bob", 2), ("zoe", 1), ("amy", 1)])]


def test_start_here_leaves_binaries_out_and_joins_reasons(spark):
    got = gold.start_here(files(spark, "README.md", "logo.png", "docs/pic.png", "docs/guide.md", "Makefile", "src/x.py")).collect()
    assert [(r["path"], r["score"], r["reasons"]) for r in got] == [("README.md", 100, ["project_overview"]), ("docs/guide.md", 90, ["documentation"]), ("Makefile", 80, ["build_entrypoint"])]


@pytest.mark.parametrize(("name", "want"), [("a.tar.gz", ".gz"), (".gitignore", ""), ("src/A.PY", ".py"), ("Makefile", ""), ("a/b.c/d", "")])
def test_suffix(spark, name, want):
    assert spark.range(1).select(paths.file_suffix(F.lit(name))).first()[0] == want


@pytest.mark.parametrize(("url", "want"), [("https://host/owner/repo.git", "owner__repo"), ("git@host:owner/repo.git", "owner__repo"), ("https://host/a b/c/", "a_b__c"), (" ", "repo"), ("host", "host")])
def test_slug(spark, url, want):
    assert spark.range(1).select(paths.slug(F.lit(url))).first()[0] == want


@pytest.mark.parametrize(("path", "name", "want"), [("src/app.py", ".utils", "src/utils"), ("src/app.py", "os.path", None), ("app.py", "....foo", None), ("a/b/c.py", "..utils", "a/utils"), ("app.py", ".utils", None)])
def test_relative_imports(spark, path, name, want):
    assert spark.range(1).select(paths.resolve_relative_import(F.lit(path), F.lit(name))).first()[0] == want


def test_import_names():
    assert imports.python_imports("import a.b, c as d\nfrom . import *\nfrom .. import *\nfrom a.b import c\nfrom a import b, c\nfrom src.utils import util as u") == ["a.b", "c", ".", "..", "a.b.c", "a.b.c", "src.utils"]
    assert lexing.javascript_imports("import x from 'a'; import 'b'\n// import 'no'\nconst y = require(\"c\"); import {p,\n q} from 'd'; const s = \"require('e')\";") == ["a", "b", "c", "d"]
    assert lexing.java_imports("package p;\nimport java.util.List;\nimport static a.B.c;\n// import x.Y;\nimport q.*;") == ["java.util.List", "a.B.c", "q"]


def test_import_graph(spark):
    rows_ = [("src/app.py", "from src.utils import util\nfrom .b import x\n"), ("src/b.py", "import os\nimport os\n"), ("a.txt", "import no")]
    edges = imports.import_edges(spark.createDataFrame(rows_, "path string, content string"))
    assert {(r["path"], r["key"]) for r in edges.collect()} == {("src/app.py", "src.utils.util"), ("src/app.py", "src/b/x"), ("src/b.py", "os")}
    assert {r["key"]: r["files"] for r in imports.imported_by(edges).collect()}["os"] == ["src/b.py", "src/b.py"]


def test_conventions(spark):
    f = files(spark, "pkg/setup.cfg", "PyProject.toml", "web/jest.config.ts", "tests/a.py", "test", ".github/workflows/ci.yml", "web/yarn.lock", "poetry.lock", "deep/.flake8", "CONTRIBUTING.md")
    contents = spark.createDataFrame([("PyProject.toml", "[tool.pytest.ini_options]\n[tool.ruff]\n[tool.black]"), ("pkg/setup.cfg", "")], "path string, content string")
    got = {k: rows(v) for k, v in gold.conventions(f, contents).items()}
    assert got == {
        "test_framework": [("jest", "web/jest.config.ts")],
        "test_dirs": [("test",), ("tests",)],
        "linters": [("flake8", "deep/.flake8"), ("ruff", "PyProject.toml"), ("black", "PyProject.toml")],
        "ci_pipelines": [("github_actions", ".github/workflows/ci.yml")],
        "contribution_docs": [("CONTRIBUTING.md",)],
        "package_manager": [("poetry",)],
    }


def test_roll_up_takes_the_worst_and_missing_risk_is_low(spark):
    spots = spark.createDataFrame([("a/x", 1, None), ("a/y", 5, None), ("z", 2, None)], "path string, touch_count long, last_touched string")
    risk = spark.createDataFrame([("a/x", "high", 0.9)], "path string, risk_level string, risk_score double")
    got = {r["directory"]: (r["files"], r["risk_level"]) for r in serving.directory_risk(spots, risk).collect()}
    assert got == {"a": (["a/y", "a/x"], "high"), "(root)": (["z"], "low")}


def test_ignored_dirs_and_containment(spark):
    one = spark.range(1)
    assert one.select(paths.in_ignored_dir(F.lit("a/Node_Modules/x.js")), paths.in_ignored_dir(F.lit("a/build")), paths.inside(F.lit("a/../b")), paths.inside(F.lit("a/../../b")), paths.inside(F.lit("/etc"))).first()[:] == (True, False, True, False, False)
