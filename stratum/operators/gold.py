"""Repository analytics: structure, hotspots, co-change, authorship, risk, entry points, conventions.

``touches`` everywhere: one row for each file of each commit, with columns ``sha``, ``path``,
``author``, ``date`` and ``ord`` (place of the commit in the log, newest first) and optional
leading key columns ``by`` (such as repo_slug) that keep repositories apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratum.functions.paths import BINARY_SUFFIXES, base_name, file_suffix, top_level

MAX_FILES_PER_COMMIT, MIN_SUPPORT, TOP_HOTSPOTS, TOP_AUTHORS, TOP_START = 50, 3, 20, 3, 15

# Fixed values: (pattern, reason, points) of files to read first, in the pipeline's and the prompt's version.
START_HERE = (
    (r"(?i)^readme(\..+)?$", "project_overview", 100),
    (r"(?i)^contributing(\..+)?$", "contribution_guidelines", 95),
    (r"(?i)^docs?/", "documentation", 90),
    (r"(?i)^pyproject\.toml$", "python_project_config", 85),
    (r"(?i)^package\.json$", "node_project_config", 85),
    (r"(?i)^makefile$", "build_entrypoint", 80),
    (r"(?i)^dockerfile$", "runtime_entrypoint", 75),
    (r"(?i)^src/main\.", "application_entrypoint", 75),
    (r"(?i)^src/app\.", "application_entrypoint", 70),
    (r"(?i)^tests?/", "test_suite", 70),
    (r"(?i)^\.github/workflows/", "ci_workflow", 68),
)
START_HERE_PROMPT = (
    (r"(?i)^readme(\..+)?$", "project overview", 100),
    (r"(?i)^contributing(\..+)?$", "contribution guide", 95),
    (r"(?i)^docs?/", "documentation", 90),
    (r"(?i)^pyproject\.toml$", "python project config", 85),
    (r"(?i)^package\.json$", "node project config", 85),
    (r"(?i)^makefile$", "build entrypoint", 80),
    (r"(?i)^dockerfile", "runtime entrypoint", 75),
    (r"(?i)^tests?/", "test suite", 70),
    (r"(?i)^\.github/workflows/", "ci workflow", 68),
    (r"(?i)^src/main\.", "application entrypoint", 68),
    (r"(?i)^src/app\.", "application entrypoint", 65),
)

# Fixed values: (convention, its value, file name) in order of precedence; a name matches anywhere in the tree.
BY_NAME = (
    ("linter", "editorconfig", ".editorconfig"),
    ("linter", "ruff", "ruff.toml"),
    ("linter", "ruff", ".ruff.toml"),
    ("linter", "flake8", ".flake8"),
    ("linter", "eslint", ".eslintrc"),
    ("linter", "eslint", ".eslintrc.js"),
    ("linter", "eslint", ".eslintrc.json"),
    ("linter", "eslint", ".eslintrc.yml"),
    ("linter", "eslint", ".eslintrc.yaml"),
    ("linter", "prettier", ".prettierrc"),
    ("linter", "prettier", ".prettierrc.json"),
    ("linter", "prettier", ".prettierrc.js"),
    ("linter", "prettier", ".prettierrc.yml"),
    ("package_manager", "poetry", "poetry.lock"),
    ("package_manager", "pipenv", "pipfile.lock"),
    ("package_manager", "npm", "package-lock.json"),
    ("package_manager", "yarn", "yarn.lock"),
    ("package_manager", "pnpm", "pnpm-lock.yaml"),
    ("package_manager", "cargo", "cargo.lock"),
    ("package_manager", "go_modules", "go.sum"),
    ("package_manager", "bundler", "gemfile.lock"),
    ("pytest", "pytest", "pytest.ini"),
    ("setup", "setup", "setup.cfg"),
    ("jest", "jest", "jest.config.js"),
    ("jest", "jest", "jest.config.ts"),
    ("jest", "jest", "jest.config.mjs"),
    ("jest", "jest", "jest.config.cjs"),
)
# Where pipelines are kept, names of documents for contributors, names of test folders.
CI_MARKERS = (("github_actions", ".github/workflows/"), ("gitlab_ci", ".gitlab-ci.yml"), ("jenkins", "jenkinsfile"), ("circleci", ".circleci/"), ("travis_ci", ".travis.yml"))
CONTRIBUTION_DOCS = ("contributing.md", "contributing.rst", "contributing.txt", "code_of_conduct.md", "pull_request_template.md")
TEST_DIRS = ("tests", "test", "__tests__", "spec")


def structure(files: DataFrame, key: Column, name: str, count: str = "file_count", by: Sequence[str] = ()) -> DataFrame:
    """(by, name, count) of files by ``key``, most first, then by key."""
    return files.groupBy(*by, key.alias(name)).agg(F.count("*").alias(count)).orderBy(*by, F.desc(count), name)


def directory_counts(files: DataFrame, path: str = "path", by: Sequence[str] = ()) -> DataFrame:
    return structure(files, top_level(F.col(path)), "dir", by=by)


def suffix_counts(files: DataFrame, path: str = "path", by: Sequence[str] = ()) -> DataFrame:
    ext = file_suffix(F.col(path))
    return structure(files, F.when(ext == "", "[no_ext]").otherwise(ext), "extension", by=by)


def touches_of(commits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Touches from commits with an array of ``files``."""
    return commits.select(*by, "sha", "author", "date", "ord", F.explode("files").alias("path"))


def all_hotspots(touches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, touch_count, last_touched): occurrences, and the date at the first place in the log."""
    return touches.groupBy(*by, "path").agg(F.count("*").alias("touch_count"), F.min_by("date", "ord").alias("last_touched"))


def hotspots(touches: DataFrame, top_n: int = TOP_HOTSPOTS, by: Sequence[str] = ()) -> DataFrame:
    """The ``top_n`` most touched files, ties by path."""
    ranked = all_hotspots(touches, by)
    if not by:
        return ranked.orderBy(F.desc("touch_count"), "path").limit(top_n)
    order = Window.partitionBy(*by).orderBy(F.desc("touch_count"), "path")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).drop("rank")


def co_changes(touches: DataFrame, min_support: int = MIN_SUPPORT, most: int = MAX_FILES_PER_COMMIT, by: Sequence[str] = ()) -> DataFrame:
    """(by, file_a, file_b, co_change_count) of files changed together in ``min_support`` commits or more.

    Commits of more than ``most`` distinct files are noise and left out, so a row makes ``most *
    (most - 1) / 2`` pairs at most; pairs come from the sorted array of a commit's files without a join.
    """
    # dealt by commit once: distinct files and a commit's array need no second shuffle
    files = touches.select(*by, "sha", "path").repartition(*by, "sha").distinct()
    files = files.groupBy(*by, "sha").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("files")).where(F.col("n").between(2, most))
    pairs = F.flatten(F.transform("files", lambda a, i: F.transform(F.slice("files", i + 2, F.size("files")), lambda b: F.struct(a.alias("file_a"), b.alias("file_b")))))
    counted = files.select(*by, F.explode(pairs).alias("pair")).groupBy(*by, "pair.file_a", "pair.file_b").agg(F.count("*").alias("co_change_count"))
    return counted.where(F.col("co_change_count") >= min_support)


def coupling_degree(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, co_change_degree): pairs that a file stands in."""
    ends = pairs.select(*by, F.explode(F.array("file_a", "file_b")).alias("path"))
    return ends.groupBy(*by, "path").agg(F.count("*").alias("co_change_degree"))


def author_counts(touches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return touches.groupBy(*by, "path", "author").agg(F.count("*").alias("commit_count"), F.min("ord").alias("first"))


def top_authors(touches: DataFrame, files: DataFrame | None = None, top: int = TOP_AUTHORS, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, rank, author, commit_count): the ``top`` authors of each file, ties to the first seen."""
    if files is not None:
        touches = touches.join(files.select(*by, "path").distinct(), [*by, "path"], "left_semi")
    order = Window.partitionBy(*by, "path").orderBy(F.desc("commit_count"), "first", "author")
    return author_counts(touches, by).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("first")


def file_figures(touches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, touch_count, distinct_authors) in one pass over the touches: by file and author, then by file."""
    people = touches.groupBy(*by, "path", "author").agg(F.count("*").alias("n"))
    return people.groupBy(*by, "path").agg(F.sum("n").alias("touch_count"), F.count("*").alias("distinct_authors"))


def authorship(touches: DataFrame, files: DataFrame | None = None, top: int = TOP_AUTHORS, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, total_commits, distinct_authors, primary_contributors) of files that have commits.

    ``files`` with an ``ord`` give their place in the list too, and rows in its order; the first place counts.
    """
    listed_files = None if files is None else files.groupBy(*by, "path").agg(*([F.min("ord").alias("ord")] if "ord" in files.columns else []), F.count("*").alias("__n")).drop("__n")
    if files is not None:
        touches = touches.join(listed_files, [*by, "path"], "left_semi")
    people = author_counts(touches, by)
    order = Window.partitionBy(*by, "path").orderBy(F.desc("commit_count"), "first", "author")
    ranked = people.withColumn("rank", F.row_number().over(order))
    listed = F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", F.col("author").alias("name"), "commit_count")))
    out = ranked.groupBy(*by, "path").agg(F.sum("commit_count").alias("total_commits"), F.count("*").alias("distinct_authors"), F.transform(F.sort_array(listed), lambda x: F.struct(x["name"].alias("name"), x["commit_count"].alias("commit_count"))).alias("primary_contributors"))
    return out if files is None or "ord" not in files.columns else out.join(listed_files, [*by, "path"]).orderBy(*by, "ord")


def risk_levels(spots: DataFrame, pairs: DataFrame, owners: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Hotspots with a score of churn, authors and coupling, each scaled to its range among the hotspots.

    ``owners`` may be left out where ``spots`` have ``distinct_authors``, as from ``file_figures``.
    A signal that is the same for all hotspots counts 0.5.  Levels are of the score before rounding.
    """
    keys = [*by, "path"]
    rows = spots if owners is None else spots.join(owners.select(*keys, "distinct_authors"), keys, "left")
    rows = rows.join(coupling_degree(pairs, by), keys, "left")
    rows = rows.withColumns({"distinct_authors": F.coalesce("distinct_authors", F.lit(1)), "co_change_degree": F.coalesce("co_change_degree", F.lit(0))})
    frame = Window.partitionBy(*by)

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(frame), F.max(c).over(frame)
        return F.when(low == high, 0.5).otherwise((F.col(c) - low) / (high - low))

    rows = rows.withColumn("score", 0.5 * scaled("touch_count") + 0.3 * scaled("distinct_authors") + 0.2 * scaled("co_change_degree"))
    level = F.when(F.col("score") > 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low")
    return rows.select(*keys, level.alias("risk_level"), F.round("score", 4).alias("risk_score"), "touch_count", "distinct_authors", "co_change_degree")


def start_here(files: DataFrame, path: str = "path", top: int = TOP_START, patterns: Sequence[tuple[str, str, int]] = START_HERE, skip_binary: bool = True) -> DataFrame:
    """(path, score, reasons): files whose path meets patterns, points added up, best first."""
    name = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    score = sum((F.when(F.col("path").rlike(p), n).otherwise(0) for p, _, n in patterns), F.lit(0))
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.col("path").rlike(p), r) for p, r, _ in patterns)))))
    rows = files.select(name.alias("path"))
    if skip_binary:
        rows = rows.where(~file_suffix(F.col("path")).isin(*BINARY_SUFFIXES))
    rows = rows.select("path", score.alias("score"), reasons.alias("reasons")).where("score > 0")
    return rows.orderBy(F.desc("score"), "path").limit(top)


def named_conventions(files: DataFrame, path: str = "path", order: str = "ord", rules: Sequence[tuple[str, str, str]] = BY_NAME) -> DataFrame:
    """(convention, value, config_path): for each value its first rule that a file meets.

    A rule's name at the root wins over the same name deeper down, then the earlier file wins.
    Paths that differ only in case are one file: the last path at the first place.
    """
    spark = files.sparkSession
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "prio int, convention string, value string, name string")
    low = F.lower(F.col(path))
    seen = files.groupBy(low.alias("low")).agg(F.max_by(path, order).alias("path"), F.min(order).alias("place"))
    seen = seen.withColumn("name", base_name(F.col("low")))
    # a name with no folder in it equals the last part of the path it ends
    met = seen.join(F.broadcast(table), "name").withColumn("deep", F.col("low") != F.col("name"))
    best = met.groupBy("convention", "value").agg(F.min_by("path", F.struct("prio", "deep", "place")).alias("config_path"), F.min("prio").alias("prio"))
    return best.select("convention", "value", "config_path", "prio")


def ci_pipelines(files: DataFrame, path: str = "path", order: str = "ord") -> DataFrame:
    """(platform, config_path): the first file under each platform's marker."""
    markers = F.array(*(F.struct(F.lit(p).alias("platform"), F.lit(m).alias("marker")) for p, m in CI_MARKERS))
    rows = files.select(path, order, F.explode(markers).alias("m")).where(F.lower(F.col(path)).startswith(F.col("m.marker")))
    return rows.groupBy(F.col("m.platform").alias("platform")).agg(F.min_by(path, order).alias("config_path"))


def contribution_docs(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(base_name(F.lower(F.col(path))).isin(*CONTRIBUTION_DOCS)).select(path)


def test_dirs(files: DataFrame, path: str = "path") -> DataFrame:
    """Distinct first parts of paths that name tests, in order; a root file of that name counts."""
    first = F.split_part(F.col(path), F.lit("/"), F.lit(1))
    return files.where(F.lower(first).isin(*TEST_DIRS)).select(first.alias("test_dir")).distinct().orderBy("test_dir")


def conventions(files: DataFrame, contents: DataFrame, path: str = "path", order: str = "ord") -> dict[str, DataFrame]:
    """All detections; ``contents``: (path, content) of at least the root configuration files.

    jest overrides pytest; pytest.ini overrides pyproject.toml, which overrides setup.cfg.
    """
    named = named_conventions(files, path, order)
    text = contents.select(F.lower(F.col("path")).alias("low"), F.col("path").alias("config_path"), "content")
    root = text.where("low = 'pyproject.toml'")
    setup = named.where("convention = 'setup'").select("config_path").join(contents.withColumnRenamed("path", "config_path"), "config_path")
    candidates = [
        named.where("convention = 'jest'").select(F.lit(0).alias("place"), F.lit("jest").alias("name"), "config_path"),
        named.where("convention = 'pytest'").select(F.lit(1).alias("place"), F.lit("pytest").alias("name"), "config_path"),
        root.where(F.col("content").contains("[tool.pytest.ini_options]")).select(F.lit(2).alias("place"), F.lit("pytest").alias("name"), "config_path"),
        setup.where(F.col("content").contains("[tool:pytest]")).select(F.lit(3).alias("place"), F.lit("pytest").alias("name"), "config_path"),
    ]
    framework = candidates[0]
    for c in candidates[1:]:
        framework = framework.unionByName(c)
    by_file = named.where("convention = 'linter'").select(F.col("value").alias("name"), "config_path", "prio")
    ruff = root.where(F.col("content").contains("[tool.ruff]")).select(F.lit("ruff").alias("name"), "config_path", F.lit(100).alias("prio"))
    black = root.where(F.col("content").contains("[tool.black]")).select(F.lit("black").alias("name"), "config_path", F.lit(101).alias("prio"))
    linters = by_file.unionByName(ruff.join(by_file, "name", "left_anti")).unionByName(black)
    return {
        "test_framework": framework.orderBy("place").limit(1).select("name", "config_path"),
        "test_dirs": test_dirs(files, path),
        "linters": linters.orderBy("prio").select("name", "config_path"),
        "ci_pipelines": ci_pipelines(files, path, order),
        "contribution_docs": contribution_docs(files, path),
        "package_manager": named.where("convention = 'package_manager'").orderBy("prio").limit(1).select("value"),
    }
