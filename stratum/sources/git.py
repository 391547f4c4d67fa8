"""Repositories as tables: checkout, file list with hashes, commit log, manifest and artefacts."""

from __future__ import annotations

import operator
import subprocess
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from stratum.functions.paths import content_hash, in_ignored_dir, slug
from stratum.schemas import MANIFEST

MAX_COMMITS = 500
#: Commits of a partition.
PART_COMMITS = 1_000
LOG = "%H%x1f%cI%x1f%aN%x1f%aE%x1f%B%x1e"


def git(*args: str, cwd: str | Path | None = None) -> str:
    return subprocess.run(["git", *args], cwd=cwd, check=True, capture_output=True, text=True, errors="replace").stdout


def fetch_or_clone(url: str, folder: Path, branch: str | None = None, depth: int | None = None) -> None:
    """Bring a checkout up to date, or make one; a folder that is there without a repository is an error."""
    deep = ["--depth", str(depth)] if depth else []
    if (folder / ".git").exists():
        known = git("remote", cwd=folder).split()
        git("remote", "set-url" if "origin" in known else "add", "origin", url, cwd=folder)
        git("fetch", *deep, "origin", *([branch] if branch else []), cwd=folder)
        if branch:
            try:
                git("checkout", branch, cwd=folder)
            except subprocess.CalledProcessError:
                git("checkout", "-B", branch, f"origin/{branch}", cwd=folder)
        return
    if folder.exists():
        raise FileExistsError(f"{folder} is there and isn't a repository")
    git("clone", *deep, *(["--branch", branch] if branch else []), url, str(folder))


def head_commit(folder: Path) -> str | None:
    try:
        return git("rev-parse", "HEAD", cwd=folder).strip() or None
    except subprocess.CalledProcessError:
        return None


def default_branch(folder: Path) -> str | None:
    for args in (("symbolic-ref", "--short", "refs/remotes/origin/HEAD"), ("rev-parse", "--abbrev-ref", "HEAD")):
        try:
            name = git(*args, cwd=folder).strip().removeprefix("origin/")
            return None if name in ("", "HEAD") else name
        except subprocess.CalledProcessError:
            continue
    return None


class GitLog(DataSource):
    """``spark.read.format("git_log")`` with options path (one on each line), pass (meta or stat), most (commits) and part (commits a partition).

    A repository's log is read in parts of consecutive commits, each a partition; ``line_no`` goes on
    from part to part where a line is a commit, and begins anew in each where lines belong to commits.
    Filters on ``repo`` and ``part`` leave out partitions, so what they rule out isn't read.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "repo string, part int, line_no int, value string"

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _LogReader(self.options)


class _LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.kind, self.most, self.size = options["path"].split("\n"), options.get("pass", "meta"), int(options.get("most", MAX_COMMITS)), int(options.get("part", PART_COMMITS))
        self.wanted: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        tests = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, some: x in some}
        for f in filters:
            if type(f) in tests and f.attribute in (("repo",), ("part",)):
                self.wanted.append((f.attribute[0], tests[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            if not all(test(path, value) for name, test, value in self.wanted if name == "repo"):
                continue
            try:
                commits = int(git("rev-list", "--count", f"-n{self.most}", "HEAD", cwd=path))
            except subprocess.CalledProcessError:
                commits = 1  # without a commit: its only part says so when it is read
            parts = range(-(-commits // self.size))
            out += [InputPartition((path, k)) for k in parts if all(test(k, value) for name, test, value in self.wanted if name == "part")]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        path, part = partition.value
        first = part * self.size
        form = [f"--pretty=format:{LOG}"] if self.kind == "meta" else ["--numstat", "--pretty=format:__COMMIT__%H"]
        text = git("log", f"--skip={first}", f"-n{min(self.size, self.most - first)}", *form, cwd=path)
        begin = first if self.kind == "meta" else 0
        for k, line in enumerate(text.split("\x1e") if self.kind == "meta" else text.splitlines()):
            if line.strip():
                yield path, part, begin + k, line


def read_log(spark: SparkSession, folders: list[str], kind: str, most: int = MAX_COMMITS, part: int = PART_COMMITS) -> DataFrame:
    """(repo, part, line_no, value) of the last ``most`` commits of each checkout: their records (meta) or changed files (stat)."""
    spark.dataSource.register(GitLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("git_log").options(path="\n".join(folders), most=str(most), part=str(part), **{"pass": kind}).load()


def parse_meta(records: DataFrame) -> DataFrame:
    """(repo, ord, sha, author_date, author_name, author_email, message) from records of the first pass.

    ``author_date`` is the committer's date.  Records of fewer than five fields are left out.
    """
    part = F.split(F.trim(F.regexp_replace("value", r"^\s+", "")), "\x1f", 5)
    rows = records.select("repo", F.col("line_no").alias("ord"), part.alias("p")).where(F.size("p") == 5)
    return rows.select("repo", "ord", *(F.trim(F.col("p")[k]).alias(n) for k, n in enumerate(("sha", "author_date", "author_name", "author_email"))), F.regexp_replace(F.col("p")[4], r"^\s+|\s+$", "").alias("message"))


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(repo, sha, line_no, path, additions, deletions): each line belongs to the last header before it; '-' is 0."""
    # a part begins with a commit's header
    before = Window.partitionBy(*(c for c in ("repo", "part") if c in lines.columns)).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("value").startswith("__COMMIT__"), F.substring("value", 11, 64))
    rows = lines.withColumn("value", F.trim("value")).withColumn("sha", F.last(head, ignorenulls=True).over(before))
    part = F.split("value", "\t", 3)
    rows = rows.where(~F.col("value").startswith("__COMMIT__") & F.col("sha").isNotNull()).select("repo", "sha", "line_no", part.alias("p")).where(F.size("p") == 3)
    number = lambda c: F.when(F.trim(c).isin("", "-"), 0).otherwise(F.trim(c).try_cast("int"))
    rows = rows.select("repo", "sha", "line_no", F.replace(F.trim(F.col("p")[2]), F.lit("\\"), F.lit("/")).alias("path"), number(F.col("p")[0]).alias("additions"), number(F.col("p")[1]).alias("deletions"))
    return rows.where("additions is not null and deletions is not null")


def commit_log(meta: DataFrame, stat: DataFrame) -> DataFrame:
    """Commits with their files in log order; a commit without files keeps an empty list."""
    files = parse_numstat(stat).groupBy("repo", "sha").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "path", "additions", "deletions"))), lambda x: F.struct(x["path"].alias("path"), x["additions"].alias("additions"), x["deletions"].alias("deletions"))).alias("files_changed"))
    empty = F.array().cast("array<struct<path:string,additions:int,deletions:int>>")
    return parse_meta(meta).join(files, ["repo", "sha"], "left").withColumn("files_changed", F.coalesce("files_changed", empty))


def file_list(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, content_hash, size_bytes) of a checkout's files outside ignored directories."""
    root = folder.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    at = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    rows = rows.select(F.substring(at, len(root) + 1, 1 << 30).alias("path"), F.col("content"), F.col("length").alias("size_bytes"))
    rows = rows.where(~in_ignored_dir(F.col("path")) & ~F.col("path").startswith(".git/"))
    return rows.withColumn("content_hash", content_hash(F.col("path"), F.col("content")))


def ingest(spark: SparkSession, url: str, folder: str) -> dict[str, DataFrame]:
    """The tables of one checkout: files, commits and touches."""
    commits = commit_log(read_log(spark, [folder], "meta"), read_log(spark, [folder], "stat"))
    touches = commits.select("sha", "ord", F.col("author_date").alias("date"), F.col("author_name").alias("author"), F.explode("files_changed.path").alias("path"))
    repo = spark.range(1).select(F.lit(url).alias("repo_url"), slug(F.lit(url)).alias("repo_slug"), F.lit(head_commit(Path(folder))).alias("head_commit"), F.lit(default_branch(Path(folder))).alias("default_branch"))
    return {"repo": repo, "files": file_list(spark, folder), "commits": commits, "touches": touches}


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("source", F.input_file_name())


def manifest_touches(manifests: DataFrame) -> DataFrame:
    log = manifests.select("repo_slug", F.posexplode("commit_log").alias("ord", "c"))
    return log.select("repo_slug", "ord", F.col("c.sha").alias("sha"), F.col("c.author_date").alias("date"), F.col("c.author_name").alias("author"), F.explode("c.files_changed.path").alias("path"))
