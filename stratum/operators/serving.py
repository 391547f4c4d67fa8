"""What front ends ask for: roll-ups, related files, prompt context, repository search, histories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratum.functions.paths import base_name, file_suffix, top_level

FILE_CHARS, TOTAL_CHARS, LISTED_FILES = 4_000, 16_000, 400

# The mark of a text that was cut, and the white space that is taken off before it.
MARK = "\n...[truncated]"
SPACES_AT_END = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+$"

# Patterns of files that go into a prompt first, in order.
PREFERRED = (
    r"(?i)(^|/)readme(\..+)?$",
    r"(?i)(^|/)contributing(\..+)?$",
    r"(?i)(^|/)pyproject\.toml$",
    r"(?i)(^|/)package\.json$",
    r"(?i)(^|/)requirements[^/]*\.txt$",
    r"(?i)(^|/)dockerfile",
    r"(?i)(^|/)docker-compose",
    r"(?i)(^|/)makefile$",
    r"(?i)(^|/)pytest\.ini$",
    r"(?i)^\.github/workflows/",
    r"(?i)^docs?/",
)


def clean_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Distinct non-empty paths with forward slashes, in order."""
    return files.where(F.coalesce(F.col(path), F.lit("")) != "").select(F.replace(F.col(path), F.lit("\\"), F.lit("/")).alias("path")).distinct().orderBy("path")


def common(files: DataFrame, key: Column, top: int = 12) -> DataFrame:
    """(name, count): the most common keys, ties to the key of the first path."""
    return files.groupBy(key.alias("name")).agg(F.count("*").alias("count"), F.min("path").alias("first")).orderBy(F.desc("count"), "first").limit(top).drop("first")


def common_directories(files: DataFrame, top: int = 12) -> DataFrame:
    return common(files, top_level(F.col("path")), top)


def common_suffixes(files: DataFrame, top: int = 12) -> DataFrame:
    ext = file_suffix(F.col("path"))
    return common(files, F.when(ext == "", "[no_ext]").otherwise(ext), top)


def top_contributors(listed: DataFrame, top: int = 8) -> DataFrame:
    """(name, commits) summed over the files' own top lists, so rarer authors count less than they did."""
    people = listed.select(F.explode("primary_contributors").alias("c"))
    return people.groupBy(F.col("c.name").alias("name")).agg(F.sum("c.commit_count").alias("commits")).orderBy(F.desc("commits"), "name").limit(top)


def hotspots_with_risk(spots: DataFrame, risk: DataFrame) -> DataFrame:
    rows = spots.join(risk.select("path", "risk_level", "risk_score"), "path", "left")
    return rows.withColumns({"risk_level": F.coalesce("risk_level", F.lit("low")), "risk_score": F.coalesce("risk_score", F.lit(0.0)), "name": base_name(F.col("path"))})


def directory_risk(spots: DataFrame, risk: DataFrame) -> DataFrame:
    """(directory, files, risk_level): files by touches, the worst level of each directory."""
    rows = hotspots_with_risk(spots, risk)
    place = F.when(F.col("risk_level") == "high", 0).when(F.col("risk_level") == "medium", 1).otherwise(2)
    folder = F.when(F.instr("path", "/") > 0, top_level(F.col("path"))).otherwise("(root)")
    files = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("touch_count")).alias("less"), "path"))), lambda x: x["path"])
    return rows.groupBy(folder.alias("directory")).agg(files.alias("files"), F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.min(place) + 1).alias("risk_level"))


def related_files(pairs: DataFrame, path: str) -> DataFrame:
    """(path, co_change_count) of the other ends of a file's pairs."""
    both = pairs.select(F.col("file_a").alias("at"), F.col("file_b").alias("path"), "co_change_count").union(pairs.select("file_b", "file_a", "co_change_count"))
    return both.where(F.col("at") == path).drop("at")


def enrich_chunks(chunks: DataFrame, risk: DataFrame, degree: DataFrame, owners: DataFrame, imports: DataFrame) -> DataFrame:
    """Chunks with their file's risk, coupling, authors and imports."""
    out = chunks
    for side in (risk.select("path", "risk_level"), degree, owners.select("path", "distinct_authors"), imports):
        out = out.join(side.withColumnRenamed("path", "file_path"), "file_path", "left")
    return out


def prompt_conventions(paths: DataFrame, pyproject: str = "") -> DataFrame:
    """(place, message) of what the inventory shows about a repository's habits."""
    low = F.lower(F.col("path"))
    some = paths.agg(
        F.max((low == "pytest.ini") | F.lit("[tool.pytest.ini_options]" in pyproject)).alias("0"), F.max(low == "package.json").alias("1"), F.max(low == "pyproject.toml").alias("2"),
        F.max(low.endswith("requirements.txt")).alias("3"), F.max(low.startswith(".github/workflows/")).alias("4"), F.max(low.startswith("dockerfile") | (low == "docker-compose.yml")).alias("5"), F.max(low == "makefile").alias("6"),
    )
    # The messages, in order.
    said = (
        "- Tests: pytest is likely configured",
        "- JavaScript package management: package.json is present",
        "- Python packaging: pyproject.toml is present",
        "- Python dependencies: requirements file is present",
        "- CI/CD: GitHub Actions workflow files are present",
        "- Containerization: Docker-related files are present",
        "- Local developer commands may be centralized in Makefile",
    )
    return some.select(F.explode(F.array_compact(F.array(*(F.when(F.col(str(k)), F.struct(F.lit(k).alias("place"), F.lit(m).alias("message"))) for k, m in enumerate(said)))))).select("col.*")


def truncated(text: Column, limit: int) -> Column:
    """The text, or its first ``limit`` characters and a mark."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), SPACES_AT_END, ""), F.lit(MARK)))


def prompt_sections(items: DataFrame, by: Sequence[str] = (), file_chars: int = FILE_CHARS, total: int = TOTAL_CHARS) -> DataFrame:
    """(by, place, path, excerpt): selected files (path, content) in order of interest until the budget is gone.

    A file uses what its excerpt has, its mark included, so all that a file can change is where the
    next begins: as long as a whole excerpt is sure to fit, running sums tell.  Only the files from
    there to the end of the budget go one after the other through a fold, without those that are
    empty, which use nothing.  Every file that isn't empty uses at least a character, so no group has
    more than ``total`` of them: Spark cuts the rest off before any row is sent, and a hot group's
    files are picked in all tasks.  A null content is an empty one; files of one path are taken in the order
    of their contents.
    """
    rank = F.coalesce(*(F.when(F.replace(F.col("path"), F.lit("\\"), F.lit("/")).rlike(p), k) for k, p in enumerate(PREFERRED)), F.lit(100))
    key = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("one"))
    content = F.coalesce(F.col("content"), F.lit(""))
    # no file can use more than its own limit, so no more than that is sent
    rows = items.select(key.alias("key"), rank.alias("rank"), F.col("path").alias("path"), F.substring(content, 1, file_chars + 1).alias("content"))
    order = [F.col(c).asc_nulls_first() for c in ("rank", "path", "content")]
    # a task's own first files, then those of all tasks
    full = rows.where("content <> ''").withColumn("task", F.spark_partition_id())
    full = full.withColumn("n", F.row_number().over(Window.partitionBy("key", "task").orderBy(*order))).where(F.col("n") <= total)
    full = full.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("n") <= total)
    cut = F.concat(F.regexp_replace(F.substring("content", 1, file_chars), SPACES_AT_END, ""), F.lit(MARK))
    whole = F.when(F.length("content") <= file_chars, F.col("content")).otherwise(cut)
    so_far = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("whole", whole).withColumn("before", F.coalesce(F.sum(F.length("whole")).over(so_far), F.lit(0).cast("long")))
    sure = full.where(F.col("before") + file_chars <= total).select("key", "rank", "path", "content", F.col("whole").alias("excerpt"))
    # the files from the first that the rest of the budget may cut
    rest = full.where(F.col("before") + file_chars > total).select("key", "n", "rank", "path", "content", "before")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, rank int, path string, content string, excerpt string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, at = 0, None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if (here := repr(r["key"])) != at:
                    at, left = here, total - r["before"]
                if left > 0:
                    limit = min(file_chars, left)
                    text = r["content"] if len(r["content"]) <= limit else r["content"][:limit].rstrip() + MARK
                    left -= len(text)
                    out.append((r["key"], r["rank"], r["path"], r["content"], text))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((batch.schema.field("key").type, pa.int32(), pa.string(), pa.string(), pa.string()))], ["key", "rank", "path", "content", "excerpt"])

    ends = rest.repartition("key").sortWithinPartitions("key", "n").mapInArrow(run, schema)
    taken = sure.unionByName(ends)
    # empty files that stand before the one with which the budget is gone
    used = taken.groupBy("key").agg(F.sum(F.length("excerpt")).alias("used"), F.max(F.struct("rank", "path", "content")).alias("end"))
    none = rows.where("content = ''").join(used, "key", "left").where(F.col("used").isNull() | (F.col("used") < total) | (F.struct("rank", "path", "content") < F.col("end")))
    every = taken.unionByName(none.select("key", "rank", "path", "content", F.lit("").alias("excerpt")))
    place = F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1
    return every.withColumn("place", place).select(*(F.col("key")[c].alias(c) for c in by), "place", "path", "excerpt")


def bullet_lines(rows: DataFrame, template: str, *columns: str, order: Sequence[Column | str] = (), top: int | None = None) -> DataFrame:
    """(line): one formatted line a row, missing values as 'unknown'."""
    rows = rows.orderBy(*order) if order else rows
    rows = rows.limit(top) if top is not None else rows
    return rows.select(F.format_string("- " + template, *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns)).alias("line"))


def _listed(parts: Column, most: int) -> Column:
    return F.array_join(F.slice(F.filter(parts, lambda x: x.isNotNull()), 1, most), ", ")


# What the lines of a repository's snapshot say, and how many of each there are at most.
SNAPSHOT = {
    "top_level": (12, lambda: F.format_string("- %s: %s files", "dir", "file_count")),
    "file_types": (12, lambda: F.format_string("- %s: %s files", "extension", "file_count")),
    "start_here": (12, lambda: F.format_string("- %s (%s)", F.col("path"), _listed(F.col("reasons"), 4))),
    "hotspots": (10, lambda: F.format_string("- %s: %s touches; last touched %s", F.col("path"), F.col("touch_count"), F.coalesce(F.col("last_touched").cast("string"), F.lit("unknown")))),
    "risk": (10, lambda: F.format_string("- %s: risk=%s score=%s", F.col("path"), F.col("risk_level"), F.col("risk_score").cast("string"))),
    "authorship": (8, lambda: F.concat(F.format_string("- %s: %s commits", "path", "total_commits"), F.when(F.size("primary_contributors") > 0, F.concat(F.lit("; primary contributors: "), _listed(F.transform("primary_contributors", lambda c: c["name"]), 3))).otherwise(""))),
    "contributors": (8, lambda: F.format_string("- %s: %s commits across listed files", "name", "commits")),
    "co_changes": (10, lambda: F.format_string("- %s <-> %s: %s co-changes", "file_a", "file_b", "co_change_count")),
}


def snapshot_lines(kind: str, rows: DataFrame, *order: Column | str) -> DataFrame:
    """(line): the first rows of one of the eight parts of a snapshot, in order, as prompts show them."""
    most, line = SNAPSHOT[kind]
    return (rows.orderBy(*order) if order else rows).limit(most).select(line().alias("line"))


def context(sections: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(text): titled sections of (place, line) rows joined to one prompt."""
    out = None
    for k, (title, rows) in enumerate(sections):
        one = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body")).select(F.lit(k).alias("k"), F.concat(F.lit(f"## {title}\n"), F.col("body")).alias("body"))
        out = one if out is None else out.union(one)
    return out.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "body"))), lambda x: x["body"]), "\n\n").alias("text"))


#: Parts of a repository's context in order: their names, the lines above them, and what stands for one without lines.
CONTEXT_PARTS = (
    ("top_level", "Top-level directories by file count:", "- No top-level directory summary available"),
    ("file_types", "Most common file types:", "- No file type summary available"),
    ("start_here", "Suggested starting points:", "- No obvious entry files detected"),
    ("hotspots", "Hotspots:", "- No hotspot summary provided"),
    ("risk", "Risk areas:", "- No risk summary provided"),
    ("co_changes", "Frequently co-changed files:", "- No co-change summary provided"),
    ("contributors", "Most active contributors:", "- No contributor summary provided"),
    ("authorship", "Ownership examples:", "- No authorship summary provided"),
    ("conventions", "Detected conventions:", "- No strong conventions detected from provided files"),
)  # Fixed values: these lines.


def chosen_lines(known: DataFrame, computed: DataFrame, by: str) -> DataFrame:
    """(by, part, place, line): of each part of a repository the lines of its snapshot, or the computed ones where the snapshot has none."""
    both = known.select(by, "part", "place", "line", F.lit(0).alias("from")).unionByName(computed.select(by, "part", "place", "line", F.lit(1).alias("from")))
    first = F.min("from").over(Window.partitionBy(by, "part"))
    return both.withColumn("first", first).where(F.col("from") == F.col("first")).select(by, "part", "place", "line")


def contexts(repos: DataFrame, lines: DataFrame, by: str) -> DataFrame:
    """(by, context) of repositories (by, head, tail): the head, every part with its lines or what stands for none, and the tail.

    Null heads and tails are left out; a repository without any lines has all parts all the same.
    """
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")  # a part has a dozen lines at most
    parts = lines.groupBy(by, "part").agg(shown.alias("body")).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("part", "body"))).alias("bodies"))
    rows = repos.select(by, "head", "tail").join(parts, by, "left")
    body = lambda name, none: F.coalesce(F.element_at("bodies", F.lit(name)), F.lit(none))
    text = F.concat_ws("\n\n", "head", *(F.concat(F.lit(title + "\n"), body(name, none)) for name, title, none in CONTEXT_PARTS), "tail")
    return rows.select(by, F.trim(text).alias("context"))


def asked_prompt(before: str, after: str, user: Column, context: Column) -> Column:
    """``before``, the user's request in a part of its own where there is one, ``after`` and the context."""
    said = F.regexp_replace(F.regexp_replace(F.coalesce(user, F.lit("")), SPACES_AT_END, ""), "^" + SPACES_AT_END[:-1], "")
    part = F.when(said != "", F.concat(F.lit("\n\nAdditional user request:\n"), said, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(before), part, F.lit(after), context)


def grep(files: DataFrame, needle: str, most: int = 50, regex: bool = False, by: str = "path") -> DataFrame:
    """(path, line, text): matching lines, case aside, in path and line order, ``most`` at most."""
    lines = files.where(F.lower("content").contains(needle.lower())) if not regex else files
    lines = lines.select(by, F.posexplode(F.split("content", r"\n", -1)).alias("pos", "text"))
    hit = F.col("text").rlike(f"(?i){needle}") if regex else F.lower("text").contains(needle.lower())
    return lines.where(hit).select(F.col(by), (F.col("pos") + 1).alias("line"), "text").orderBy(by, "line").limit(most)


def children(files: DataFrame, folder: str = "", most: int = 200, path: str = "path") -> DataFrame:
    """Distinct next path parts under a folder, sorted; folders end in '/'."""
    prefix = folder.rstrip("/") + "/" if folder else ""
    rest = F.substring(F.col(path), len(prefix) + 1, 1 << 30)
    name = F.when(F.instr(rest, "/") > 0, F.concat(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit("/"))).otherwise(rest)
    return files.where(F.col(path).startswith(prefix)).select(name.alias("name")).where("name <> ''").distinct().orderBy("name").limit(most)


def read_prefix(files: DataFrame, most: int = 12_000) -> DataFrame:
    return files.select("path", F.substring("content", 1, most).alias("content"), (F.length("content") > most).alias("truncated"))


def selected_files(files: DataFrame, candidates: DataFrame, most: int = 100_000, order: str = "place") -> DataFrame:
    """(place, path, content, truncated) of the candidates (place, path) that are files, in their order; bytes that aren't UTF-8 become U+FFFD."""
    told = files.select("path", F.make_valid_utf8(F.col("content").cast("binary").cast("string")).alias("content"))
    rows = candidates.select(order, "path").join(told, "path")
    return rows.select(order, "path", F.substring("content", 1, most).alias("content"), (F.length("content") > most).alias("truncated")).orderBy(order)


def sections(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, title, body) of a text's parts that begin with '## ' at a line's start; what stands before is left out."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n## ", -1)
    rows = documents.select(id_col, F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", "part"))
    return rows.select(id_col, "pos", F.trim(F.split_part("part", F.lit("\n"), F.lit(1))).alias("title"), F.regexp_replace("part", r"^[^\n]*\n?", "").alias("body"))


def last_turns(turns: DataFrame, by: str, order: str, text: str, most: int = 10) -> DataFrame:
    """The last ``most`` turns in order; blank ones are dropped after the cut."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return turns.withColumn("__rank", rank).where((F.col("__rank") <= most) & (F.trim(F.col(text)) != "")).drop("__rank").orderBy(by, order)


def convention_checklist(records: DataFrame, *by: str) -> DataFrame:
    """(by, place, label, detail) rows of each conventions record, in fixed order."""
    found = {
        "Test framework": F.col("test_framework.name"),
        "Test directories": F.array_join("test_dirs", ", "),
        "Linters": F.array_join(F.transform("linters", lambda x: x["name"]), ", "),
        "CI": F.array_join(F.transform("ci_pipelines", lambda x: x["platform"]), ", "),
        "Contribution docs": F.array_join("contribution_docs", ", "),
        "Package manager": F.col("package_manager"),
    }
    rows = F.array(*(F.struct(F.lit(label).alias("label"), detail.alias("detail")) for label, detail in found.items()))
    return records.select(*by, F.posexplode(rows).alias("place", "row")).select(*by, "place", "row.label", "row.detail").where("detail is not null and detail <> ''")
