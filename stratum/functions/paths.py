"""Column expressions on repository paths, references and hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Directories that are never walked into.
IGNORED_DIRS = (".git", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "venv", "env", "node_modules", "dist", "build", ".next", ".nuxt")

# Suffixes of binary files, by kind.
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg", ".tiff",
    ".mp4", ".avi", ".mov", ".mkv", ".mp3", ".wav", ".flac", ".ogg",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar",
    ".pyc", ".pyo", ".so", ".dll", ".dylib", ".exe", ".class", ".o", ".a",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".bin", ".dat", ".db", ".sqlite", ".wasm",
)

# Language by suffix and by file name.
LANGUAGE_BY_SUFFIX = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust",
    ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".hpp": "cpp", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".sql": "sql", ".tf": "hcl",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".md": "markdown",
}
LANGUAGE_BY_NAME = {"Dockerfile": "dockerfile", "Makefile": "makefile", "CMakeLists.txt": "cmake"}

#: Files above this size are neither hashed nor parsed.
MAX_PARSED_BYTES = 1 << 20


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_suffix(path: Column) -> Column:
    """Lower-case last suffix with its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.][^/]*?(\.[^./]+)$", 1))


def top_level(path: Column) -> Column:
    """First part of a path, '.' for files at the root."""
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("."))


def in_ignored_dir(path: Column) -> Column:
    """Whether a directory of the path, not the file itself, is ignored."""
    dirs = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*map(F.lit, IGNORED_DIRS)))


def content_hash(path: Column, content: Column) -> Column:
    """SHA-256 of a file's bytes; empty for binary suffixes and large files."""
    big = F.octet_length(content) > MAX_PARSED_BYTES
    return F.when(big | file_suffix(path).isin(*BINARY_SUFFIXES), "").otherwise(F.sha2(content.cast("binary"), 256))


def slug(url: Column, ssh: bool = True) -> Column:
    """A folder name from a repository URL: its path with '__' for '/', other characters as '_'."""
    trimmed = F.regexp_replace(F.regexp_replace(F.trim(url), r"/+$", ""), r"\.git$", "")
    rest = F.regexp_replace(trimmed, r"^.*?://", "")
    tail = F.when(F.instr(rest, "/") > 0, F.regexp_replace(rest, r"^[^/]*/", "")).otherwise(rest)
    if ssh:
        tail = F.when(trimmed.rlike(r"^[^:]*@[^:]*:"), F.regexp_replace(trimmed, r"^[^:]*:", "")).otherwise(tail)
    name = F.regexp_replace(F.replace(tail, F.lit("/"), F.lit("__")), r"[^a-zA-Z0-9._-]", "_")
    return F.when(name == "", "repo").otherwise(name)


def repo_ref(ref: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(ref)), r"/+$", "")


def relative_path(path: Column) -> Column:
    return F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), r"^/+", "")


def salted_hash(raw: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}::"), raw), 256)


def version_key(tenant: Column, fingerprint: Column, head: Column) -> Column:
    return F.sha2(F.concat_ws(":", tenant, fingerprint, head), 256)


def repo_id(url: Column) -> Column:
    return F.sha2(F.lower(F.regexp_replace(F.trim(url), r"/+$", "")), 256)


def chunk_id(slug_: Column, path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws(":", slug_, path, start.cast("string"), end.cast("string"), F.sha2(content.cast("binary"), 256)), 256)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def language(path: Column, head: Column | None = None) -> Column:
    """By file name, then suffix, then the interpreter named in a first line that begins with '#!'."""
    out = [_lookup(LANGUAGE_BY_NAME, base_name(path)), _lookup(LANGUAGE_BY_SUFFIX, file_suffix(path))]
    if head is not None:
        line = F.lower(F.regexp_extract(head, r"\A(#![^\r\n]*)", 1))
        out.append(F.when(line.contains("python"), "python").when(line.contains("node"), "javascript").when(line.contains("bash") | line.contains("sh"), "shell"))
    return F.coalesce(*out)


def inside(path: Column) -> Column:
    """Whether a relative path stays inside its root: not absolute, and never above it."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, x: F.struct((a["d"] + F.when(x == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(x == "..", -1).otherwise(1)).alias("low")))
    return ~path.startswith("/") & (depth["low"] >= 0)


def resolve_relative_import(path: Column, name: Column) -> Column:
    """Target path of a dotted relative import, null where there are more dots than folders."""
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    parent = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda x: x != "")
    up = F.slice(parent, 1, F.greatest(F.size(parent) - dots + 1, F.lit(0)))
    rest = F.replace(F.regexp_replace(name, r"^\.+", ""), F.lit("."), F.lit("/"))
    return F.when((dots > 0) & (F.size(parent) >= dots), F.concat_ws("/", F.filter(F.concat(up, F.array(rest)), lambda x: x != "")))


IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifier(name: str) -> str:
    """The name, if it may stand in SQL unquoted."""
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name
