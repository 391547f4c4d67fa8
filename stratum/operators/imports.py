"""Import graphs: names imported by each source file, and who imports what."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stratum.functions import lexing
from stratum.functions.paths import LANGUAGE_BY_SUFFIX, MAX_PARSED_BYTES, file_suffix, resolve_relative_import

#: Suffixes that are parsed; TypeScript is read as JavaScript.
PARSED = (".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".java")


def python_imports(source: str) -> list[str]:
    """Modules of import statements; of 'from' imports module and plain names joined, aliased names left out."""
    out = []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return out

    def walk(node: ast.AST) -> None:
        if isinstance(node, ast.Import):
            out.extend(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            names = [node.module] if node.module else []
            names += [a.name for a in node.names if a.asname is None and a.name != "*"]
            if names or node.level:
                out.append("." * node.level + ".".join(names))
        for child in ast.iter_child_nodes(node):
            walk(child)

    walk(tree)
    return out


def imports_of(path: str, source: str) -> list[str]:
    language = LANGUAGE_BY_SUFFIX.get("." + path.rsplit(".", 1)[-1].lower())
    if language == "python":
        return python_imports(source)
    # the lexer reads bytes as characters
    found = (lexing.java_imports if language == "java" else lexing.javascript_imports)(source.encode(errors="replace").decode("latin-1"))
    return [name.encode("latin-1").decode(errors="replace") for name in found]


def import_edges(files: DataFrame) -> DataFrame:
    """(path, pos, raw_import, key) of files (path, content): key is the resolved target, or the raw name.

    Large files and files without an import word are left out before the parser sees them.
    """
    text = F.col("content").cast("string")
    rows = files.where(file_suffix(F.col("path")).isin(*PARSED) & (F.octet_length("content") <= MAX_PARSED_BYTES))
    rows = rows.where(text.contains("import") | text.contains("from") | text.contains("require")).select("path", text.alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "imports": [imports_of(p, c) for p, c in zip(pdf["path"], pdf["content"], strict=True)]})

    found = rows.mapInPandas(run, "path string, imports array<string>")
    edges = found.select("path", F.posexplode("imports").alias("pos", "raw_import"))
    is_python = file_suffix(F.col("path")).isin(".py", ".pyi")
    return edges.withColumn("key", F.coalesce(F.when(is_python & F.col("raw_import").startswith("."), resolve_relative_import(F.col("path"), F.col("raw_import"))), F.col("raw_import")))


def imports_map(edges: DataFrame) -> DataFrame:
    """(path, imports) in order, repeats kept."""
    return edges.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "raw_import"))), lambda x: x["raw_import"]).alias("imports"))


def imported_by(edges: DataFrame) -> DataFrame:
    """(key, files) in path order, repeats kept."""
    return edges.groupBy("key").agg(F.sort_array(F.collect_list("path")).alias("files"))


def link_edges(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, pos, href) of every link of a page: the same graph over web pages, all native."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r'href="([^"]*)"'), 1)
    return pages.select(F.col(id_col).alias("page"), F.posexplode(links).alias("pos", "href"))
