"""Registered queries of shards, sources of code, shuffles and safe payloads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratum.operators import chunking, corpus, gold, imports, metrics, serving, sync, tasks
from stratum.plans.registry import doc_names, query, table, touches
from stratum.sources import row_groups


@query("SELECT doc_id, CAST(epoch AS INT) AS epoch FROM documents, (VALUES (1), (2)) e(epoch)")
def row_group_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs of a shard by row groups: what is read up to some place, and what is read from there on."""
    at, options = f"{d}/documents.parquet", {"epochs": 2}
    place = row_groups.resume_at(at, most=1, **options)
    return row_groups.read_row_groups(spark, at, most=1, **options).unionByName(row_groups.read_row_groups(spark, at, start=place, **options)).select("doc_id", "epoch")


CODE = {
    "js": "// import a from 'no'\nimport {{b}} from './{lang}.js'; /* require('no') */\nconst s = \"require('no')\", t = `require('no') ${{require('{source}')}} import c from 'no'`;\nfunction f() {{ return /require('no')/ }}\n",
    "java": "package p; /* import no.A; */\nimport static q.{lang}.*;\n// import no.B;\nimport s.{source}.C;\nclass X {{ String t = \"import no.C;\"; }}\n",
}


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """A JavaScript or Java file for each document, with imports in comments, strings and templates too."""
    def made(text: str):  # noqa: ANN202
        text = text.replace("{{", "\x01").replace("}}", "\x02")
        parts = [p for chunk in text.split("{") for p in chunk.split("}")]
        back = lambda p: p.replace("\x01", "{").replace("\x02", "}")
        return F.concat(*(F.col(p) if p in ("lang", "source") else F.lit(back(p)) for p in parts))

    even = F.col("doc_id") % 2 == 0
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.concat(F.lit("f"), "doc_id", F.when(even, ".js").otherwise(".java")).alias("path"), F.when(even, made(CODE["js"])).otherwise(made(CODE["java"])).cast("binary").alias("content"))


@query("""SELECT 'f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.js' ELSE '.java' END AS path, CAST(pos AS INT) AS pos,
  CASE WHEN doc_id % 2 = 0 THEN CASE pos WHEN 0 THEN './' || lang || '.js' ELSE source END ELSE CASE pos WHEN 0 THEN 'q.' || lang ELSE 's.' || source || '.C' END END AS raw_import
FROM documents, (VALUES (0), (1)) p(pos)""")
def code_imports(spark: SparkSession, d: str) -> DataFrame:
    return imports.import_edges(code_files(spark, d)).select("path", "pos", "raw_import")


@query("""WITH f AS (SELECT doc_id, 'function f' || doc_id || '(a = {}) { return `}${ {k: ''' || lang || '}''}.k }`; }' AS one, 'class C' || doc_id || ' { m() { class In { } } /* } */ }' AS two, 'const k = ''' || source || ''';' || chr(10) AS head FROM documents)
SELECT doc_id, CAST(a AS INT) AS start_byte, CAST(b AS INT) AS end_byte FROM (
SELECT doc_id, 0 AS a, octet_length(encode(head)) AS b FROM f UNION ALL
SELECT doc_id, octet_length(encode(head)), octet_length(encode(head || one)) FROM f UNION ALL
SELECT doc_id, octet_length(encode(head || one)) + 1, octet_length(encode(head || one)) + 1 + octet_length(encode(two)) FROM f)""")
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    ident = F.col("doc_id").cast("string")
    one = F.concat(F.lit("function f"), ident, F.lit("(a = {}) { return `}${ {k: '"), "lang", F.lit("}'}.k }`; }"))
    two = F.concat(F.lit("class C"), ident, F.lit(" { m() { class In { } } /* } */ }"))
    content = F.concat(F.lit("const k = '"), "source", F.lit("';\n"), one, F.lit("\n"), two)
    files = table(spark, d, "documents").select(F.lit("r").alias("repo_slug"), F.concat(ident, F.lit(".js")).alias("path"), content.alias("content"))
    return chunking.chunk_files(files).select(F.regexp_replace("file_path", r"\.js$", "").cast("long").alias("doc_id"), "start_byte", "end_byte")


def shuffle_sql(source: str, seed: int, columns: str) -> str:
    """Nested selects that take ``p`` of ``n`` places through the rounds of ``corpus.shuffled``."""
    out = source
    for shift, a, b, c in corpus.shuffle_keys(seed):
        mirrored = f"SELECT {columns}, n, p, (({shift}::BIGINT % n) - p + n) % n AS m FROM ({out})"
        mixed = f"((greatest(p, m) % {corpus.PRIME}) * {a}::BIGINT + (greatest(p, m) // {corpus.PRIME} % {corpus.PRIME}) * {b}::BIGINT + {c}) % {corpus.PRIME}"
        out = f"SELECT {columns}, n, CASE WHEN (({mixed}) >> 15) % 2 = 1 THEN m ELSE p END AS p FROM ({mirrored})"
    return out


MIXED = """WITH t AS (SELECT doc_id, 0 AS task FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 2 FROM documents WHERE lang = 'fr'),
b AS (SELECT doc_id, task, row_number() OVER (ORDER BY task, doc_id) - 1 AS p, COUNT(*) OVER () AS n FROM t)
"""


@query(f"{MIXED} SELECT doc_id, task, p AS place FROM ({shuffle_sql('SELECT doc_id, task, n, p FROM b', 42, 'doc_id, task')})")
def mixture(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    en, fr = docs.where("lang = 'en'"), docs.where("lang = 'fr'")
    return corpus.mixture([en, fr, fr], "doc_id").select("doc_id", "task", "place")


HEAD = f"WITH b AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, COUNT(*) OVER () AS n FROM events) SELECT event_id, p AS place FROM ({shuffle_sql('SELECT event_id, n, p FROM b', 1337, 'event_id')}) WHERE p < 500"


@query(HEAD)
def seeded_head(spark: SparkSession, d: str) -> DataFrame:
    return tasks.seeded_head(table(spark, d, "events").select("event_id"), "event_id", 500).select("event_id", "place")


@query("SELECT doc_id, CAST(least(5, (SELECT COUNT(*) FROM documents) - 1) AS BIGINT) AS shots, CAST(0 AS BIGINT) AS own FROM documents")
def few_shot_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, how many different examples were drawn, and how often itself."""
    drawn = corpus.few_shot_pool(table(spark, d, "documents").select("doc_id"), "doc_id", 5)
    return drawn.groupBy("doc_id").agg(F.countDistinct("shot").alias("shots"), F.sum(F.when(F.col("doc_id") == F.col("shot"), 1).otherwise(0)).alias("own"))


@query("SELECT doc_id, sha256(text) AS joined FROM documents")
def pre_tokens_joined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every text, put together again."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.array_join(corpus.pre_tokens(F.col("text")), ""), 256).alias("joined"))


@query("SELECT event_id, event_id % 5 = 0 OR event_id % 7 = 0 AS refused FROM events")
def forbidden_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Which payloads hold a forbidden key, in a map or deep in JSON; the word in a text is none."""
    name = F.when(F.col("event_id") % 5 == 0, "Author_Email").otherwise("author")
    text = F.concat(F.lit('{"a": [1, {"'), name, F.lit('": '), "props", F.lit(', "t": "author_email"}]}'))
    tags = F.create_map(F.when(F.col("event_id") % 7 == 0, "old_commit_message").otherwise("message"), F.lit("absolute_path"))
    rows = table(spark, d, "events").select("event_id", F.struct(text.alias("text"), tags.alias("tags")).alias("payload"))
    return rows.select("event_id", sync.forbidden_keys(F.col("payload"), rows.schema["payload"].dataType).alias("refused"))


BUDGET = """WITH RECURSIVE i AS (SELECT source, coalesce(text, '') AS content, CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 5 THEN 9 ELSE 100 END AS r,
  CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'README.' || lang WHEN 1 THEN 'docs/' || doc_id || '.md' WHEN 2 THEN 'src/main.' || lang WHEN 3 THEN 'tests/t' || doc_id || '.py' WHEN 4 THEN 'logo.png' WHEN 5 THEN '.github/workflows/' || source || '.yml'
  WHEN 6 THEN source || '/' || lang || '/poetry.lock' WHEN 7 THEN source || '/.eslintrc.json' ELSE 'lib/' || source || '.JS' END || '#' || doc_id AS path FROM documents),
o AS (SELECT source, path, content, row_number() OVER (PARTITION BY source ORDER BY r, path) AS k FROM i),
f AS (SELECT source, CAST(0 AS BIGINT) AS k, NULL::VARCHAR AS path, NULL::VARCHAR AS excerpt, CAST(16000 AS BIGINT) AS budget FROM (SELECT DISTINCT source FROM o)
UNION ALL SELECT source, k, path, excerpt, budget - length(excerpt) FROM (SELECT o.source, o.k, o.path, f.budget, CASE WHEN length(content) <= least(4000, f.budget) THEN content
  ELSE rtrim(left(content, least(4000, f.budget)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) || '...[truncated]' END AS excerpt FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1 WHERE f.budget > 0))
SELECT source, CAST(k - 1 AS INT) AS place, path, excerpt FROM f WHERE k > 0"""


@query(BUDGET)
def prompt_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = doc_names(spark, d).select("source", F.concat("path", F.lit("#"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return serving.prompt_sections(rows, by=["source"])


@query("""WITH n AS (SELECT lang, CASE WHEN COUNT(*) % 2 = 0 THEN 'pytest' END AS framework, list_sort(list_distinct(list(source))) AS dirs, CASE WHEN max(n_chars) > 15000 THEN 'poetry' ELSE '' END AS manager FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang)
SELECT lang, 0 AS place, 'Test framework' AS label, framework AS detail FROM n WHERE framework IS NOT NULL UNION ALL SELECT lang, 1, 'Test directories', array_to_string(dirs, ', ') FROM n
UNION ALL SELECT lang, 2, 'Linters', 'ruff, ' || dirs[1] FROM n UNION ALL SELECT lang, 5, 'Package manager', manager FROM n WHERE manager <> ''""")
def convention_checklists(spark: SparkSession, d: str) -> DataFrame:
    """Checklists of one record for each language."""
    docs = table(spark, d, "documents").where("lang is not null and source is not null")
    named = "array<struct<name:string,config_path:string>>"
    records = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("source")).alias("test_dirs"), F.max("n_chars").alias("longest")).select(
        "lang", F.struct(F.when(F.col("n") % 2 == 0, "pytest").alias("name"), F.lit(None).cast("string").alias("config_path")).alias("test_framework"), "test_dirs",
        F.array(F.struct(F.lit("ruff").alias("name"), F.lit("a").alias("config_path")), F.struct(F.col("test_dirs")[0].alias("name"), F.lit("b").alias("config_path"))).cast(named).alias("linters"),
        F.array().cast("array<struct<platform:string,config_path:string>>").alias("ci_pipelines"), F.array().cast("array<string>").alias("contribution_docs"), F.when(F.col("longest") > 15_000, "poetry").otherwise("").alias("package_manager"))
    return serving.convention_checklist(records, "lang")


@query("SELECT p_partkey, '[' || regexp_replace(CAST(p_size / 4.0::DOUBLE AS VARCHAR), '\\.0$', '') || ',' || -p_size || ']' AS vector FROM part")
def vector_literals(spark: SparkSession, d: str) -> DataFrame:
    from stratum.operators import vectors

    return table(spark, d, "part").select("p_partkey", vectors.vector_literal(F.array(F.col("p_size") / 4.0, -F.col("p_size").cast("double"))).alias("vector"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, c_name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) JOIN customer ON c_custkey = o_custkey WHERE r = 1")
def user_documents(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), "c_name")
    documents = table(spark, d, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("version"), "o_totalprice")
    return tasks.user_documents(users, documents).select(F.col("repo_id").alias("o_custkey"), F.col("version").alias("o_orderkey"), "o_totalprice", "c_name")


REPORT = """WITH n AS (SELECT doc_id, lang, source, CAST(doc_id % 9 AS INT) AS k FROM documents),
l AS (SELECT 0 AS place, 'Test framework' AS label, max(CASE WHEN k >= 0 THEN 'pytest' END) AS detail FROM n
UNION ALL SELECT 1, 'Test directories', max(CASE WHEN k = 3 THEN 'tests' END) FROM n
UNION ALL SELECT 2, 'Linters', CASE WHEN max(CASE WHEN k = 7 THEN 1 END) = 1 THEN 'eslint,' ELSE '' END || 'ruff,black' FROM n
UNION ALL SELECT 3, 'CI', max(CASE WHEN k = 5 THEN 'github_actions' END) FROM n
UNION ALL SELECT 5, 'Package manager', max(CASE WHEN k = 6 THEN 'poetry' END) FROM n)
SELECT place, label, detail FROM l WHERE detail IS NOT NULL AND detail <> ''"""


@query(REPORT)
def conventions_report(spark: SparkSession, d: str) -> DataFrame:
    files = doc_names(spark, d)
    contents = files.groupBy(F.lit("pyproject.toml").alias("path")).agg(F.lit("[tool.pytest.ini_options]\n[tool.ruff]\n[tool.black]\n").alias("content"))
    found = gold.conventions(files, contents, order="doc_id")
    one = [(0, "Test framework", found["test_framework"], "name"), (1, "Test directories", found["test_dirs"], "test_dir"), (2, "Linters", found["linters"], "name"), (3, "CI", found["ci_pipelines"], "platform"), (4, "Contribution docs", found["contribution_docs"], "path"), (5, "Package manager", found["package_manager"], "value")]
    out = None
    for place, label, rows, column in one:
        # linters come in order of their rules, the others are one value each
        line = rows.agg(F.array_join(F.collect_list(column), ",").alias("detail")).select(F.lit(place).alias("place"), F.lit(label).alias("label"), "detail").where("detail <> ''")
        out = line if out is None else out.unionByName(line)
    return out


@query("""WITH t AS (SELECT o_orderkey AS sha, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'part/' || l_partkey AS path, (l_partkey * 7919) % 1000003 AS ord, COUNT(*) AS total_commits, COUNT(DISTINCT o_custkey) AS distinct_authors FROM t WHERE l_partkey % 10 <> 3 GROUP BY l_partkey""")
def authorship_listed(spark: SparkSession, d: str) -> DataFrame:
    """Ownership of the files of a list that leaves some out, with their places in it."""
    listed = table(spark, d, "part").where("p_partkey % 10 <> 3").select(F.concat(F.lit("part/"), "p_partkey").alias("path"), (F.col("p_partkey") * 7919 % 1_000_003).alias("ord"))
    return gold.authorship(touches(spark, d), listed).select("path", "ord", "total_commits", "distinct_authors")


@query("""WITH c AS (SELECT source, lang, COUNT(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL),
f AS (SELECT source, string_agg('- ' || lang || ': ' || n || ' files', chr(10) ORDER BY n DESC, lang) AS computed, CASE WHEN source LIKE '%1%' THEN '- known ' || source END AS known, SUM(n) AS files FROM c GROUP BY source)
SELECT source, sha256('Guide.' || CASE WHEN files % 2 = 0 THEN chr(10) || chr(10) || 'Additional user request:' || chr(10) || 'about ' || source || chr(10) ELSE '' END || ' Context: ' || 'Total files discovered: ' || files || chr(10) || chr(10)
  || 'Top-level directories by file count:' || chr(10) || '- No top-level directory summary available' || chr(10) || chr(10) || 'Most common file types:' || chr(10) || coalesce(known, computed) || chr(10) || chr(10)
  || 'Suggested starting points:' || chr(10) || '- No obvious entry files detected' || chr(10) || chr(10) || 'Hotspots:' || chr(10) || CASE WHEN source LIKE '%1%' THEN '- hot ' || source ELSE '- No hotspot summary provided' END || chr(10) || chr(10)
  || 'Risk areas:' || chr(10) || '- No risk summary provided' || chr(10) || chr(10) || 'Frequently co-changed files:' || chr(10) || '- No co-change summary provided' || chr(10) || chr(10) || 'Most active contributors:' || chr(10) || '- No contributor summary provided' || chr(10) || chr(10)
  || 'Ownership examples:' || chr(10) || '- No authorship summary provided' || chr(10) || chr(10) || 'Detected conventions:' || chr(10) || '- No strong conventions detected from provided files') AS prompt FROM f""")
def guide_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of all sources: lines of a snapshot where there is one, computed lines else, and a request of some."""
    from pyspark.sql import Window

    counts = table(spark, d, "documents").where("source is not null and lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang"))
    computed = counts.select("source", F.lit("file_types").alias("part"), place.alias("place"), F.format_string("- %s: %s files", "lang", "n").alias("line"))
    some = counts.select("source").distinct().where("source like '%1%'")
    known = some.select("source", F.explode(F.array(F.struct(F.lit("file_types").alias("part"), F.concat(F.lit("- known "), "source").alias("line")), F.struct(F.lit("hotspots").alias("part"), F.concat(F.lit("- hot "), "source").alias("line")))).alias("x")).select("source", "x.part", F.lit(1).alias("place"), "x.line")
    repos = counts.groupBy("source").agg(F.sum("n").alias("files")).select("source", "files", F.format_string("Total files discovered: %s", "files").alias("head"), F.lit(None).cast("string").alias("tail"))
    texts = serving.contexts(repos, serving.chosen_lines(known, computed, "source"), "source").join(repos.select("source", "files"), "source")
    user = F.when(F.col("files") % 2 == 0, F.concat(F.lit("  about "), "source", F.lit(" \n"))).otherwise(" ")
    return texts.select("source", F.sha2(serving.asked_prompt("Guide.", " Context: ", user, F.col("context")), 256).alias("prompt"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, k, octet_length(encode(line)) + 1 AS size FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text <> '')),
b AS (SELECT doc_id, coalesce(list(e - 1 ORDER BY e) FILTER (WHERE k < n), []) AS nl, max(e) - 1 AS total FROM (SELECT doc_id, k, COUNT(*) OVER (PARTITION BY doc_id) AS n, SUM(size) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM l) GROUP BY doc_id),
c AS (SELECT doc_id, nl, total, 0::HUGEINT AS s, CASE WHEN 1200 >= total THEN total ELSE coalesce(list_max(list_filter(nl, lambda x: x < 1200 AND x >= 300)) + 1, 1200) END AS e FROM b
UNION ALL SELECT doc_id, nl, total, s, CASE WHEN s + 1200 >= total THEN total ELSE coalesce(list_max(list_filter(nl, lambda x: x < s + 1200 AND x >= s + 300)) + 1, s + 1200) END FROM (SELECT doc_id, nl, total, greatest(e - 120, s + 1) AS s FROM c WHERE e < total))
SELECT doc_id, CAST(s AS INT) AS start_byte, CAST(e AS INT) AS end_byte, CAST(len(list_filter(nl, lambda x: x < s)) + 1 AS INT) AS start_line, CAST(len(list_filter(nl, lambda x: x < greatest(s, e - 1))) + 1 AS INT) AS end_line FROM c""")
def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the chunks of all texts begin and end, in bytes and lines."""
    files = table(spark, d, "documents").select(F.lit("r").alias("repo_slug"), F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return chunking.chunk_files(files).select(F.regexp_extract("file_path", r"(\d+)", 1).cast("long").alias("doc_id"), "start_byte", "end_byte", "start_line", "end_line")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE length(text) > 800)")
def kept_chats(spark: SparkSession, d: str) -> DataFrame:
    """Chats after those with a long message are deleted whole."""
    rows = table(spark, d, "conversations")
    return sync.delete_keyed(rows, rows.where(F.length("text") > 800), ["conv_id"]).select("conv_id", "turn", "role")


@query("""WITH c AS (SELECT lang, COUNT(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang),
m AS (SELECT source, AVG(n_chars::DOUBLE) FILTER (WHERE lang = 'en') AS en, AVG(n_chars::DOUBLE) FILTER (WHERE lang = 'fr' AND doc_id % 2 = 0) AS fr FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT '## Languages' AS line UNION ALL SELECT '- ' || lang || ': ' || n FROM c UNION ALL SELECT '## Summary' UNION ALL SELECT '| Metric | en | fr |' UNION ALL SELECT '|---|---|---|'
UNION ALL SELECT '| ' || source || ' | ' || coalesce(printf('%.4f', en), '-') || ' | ' || coalesce(printf('%.4f', fr), '-') || ' |' FROM m""")
def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    """A report of languages, and of mean lengths by source with a column for each of two languages."""
    docs = table(spark, d, "documents")
    facts = docs.where("lang is not null").groupBy(F.col("lang").alias("key")).agg(F.count("*").alias("value")).orderBy("key")
    mean = lambda c: F.avg(F.when(c, F.col("n_chars").cast("double")))
    summary = docs.where("source is not null").groupBy("source").agg(mean(F.col("lang") == "en").alias("en"), mean((F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0)).alias("fr"))
    return metrics.report([("Languages", facts)], summary, "source", ["en", "fr"])


@query("SELECT doc_id, source FROM documents WHERE source = (SELECT DISTINCT source FROM documents WHERE contains(lower(source), 'rc17'))")
def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the one source that a part of its name tells."""
    rows = table(spark, d, "documents").where("source is not null").select("doc_id", "source")
    return rows.where(F.col("source") == metrics.resolve_label(rows, "RC17", "source"))
