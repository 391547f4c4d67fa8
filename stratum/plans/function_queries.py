"""More registered queries: column functions, sources, sinks and reports of the operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratum.functions import paths, tokens
from stratum.operators import chunking, corpus, gold, imports, metrics, serving, sync, tasks, vectors
from stratum.plans.registry import AUTHORS, DEGREE, DOC_NAMES, PAIRS, RISK, SPOTS, TOUCHES, doc_names, query, risk_levels, table, touches, with_day

MADE_PATHS = """made AS (SELECT doc_id, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'src/' || source || '.py' WHEN 1 THEN 'web/Node_Modules/' || lang || '/a.js' WHEN 2 THEN '../' || source WHEN 3 THEN 'a/../../' || lang
  WHEN 4 THEN '/etc/' || source ELSE 'pkg' || chr(92) || lang || chr(92) || 'build' END AS path FROM documents)"""


def made_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of six kinds: plain, in an ignored folder, above the root, above it after a while, absolute, with backslashes."""
    n, lit = F.pmod("doc_id", F.lit(6)), F.lit
    path = F.when(n == 0, F.concat(lit("src/"), "source", lit(".py"))).when(n == 1, F.concat(lit("web/Node_Modules/"), "lang", lit("/a.js"))).when(n == 2, F.concat(lit("../"), "source")).when(n == 3, F.concat(lit("a/../../"), "lang"))
    return table(spark, d, "documents").select("doc_id", path.when(n == 4, F.concat(lit("/etc/"), "source")).otherwise(F.concat(lit("pkg\\"), "lang", lit("\\build"))).alias("path"))


@query(f"WITH {MADE_PATHS} SELECT doc_id, doc_id % 6 = 1 AS ignored, doc_id % 6 NOT IN (2, 3, 4) AS inside FROM made")
def path_gates(spark: SparkSession, d: str) -> DataFrame:
    return made_paths(spark, d).select("doc_id", paths.in_ignored_dir(F.col("path")).alias("ignored"), paths.inside(F.col("path")).alias("inside"))


@query(f"WITH {MADE_PATHS} SELECT DISTINCT replace(path, chr(92), '/') AS path FROM made")
def clean_paths(spark: SparkSession, d: str) -> DataFrame:
    return serving.clean_paths(made_paths(spark, d))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'org__' || replace(p_name, ' ', '_') ELSE 'team__' || replace(p_brand, '#', '_') END AS slug FROM part")
def ssh_slug(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("git@host.example:org/"), "p_name", F.lit(".git"))).otherwise(F.concat(F.lit("https://host.example/team/"), "p_brand", F.lit("/")))
    return table(spark, d, "part").select("p_partkey", paths.slug(url).alias("slug"))


@query("SELECT p_partkey, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'a/b/' || p_type WHEN 1 THEN 'a/' || p_type || '/x' WHEN 2 THEN 'a/b' END AS target FROM part")
def relative_import_targets(spark: SparkSession, d: str) -> DataFrame:
    n = F.pmod("p_partkey", F.lit(4))
    name = F.when(n == 0, F.concat(F.lit("."), "p_type")).when(n == 1, F.concat(F.lit(".."), "p_type", F.lit(".x"))).when(n == 2, ".").otherwise(F.concat(F.lit("...."), "p_type"))
    return table(spark, d, "part").select("p_partkey", paths.resolve_relative_import(F.lit("a/b/c.py"), name).alias("target"))


@query("""WITH e AS (SELECT doc_id, unnest([0, 1, 2]) AS pos FROM documents)
SELECT 'a/' || source || '/m' || doc_id || '.py' AS path, CAST(pos AS INT) AS pos, CASE pos WHEN 0 THEN 'os' WHEN 1 THEN '.' || lang || '.x' ELSE 'pkg.' || source || '.one.two' END AS raw_import,
  CASE pos WHEN 0 THEN 'os' WHEN 1 THEN 'a/' || source || '/' || lang || '/x' ELSE 'pkg.' || source || '.one.two' END AS key FROM e JOIN documents USING (doc_id)""")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    code = F.format_string("import os\n\ndef f():\n    from .%s import x, y as z\n    from pkg.%s import one, two, three as four\n", "lang", F.regexp_replace("source", r"\W", "_"))
    docs = table(spark, d, "documents").select(F.concat(F.lit("a/"), "source", F.lit("/m"), "doc_id", F.lit(".py")).alias("path"), code.cast("binary").alias("content"))
    return imports.import_edges(docs)


@query("SELECT 'm' || doc_id || '.py' AS path, CASE WHEN doc_id % 2 = 0 THEN 'a,b.c,' || lang ELSE 'x,./' || lang || '.js' END AS imports FROM documents")
def imports_map(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    code = F.when(even, F.concat(F.lit("import a\nimport b.c\nimport "), "lang", F.lit("\n"))).otherwise(F.concat(F.lit("import y from 'x';\nconst z = require('./"), "lang", F.lit(".js');\n")))
    docs = table(spark, d, "documents").select(F.concat(F.lit("m"), "doc_id", F.when(even, ".py").otherwise(".js")).alias("path"), code.cast("binary").alias("content"))
    rows = imports.imports_map(imports.import_edges(docs)).select("path", F.array_join("imports", ",").alias("imports"))
    return rows.withColumn("path", F.regexp_replace("path", r"\.js$", ".py"))


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(substr(text, 1, 300), '\\s+$', '') || chr(10) || '...[truncated]' END AS text FROM documents")
def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", serving.truncated(F.col("text"), 300).alias("text"))


@query("SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug, CASE WHEN p_partkey >= 10000 THEN format('{:,}', p_partkey) ELSE CAST(p_partkey AS VARCHAR) END AS whole, printf('%.4f', p_retailprice) AS price FROM part")
def report_figures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", metrics.slugify(F.col("p_name")).alias("slug"), metrics.shown(F.col("p_partkey"), integer=True).alias("whole"), metrics.shown(F.col("p_retailprice")).alias("price"))


@query("SELECT p_partkey, p_retailprice * 8 * p_size AS cost, CAST((p_partkey * 7) // 3600 AS VARCHAR) || 'h' || CAST(((p_partkey * 7) % 3600) // 60 AS VARCHAR) || 'm' AS clock FROM part")
def run_costs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", metrics.cost(F.col("p_retailprice"), F.lit(8), F.col("p_size")).alias("cost"), metrics.clock(F.col("p_partkey") * 7).alias("clock"))


@query(f"WITH {DOC_NAMES} SELECT COUNT(*) AS files, CAST(SUM(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(SUM(length(text)) AS BIGINT) AS chars, CAST(SUM(length(text)) // 4 AS BIGINT) AS tokens FROM names JOIN documents USING (doc_id) WHERE path LIKE '%.py' OR path LIKE '%.md'")
def bloat(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bloat(doc_names(spark, d).select("path", F.col("text").alias("content")), [".py", ".md"])


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def stride_rows(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stride(table(spark, d, "documents").select("doc_id"), "doc_id", 1, 4)


@query("SELECT doc_id, 0 AS task FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM documents WHERE lang <> 'en'")
def sequence_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return corpus.sequence([docs.where("lang = 'en'"), docs.where("lang <> 'en'")], "doc_id").select("doc_id", "task")


@query(f"""WITH {DOC_NAMES}, k AS (SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS name, path FROM names)
SELECT 'directory' AS kind, name, n FROM (SELECT name, COUNT(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, MIN(path) LIMIT 3)
UNION ALL SELECT 'suffix', name, n FROM (SELECT CASE WHEN path LIKE '%.JS' THEN '.js' ELSE regexp_extract(path, '([.][^./]+)$', 1) END AS name, COUNT(*) AS n FROM names GROUP BY 1 ORDER BY n DESC, MIN(path) LIMIT 4)""")
def common_names(spark: SparkSession, d: str) -> DataFrame:
    files = doc_names(spark, d).select("path")
    kind = lambda rows, k: rows.select(F.lit(k).alias("kind"), "name", F.col("count").alias("n"))
    return kind(serving.common_directories(files, 3), "directory").unionByName(kind(serving.common_suffixes(files, 4), "suffix"))


@query("SELECT tag, steps, last_step, tag = 'd' || (SELECT MAX(p_size) FROM part) AS largest FROM (SELECT 'd' || p_size AS tag, COUNT(*) AS steps, MAX(p_partkey) AS last_step FROM part GROUP BY 1)")
def best_tag(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_tag(table(spark, d, "part").select(F.concat(F.lit("d"), "p_size").alias("tag"), F.col("p_partkey").alias("step")))


@query("SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) >= 512")
def long_prompts(spark: SparkSession, d: str) -> DataFrame:
    return tasks.long_prompts(table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("tokens")), "tokens").select("doc_id")


@query("SELECT c_custkey, COALESCE(c_mktsegment IN ('BUILDING', 'MACHINERY'), FALSE) AS may, FALSE AS never FROM customer")
def allow_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", tasks.may_enter(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("may"), tasks.may_enter(F.col("c_mktsegment"), []).alias("never"))


@query("""SELECT p_partkey, unnest([0, 1]) AS pos, unnest(['Q: ' || p_name || ' ' || p_brand, 'Q: ' || p_name || ' ' || p_type]) AS choice, unnest([p_brand || ' is', p_type || ' is']) AS schema, unnest(['It is ' || p_name, 'It is ' || p_name || ' ' || p_type]) AS completion,
 'What? ' || p_type || chr(10) || chr(10) || 'Q: ' || p_name AS shot FROM part""")
def task_prompts(spark: SparkSession, d: str) -> DataFrame:
    ask = F.concat(F.lit("Q: "), "p_name")
    both = F.arrays_zip(
        corpus.choice_prompts(ask, F.array("p_brand", "p_type")).alias("choice"), corpus.schema_prompts(F.array("p_brand", "p_type"), F.lit("is")).alias("schema"),
        corpus.completion_prompts(F.concat(F.lit(" It is "), "p_name", F.lit("  ")), F.col("p_type")).alias("completion"),
    )
    shot = corpus.few_shot(ask, F.array(F.struct(F.lit("What?").alias("query"), F.col("p_type").alias("answer"))))
    return table(spark, d, "part").select("p_partkey", F.posexplode(both).alias("pos", "x"), shot.alias("shot")).select("p_partkey", "pos", "x.*", "shot")


@query("""WITH w AS (SELECT p_partkey, [p_size % 2, p_size % 3, p_size % 5] AS a, [0, p_size % 3, 1] AS b FROM part)
SELECT p_partkey, CAST(CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 ELSE 3 END AS INT) AS shared, a = b AS equal, CAST(list_position(a, list_min(a)) - 1 AS INT) AS least FROM w""")
def token_comparisons(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    a, b = F.array(size % 2, size % 3, size % 5), F.array(F.lit(0), size % 3, F.lit(1))
    return table(spark, d, "part").select("p_partkey", corpus.common_prefix(a, b).alias("shared"), corpus.all_equal(a, b).alias("equal"), corpus.first_least(a).alias("least"))


@query("SELECT vec_id, array_to_string(list_transform(list_slice(embedding, -16, -1), lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS INT)), ',') AS kept, CAST(50 - (len(embedding) - 16) AS INT) AS start, CAST(60 - (len(embedding) - 16) AS INT) AS \"end\" FROM embeddings")
def crop_spans(spark: SparkSession, d: str) -> DataFrame:
    cropped = corpus.crop_left(F.col("embedding"), 16, F.lit(50), F.lit(60))
    rows = table(spark, d, "embeddings").select("vec_id", cropped.alias("c"))
    return rows.select("vec_id", F.array_join(F.transform("c.tokens", lambda x: F.round(x.cast("double") * 1000).cast("int").cast("string")), ",").alias("kept"), "c.start", "c.end")


@query("SELECT p_partkey, CAST(k AS INT) AS pos, ['text', 'python', 'python_output', 'text'][k + 1] AS type, ['It is ', p_size || '*2', CAST(p_size * 2 AS VARCHAR), ' in all'][k + 1] AS text FROM part, range(4) r(k)")
def answer_parts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("It is <<"), "p_size", F.lit("*2="), F.col("p_size") * 2, F.lit(">> in all"))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(corpus.parts_of(text)).alias("pos", "x"))
    return rows.select("p_partkey", "pos", "x.type", "x.text")


@query("SELECT p_partkey, CAST(k AS INT) AS pos, ['text', 'python', 'python_output', 'text', 'text'][k + 1] AS type, [p_name, p_size || '+1', CAST(p_size + 1 AS VARCHAR), 'so', '#### ' || (p_size + 1)][k + 1] AS text FROM part, range(5) r(k)")
def chain_parts(spark: SparkSession, d: str) -> DataFrame:
    more = (F.col("p_size") + 1).cast("string")
    chain = F.concat("p_name", F.lit(' <gadget id="calculator">'), "p_size", F.lit("+1</gadget>\n<output>"), more, F.lit("</output> so <result>"), more, F.lit("</result>"))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(corpus.parts_of(chain, more)).alias("pos", "x"))
    return rows.select("p_partkey", "pos", "x.type", "x.text")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'x = ' || p_size ELSE p_name END AS code, regexp_extract(p_type, '(\\S+)', 1) AS answer, CAST(p_size % 2 = 0 AS INT) AS same, least(1.0::DOUBLE, (p_size % 2) * 0.7::DOUBLE + 0.3::DOUBLE) AS reward FROM part")
def completions(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    text = F.when(even, F.concat(F.lit("see\n```python\nx = "), "p_size", F.lit("\n```\ndone"))).otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    answer = corpus.normalize_answer(F.concat(F.lit(" "), "p_type", F.lit(",\nmore")))
    same = corpus.same_answer(F.when(even, F.lit("a")), F.when(even, F.lit("a")).otherwise(F.lit("b")))
    return table(spark, d, "part").select("p_partkey", corpus.code_block(text).alias("code"), answer.alias("answer"), same.alias("same"), corpus.combined_reward(F.col("p_size") % 2, F.lit(0.3)).alias("reward"))


@query("SELECT conv_id, COUNT(*) - CASE WHEN arg_max(role, turn) = 'assistant' THEN 1 ELSE 0 END AS n, CASE WHEN arg_max(role, turn) = 'assistant' THEN arg_max(text, turn) END AS dropped FROM conversations GROUP BY conv_id")
def completion_context(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.conversations(table(spark, d, "conversations"))
    last, kept = F.element_at("messages", -1), corpus.for_completion(F.col("messages"))
    return rows.select("conv_id", F.size(kept).cast("long").alias("n"), F.when(F.size(kept) < F.size("messages"), last["content"]).alias("dropped"))


@query(f"WITH {TOUCHES}, {SPOTS}, a AS (SELECT path, CAST(COUNT(*) AS BIGINT) AS total_commits, COUNT(DISTINCT author) AS distinct_authors FROM t WHERE path IN (SELECT path FROM h) GROUP BY path) SELECT * FROM a")
def hotspot_authorship(spark: SparkSession, d: str) -> DataFrame:
    rows = touches(spark, d)
    return gold.authorship(rows, gold.hotspots(rows, 200)).select("path", "total_commits", "distinct_authors")


@query("SELECT l_orderkey AS sha, CAST(o_custkey AS VARCHAR) AS author, 'part/' || l_partkey AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def commit_touches(spark: SparkSession, d: str) -> DataFrame:
    commits = touches(spark, d).groupBy("sha", "author", "date", "ord").agg(F.collect_list("path").alias("files"))
    return gold.touches_of(commits).select("sha", "author", "path")


@query(f"""WITH {TOUCHES}, {SPOTS}, {PAIRS}, {DEGREE}, {AUTHORS}, {RISK}
SELECT 'part/' || p_partkey AS file_path, risk_level, co_change_degree, distinct_authors, p_name AS imports FROM part LEFT JOIN (SELECT path, risk_level FROM risk) r ON r.path = 'part/' || p_partkey LEFT JOIN g ON g.path = 'part/' || p_partkey LEFT JOIN a ON a.path = 'part/' || p_partkey""")
def enriched_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows, parts = touches(spark, d), table(spark, d, "part").select(F.concat(F.lit("part/"), "p_partkey").alias("file_path"), "p_name")
    degree = gold.coupling_degree(gold.co_changes(rows, 2))
    return serving.enrich_chunks(parts.select("file_path"), risk_levels(spark, d), degree, gold.file_figures(rows), parts.select(F.col("file_path").alias("path"), F.col("p_name").alias("imports")))


@query(f"""WITH {TOUCHES}, {SPOTS}, {PAIRS}, {DEGREE}, {AUTHORS}, {RISK} SELECT path, touch_count, last_touched, risk_level, risk_score, split_part(path, '/', 2) AS name FROM h JOIN (SELECT path, risk_level, risk_score FROM risk) USING (path)""")
def hotspot_cards(spark: SparkSession, d: str) -> DataFrame:
    return serving.hotspots_with_risk(with_day(gold.hotspots(touches(spark, d), 200)), risk_levels(spark, d))


@query(f"WITH {TOUCHES}, {SPOTS} SELECT '- ' || path || ': ' || touch_count || ' changes, last on ' || last_touched AS line FROM h")
def hotspot_lines(spark: SparkSession, d: str) -> DataFrame:
    return serving.bullet_lines(with_day(gold.hotspots(touches(spark, d), 200)), "%s: %s changes, last on %s", "path", "touch_count", "last_touched")


@query("SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN '{\"n\":' || n_nationkey || '}' ELSE '{}' END AS value FROM nation")
def put_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation")
    old = rows.select(F.col("n_name").alias("key"), F.lit("{}").alias("value"))
    return tasks.put_values(old, rows.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("key"), F.to_json(F.struct(F.col("n_nationkey").alias("n"))).alias("value")))


@query("SELECT n_regionkey AS repo_id, CAST(version AS INT) AS version, document FROM (SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS version, n_name AS document FROM nation) UNION ALL SELECT '2', CAST(COUNT(*) + 1 AS INT), 'new' FROM nation WHERE n_regionkey = 2")
def saved_documents(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    version = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    old = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("repo_id"), version.alias("version"), F.col("n_name").alias("document"))
    return tasks.save_document(old, "2", "new")


@query("""WITH a AS (SELECT s_suppkey AS x, s_acctbal AS y, s_nationkey FROM supplier), s AS (SELECT s_nationkey, x, y, lead(x) OVER w AS xn, lead(y) OVER w AS yn, row_number() OVER w AS k FROM a WINDOW w AS (PARTITION BY s_nationkey ORDER BY x))
SELECT s_nationkey, round(CASE WHEN 50.5 <= x OR xn IS NULL THEN y ELSE y + (50.5 - x) / (xn - x) * (yn - y) END, 6) AS value FROM s WHERE (50.5 < xn OR xn IS NULL) AND (50.5 >= x OR k = 1)""")
def interpolated(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier")
    at = rows.select("s_nationkey").distinct().withColumn("x0", F.lit(50.5))
    return metrics.interpolate(rows, "s_nationkey", "s_suppkey", "s_acctbal", at).select("s_nationkey", F.round("value", 6).alias("value"))


@query("""WITH u AS (SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'measured' ELSE 'estimated' END AS kind, s_suppkey AS params, s_acctbal AS score FROM supplier)
SELECT name, kind, params, score, round(score - lag(score) OVER w, 6) AS delta, round((score - lag(score) OVER w) / lag(score) OVER w * 100, 6) AS percent FROM u WINDOW w AS (ORDER BY params, name)""")
def size_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("params"), F.col("s_acctbal").alias("score"))
    out = metrics.size_table(rows.where("params % 2 = 0"), rows.where("params % 2 = 1"))
    return out.select("name", "kind", "params", "score", F.round("delta", 6).alias("delta"), F.round("percent", 6).alias("percent"))


@query("""WITH a AS (SELECT lang AS name, AVG(quality::DOUBLE) AS accuracy, (AVG(quality::DOUBLE) - 0.25::DOUBLE) / 0.75::DOUBLE AS centered FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT printf('%-35s, %-10s, %-10s', name, printf('%.6f', accuracy), printf('%.6f', centered)) AS line FROM a UNION ALL SELECT printf('%-35s, %-10s, %-10s', 'CORE', '', printf('%.6f', AVG(centered))) FROM a""")
def result_file_lines(spark: SparkSession, d: str) -> DataFrame:
    from stratum.plans.registry import centered_accuracy

    return metrics.result_lines(centered_accuracy(spark, d), "lang").select("line")


@query("SELECT (SELECT replace(CAST(o_orderkey AS VARCHAR), ',', '') FROM orders ORDER BY o_orderkey DESC LIMIT 1) AS step, (SELECT printf('%.2f', arg_max(o_totalprice, o_orderkey)) FROM orders) AS loss, (SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_orderstatus = 'F') AS stage")
def last_log_values(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("step: "), F.format_number("o_orderkey", 0), F.lit(" | loss: "), F.format_string("%.2f", "o_totalprice"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" | stage: "), "o_orderpriority")).otherwise(""))
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), line.alias("value"))
    return metrics.last_values(log, {"step": r"step: ([\d,]+)", "loss": r"loss: ([\d.]+)", "stage": r"stage: (.+)$"})


@query("SELECT arg_max(o_orderpriority, o_orderkey) AS value FROM orders WHERE o_orderstatus = 'F'")
def report_line(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.concat(F.when(F.col("o_orderstatus") == "F", "- priority: ").otherwise("- other: "), "o_orderpriority").alias("value"))
    return metrics.report_value(log, "priority")


@query("SELECT to_json({'documents': COUNT(*), 'longest': MAX(n_chars)})::VARCHAR AS value FROM documents")
def summary_json(spark: SparkSession, d: str) -> DataFrame:
    return tasks.summary_record(table(spark, d, "documents"), documents=F.count("*"), longest=F.max("n_chars"))


@query(f"WITH {DOC_NAMES} SELECT DISTINCT path FROM names JOIN documents USING (doc_id) WHERE path NOT LIKE '%.png' AND n_chars <= 5000 AND doc_id % 5 <> 0")
def eligible_files(spark: SparkSession, d: str) -> DataFrame:
    rows = doc_names(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    manifest = rows.select("path", paths.content_hash(F.col("path"), F.col("text")).alias("content_hash"), F.col("n_chars").alias("size_bytes"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 5 != 0).alias("present"))
    return chunking.eligible_files(manifest, max_bytes=5000).select("path").distinct()


@query("SELECT doc_id, sha256(source || ':docs/' || doc_id || ':0:' || octet_length(encode(text)) || ':' || sha256(text)) AS chunk_id FROM documents")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("docs/"), F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", paths.chunk_id(F.col("source"), path, F.lit(0), F.octet_length("text"), F.col("text")).alias("chunk_id"))


SENT = """sent AS (SELECT o_orderkey, c_mktsegment AS tenant, sha256('pepper::' || lower(c_name)) AS mark, CAST(o_orderdate AS VARCHAR) AS head, sha256(c_mktsegment || ':' || sha256('pepper::' || lower(c_name)) || ':' || CAST(o_orderdate AS VARCHAR)) AS version_key, printf('%010d', o_orderkey) AS sent_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _state(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Payloads of all orders, those before 1996 applied first and the others to what they left."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spots = F.array(F.struct(F.lit("a.py").alias("path"), F.col("o_orderkey").alias("touch_count"), F.lit(None).cast("string").alias("last_touched")))
    repos = rows.select("o_orderdate", "c_mktsegment", F.col("c_name").alias("repo_url"), F.lit("").alias("repo_slug"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("head_commit"), spots.alias("hotspots"), F.array(F.lit("a.py"), F.lit("b.py")).alias("files"), F.format_string("%010d", "o_orderkey").alias("synced_at"))
    state: dict[str, DataFrame] = {}
    for part in ("year(o_orderdate) < 1996", "year(o_orderdate) >= 1996"):
        # the tenant is a column here, the operator's is one a call
        sent = sync.payloads(repos.where(part), F.col("c_mktsegment"), "user", "pepper")
        state = sync.apply_payloads(state, sent)
    return state


@query(f"""WITH {SENT}, k AS (SELECT *, (head >= '1996') AS late FROM sent)
SELECT version_key, arg_min(sent_at, (late, sent_at)) AS first_seen_at, arg_max(sent_at, (late, sent_at)) AS last_seen_at, arg_max(mark, (late, sent_at)) AS repo_fingerprint FROM k GROUP BY 1""")
def sync_versions(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)["versions"].select("version_key", "first_seen_at", "last_seen_at", "repo_fingerprint")


@query(f"""WITH {SENT} SELECT 'tenants' AS name, COUNT(DISTINCT tenant) AS n FROM sent UNION ALL SELECT 'repos', COUNT(DISTINCT (tenant, mark)) FROM sent UNION ALL SELECT 'versions', COUNT(DISTINCT version_key) FROM sent
UNION ALL SELECT 'version_hotspots', COUNT(DISTINCT version_key) FROM sent UNION ALL SELECT 'version_files', 2 * COUNT(DISTINCT version_key) FROM sent UNION ALL SELECT 'sync_runs', COUNT(*) FROM sent""")
def sync_table_sizes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, rows in _state(spark, d).items():
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {SENT} SELECT version_key, sha256('pepper::a.py') AS file_hash, arg_max(o_orderkey, (head >= '1996', sent_at)) AS touch_count FROM sent GROUP BY 1")
def sync_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)["version_hotspots"].select("version_key", "file_hash", "touch_count")


@query("""WITH k AS (SELECT p_partkey, unnest(['choice', 'choice', 'schema', 'schema', 'completion']) AS kind, unnest([0, 1, 0, 1, 0]) AS pos, p_size FROM part)
SELECT p_partkey, kind, CAST(pos AS INT) AS pos, CAST(CASE kind WHEN 'choice' THEN 2 WHEN 'schema' THEN 4 + pos - CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END ELSE 1 END AS INT) AS start, CAST(CASE kind WHEN 'choice' THEN 3 + pos WHEN 'schema' THEN 4 + pos ELSE 3 END AS INT) AS "end" FROM k""")
def answer_spans(spark: SparkSession, d: str) -> DataFrame:
    odd, lit = F.col("p_size") % 2, F.lit
    given = {
        "choice": F.array(F.array(lit(1), odd, lit(7)), F.array(lit(1), odd, lit(8), lit(9))),
        "schema": F.array(F.array(lit(1), odd, lit(9), lit(9)), F.array(lit(2), lit(5), lit(0), lit(9), lit(9))),
        "completion": F.array(F.array(F.col("p_size")), F.array(F.col("p_size"), lit(3), lit(4))),
    }
    out = None
    for kind, sequences in given.items():
        rows = table(spark, d, "part").select("p_partkey", F.lit(kind).alias("kind"), F.posexplode(corpus.answer_spans(sequences, kind)).alias("pos", "s")).select("p_partkey", "kind", "pos", "s.start", "s.end")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT p_partkey, array_to_string(list_concat(range(1, p_size + 1), list_transform(range(60 - p_size), lambda i: 0)), ',') AS ids, array_to_string(list_concat(list_transform(range(1, p_size + 1), lambda i: CASE WHEN i % 2 = 0 THEN i ELSE -1 END), list_transform(range(60 - p_size), lambda i: -1)), ',') AS targets FROM part""")
def padded_rows(spark: SparkSession, d: str) -> DataFrame:
    ids = F.sequence(F.lit(1), F.col("p_size"))
    rows = table(spark, d, "part").select("p_partkey", corpus.padded(ids, F.transform(ids, lambda i: (i + 1) % 2), 60, 0).alias("r"))
    return rows.select("p_partkey", F.array_join("r.ids", ",").alias("ids"), F.array_join("r.targets", ",").alias("targets"))


@query("SELECT vec_id, CASE WHEN embedding[4] >= embedding[8] AND embedding[4] >= embedding[12] THEN 3 WHEN embedding[8] >= embedding[12] THEN 7 ELSE 11 END AS choice FROM embeddings")
def letter_choice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", corpus.best_option(F.col("embedding"), F.array(F.lit(3), F.lit(7), F.lit(11))).alias("choice"))


@query("SELECT p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: i - len(replace(substr(p_name, 1, i), 'e', ''))), ',') AS trace FROM part")
def letter_trace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(corpus.letter_trace(F.col("p_name"), F.lit("e")), ",").alias("trace"))


@query("SELECT doc_id, CAST(epoch AS INT) AS epoch FROM documents, range(3) r(epoch) WHERE epoch > 0 OR doc_id > 500")
def epoch_rows(spark: SparkSession, d: str) -> DataFrame:
    return corpus.epochs(table(spark, d, "documents").select("doc_id"), "doc_id", 3, (0, 500))


@query(f"""WITH {TOUCHES}, {SPOTS}, {PAIRS}, {DEGREE}, {AUTHORS}, {RISK}, {DOC_NAMES}, top AS (SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS dir, COUNT(*) AS n FROM names GROUP BY 1)
SELECT 'hotspots' AS kind, '- ' || path || ': ' || touch_count || ' touches; last touched ' || last_touched AS line FROM (SELECT * FROM h ORDER BY touch_count DESC, path LIMIT 10)
UNION ALL SELECT 'risk', '- ' || path || ': risk=' || risk_level || ' score=' || risk_score FROM (SELECT * FROM risk ORDER BY risk_score DESC, path LIMIT 10)
UNION ALL SELECT 'co_changes', '- ' || file_a || ' <-> ' || file_b || ': ' || co_change_count || ' co-changes' FROM (SELECT * FROM p ORDER BY co_change_count DESC, file_a, file_b LIMIT 10)
UNION ALL SELECT 'top_level', '- ' || dir || ': ' || n || ' files' FROM (SELECT * FROM top ORDER BY n DESC, dir LIMIT 12)""")
def snapshot_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = touches(spark, d)
    parts = {
        "hotspots": serving.snapshot_lines("hotspots", with_day(gold.hotspots(rows, 200)), F.desc("touch_count"), "path"),
        "risk": serving.snapshot_lines("risk", risk_levels(spark, d), F.desc("risk_score"), "path"),
        "co_changes": serving.snapshot_lines("co_changes", gold.co_changes(rows, 2), F.desc("co_change_count"), "file_a", "file_b"),
        "top_level": serving.snapshot_lines("top_level", gold.directory_counts(doc_names(spark, d))),
    }
    out = None
    for kind, lines in parts.items():
        one = lines.select(F.lit(kind).alias("kind"), "line")
        out = one if out is None else out.unionByName(one)
    return out


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, 50256 AS first_id, 50257 AS last_id FROM documents")
def tokenizer_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text to ids, between the first two special tokens, and back."""
    path = ranks_file()
    ids = tokens.encode(F.col("text"), path, "<|bos|>", "<|user_start|>")
    rows = table(spark, d, "documents").select("doc_id", ids.alias("ids")).select("doc_id", F.col("ids")[0].alias("first_id"), F.element_at("ids", -1).alias("last_id"), tokens.decode(F.slice("ids", 2, F.size("ids") - 2), path).alias("text"))
    return rows.select("doc_id", F.sha2("text", 256).alias("sha256"), "first_id", "last_id")


@query("""WITH l AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
r AS (SELECT vec_id, x::DOUBLE AS x, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS k, max(x::DOUBLE) OVER (PARTITION BY vec_id) AS m FROM l),
c AS (SELECT vec_id, i, k, SUM(exp((x - m) / 0.5)) OVER (PARTITION BY vec_id ORDER BY k) AS run, SUM(exp((x - m) / 0.5)) OVER (PARTITION BY vec_id) AS total FROM r WHERE k <= 5)
SELECT vec_id, CAST(first(i ORDER BY k) FILTER (run > (vec_id % 97) / 97.0 * total) AS INT) AS drawn, (SELECT CAST(i AS INT) FROM r WHERE r.vec_id = c.vec_id AND k = 1) AS greedy FROM c GROUP BY vec_id""")
def next_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A token of each vector's components as logits, of the five largest by a given draw, and the largest."""
    logits, draw = F.col("embedding").cast("array<double>"), (F.col("vec_id") % 97) / F.lit(97.0)
    return table(spark, d, "embeddings").select("vec_id", tokens.next_token(logits, draw, 0.5, 5).alias("drawn"), tokens.next_token(logits, draw, 0.0).alias("greedy"))


@query("""SELECT p_partkey, 'a{' || p_size || '*2}[' || p_size * 2 || ']b' AS text, repeat('1', 5 + length(p_size::VARCHAR)) || repeat('0', 2 + length((p_size * 2)::VARCHAR)) || '1' AS mask FROM part""")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Sampled streams with a call, whose answer takes the place of what was sampled behind it."""
    marks = {"<|python_start|>": "{", "<|python_end|>": "}", "<|output_start|>": "[", "<|output_end|>": "]", "<|assistant_end|>": "$", "<|bos|>": "^"}
    special = {k: ord(v) for k, v in marks.items()}
    size = F.col("p_size").cast("string")
    drawn = F.concat(F.lit("a{"), size, F.lit("*2}"), F.repeat(F.lit("z"), F.length((F.col("p_size") * 2).cast("string")) + 2), F.lit("b$never"))
    codes = F.transform(F.split(drawn, ""), F.ascii)
    done = tokens.answer_calls(codes, special, lambda ids: "".join(map(chr, ids)), lambda text: [ord(c) for c in text])
    rows = table(spark, d, "part").select("p_partkey", done.alias("x"))
    return rows.select("p_partkey", F.array_join(F.transform("x.ids", lambda i: F.char(i)), "").alias("text"), F.array_join(F.transform("x.mask", lambda b: b.cast("string")), "").alias("mask"))


@query("""WITH o AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part)
SELECT CAST((k - 3) // 2 AS INT) AS "index", CAST((k - 3) // 2 % 50 AS VARCHAR) AS completion, (k - 3) // 2 % 50 = p_size AS correct, CASE WHEN (k - 3) // 2 % 50 = p_size THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM o WHERE k >= 3 AND (k - 3) % 2 = 0 AND (k - 3) // 2 IN (SELECT p_partkey FROM part)""")
def task_evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Every second part from the fourth as a question for its size, answered by place."""
    rows = tasks.question_conversations(table(spark, d, "part").select(F.col("p_partkey").alias("index"), F.col("p_size").cast("string").alias("size"), "p_name"), "p_name", "size")
    task = tasks.Task(rows, "generative", lambda said: said == F.col("size"), start=3, step=2)
    said = table(spark, d, "part").select(F.col("p_partkey").alias("index"), (F.col("p_partkey") % 50).cast("string").alias("completion"))
    return task.evaluated(said)


@query("""WITH c AS (SELECT part.p_partkey AS place, (part.p_partkey * 7) % 1500 AS id FROM part)
SELECT place, 'docs/' || doc_id || '.md' AS path, substr(text, 1, 500) AS content, length(text) > 500 AS truncated FROM c JOIN documents ON doc_id = id WHERE text IS NOT NULL""")
def selected_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents that candidates name, some of which aren't there, cut to 500 characters."""
    name = lambda c: F.concat(F.lit("docs/"), c.cast("string"), F.lit(".md"))
    files = table(spark, d, "documents").where("text is not null").select(name(F.col("doc_id")).alias("path"), F.col("text").alias("content"))
    candidates = table(spark, d, "part").select(F.col("p_partkey").alias("place"), name((F.col("p_partkey") * 7) % 1500).alias("path"))
    return serving.selected_files(files, candidates, 500)
