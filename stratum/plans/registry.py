"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

The tables hold no commits; orders stand for commits, their parts or suppliers for files, customers
for authors and order dates for commit dates, newest first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratum.functions import paths
from stratum.operators import chunking, corpus, gold, imports, metrics, serving, sync, tasks, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def touches(spark: SparkSession, d: str, prefix: str = "part/", key: str = "l_partkey") -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", key)
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_orderkey").alias("sha"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("path"), F.col("o_custkey").cast("string").alias("author"),
        # dates as dates and the place in the log as one number, newest day first: both fit a hash aggregate
        F.to_date("o_orderdate").alias("date"), (F.shiftleft(-F.unix_date(F.to_date("o_orderdate")).cast("long"), 40) + F.col("o_orderkey")).alias("ord"),
    )


def with_day(spots: DataFrame) -> DataFrame:
    return spots.withColumn("last_touched", F.col("last_touched").cast("string"))


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, path): the path of each page's URL, query and fragment left out."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", path.alias("path"))


TOUCHES = """t AS (SELECT o_orderkey AS sha, 'part/' || l_partkey AS path, CAST(o_custkey AS VARCHAR) AS author, strftime(o_orderdate, '%Y-%m-%d') AS date,
  dense_rank() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SPOTS = "h AS (SELECT path, COUNT(*) AS touch_count, arg_min(date, ord) AS last_touched FROM t GROUP BY path ORDER BY touch_count DESC, path LIMIT 200)"
PAIRS = """f AS (SELECT DISTINCT sha, path FROM t), n AS (SELECT sha FROM f GROUP BY sha HAVING COUNT(*) <= 50),
p AS (SELECT a.path AS file_a, b.path AS file_b, COUNT(*) AS co_change_count FROM f a JOIN f b ON a.sha = b.sha AND a.path < b.path JOIN n ON n.sha = a.sha GROUP BY ALL HAVING COUNT(*) >= 2)"""
DEGREE = "g AS (SELECT path, COUNT(*) AS co_change_degree FROM (SELECT file_a AS path FROM p UNION ALL SELECT file_b FROM p) GROUP BY path)"
AUTHORS = "a AS (SELECT path, COUNT(DISTINCT author) AS distinct_authors, COUNT(*) AS total_commits FROM t GROUP BY path)"
RISK = """r AS (SELECT h.path, touch_count, COALESCE(distinct_authors, 1) AS distinct_authors, COALESCE(co_change_degree, 0) AS co_change_degree FROM h LEFT JOIN a USING (path) LEFT JOIN g USING (path)),
m AS (SELECT MIN(touch_count) c0, MAX(touch_count) c1, MIN(distinct_authors) a0, MAX(distinct_authors) a1, MIN(co_change_degree) k0, MAX(co_change_degree) k1 FROM r),
s AS (SELECT r.*, 0.5::DOUBLE * CASE WHEN c0 = c1 THEN 0.5::DOUBLE ELSE (touch_count - c0) / (c1 - c0)::DOUBLE END + 0.3::DOUBLE * CASE WHEN a0 = a1 THEN 0.5::DOUBLE ELSE (distinct_authors - a0) / (a1 - a0)::DOUBLE END
  + 0.2::DOUBLE * CASE WHEN k0 = k1 THEN 0.5::DOUBLE ELSE (co_change_degree - k0) / (k1 - k0)::DOUBLE END AS score FROM r, m),
risk AS (SELECT path, CASE WHEN score > 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level, round(score, 4) AS risk_score, touch_count, distinct_authors, co_change_degree FROM s)"""
PATHS = "pp AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages)"
EXT = "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.][^/]*?([.][^./]+)$', 1))"


@query(f"WITH {TOUCHES} SELECT path, COUNT(*) AS touch_count, arg_min(date, ord) AS last_touched FROM t GROUP BY path ORDER BY touch_count DESC, path LIMIT 20")
def hotspots_topn(spark: SparkSession, d: str) -> DataFrame:
    return with_day(gold.hotspots(touches(spark, d)))


@query(f"WITH {TOUCHES}, {PAIRS} SELECT * FROM p")
def co_change_pairs(spark: SparkSession, d: str) -> DataFrame:
    return gold.co_changes(touches(spark, d), min_support=2)


@query(f"WITH {TOUCHES}, {PAIRS}, {DEGREE} SELECT * FROM g")
def coupling_degree(spark: SparkSession, d: str) -> DataFrame:
    return gold.coupling_degree(co_change_pairs(spark, d))


@query(f"""WITH {TOUCHES}, c AS (SELECT path, author, COUNT(*) AS commit_count, MIN(ord) AS first FROM t GROUP BY ALL)
SELECT path, CAST(rank AS INT) AS rank, author, commit_count FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY commit_count DESC, first, author) AS rank FROM c) WHERE rank <= 3""")
def authorship_top3(spark: SparkSession, d: str) -> DataFrame:
    return gold.top_authors(touches(spark, d))


@query(f"""WITH {TOUCHES}, c AS (SELECT path, author, COUNT(*) AS n, MIN(ord) AS first FROM t GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first, author) AS rank FROM c)
SELECT path, CAST(SUM(n) AS BIGINT) AS total_commits, COUNT(*) AS distinct_authors, string_agg(author || ':' || n, ',' ORDER BY rank) FILTER (rank <= 3) AS contributors FROM k GROUP BY path""")
def authorship_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = gold.authorship(touches(spark, d))
    return rows.select("path", "total_commits", "distinct_authors", F.array_join(F.transform("primary_contributors", lambda x: F.concat_ws(":", x["name"], x["commit_count"].cast("string"))), ",").alias("contributors"))


@query(f"WITH {TOUCHES}, {SPOTS}, {PAIRS}, {DEGREE}, {AUTHORS}, {RISK} SELECT * FROM risk")
def risk_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = touches(spark, d)
    spots = gold.file_figures(rows).orderBy(F.desc("touch_count"), "path").limit(200)
    return gold.risk_levels(spots, gold.co_changes(rows, 2))


@query(f"""WITH {TOUCHES}, {SPOTS}, {PAIRS}, {DEGREE}, {AUTHORS}, {RISK}, x AS (SELECT h.*, COALESCE(risk_level, 'low') AS risk_level FROM h LEFT JOIN (SELECT path, risk_level FROM risk) USING (path))
SELECT split_part(path, '/', 1) AS directory, string_agg(path, ',' ORDER BY touch_count DESC, path) AS files, CASE MIN(CASE risk_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level FROM x GROUP BY 1""")
def ui_dir_rollup(spark: SparkSession, d: str) -> DataFrame:
    return serving.directory_risk(gold.hotspots(touches(spark, d), 200), risk_levels(spark, d)).withColumn("files", F.array_join("files", ","))


@query(f"WITH {TOUCHES}, {PAIRS}, q AS (SELECT MIN(file_a) AS path FROM p) SELECT CASE WHEN file_a = q.path THEN file_b ELSE file_a END AS path, co_change_count FROM p, q WHERE q.path IN (file_a, file_b)")
def ui_related(spark: SparkSession, d: str) -> DataFrame:
    pairs = co_change_pairs(spark, d)
    first = pairs.agg(F.min("file_a")).first()[0]
    return serving.related_files(pairs, first or "")


@query(f"""WITH {TOUCHES}, c AS (SELECT path, author, COUNT(*) AS n, MIN(ord) AS first FROM t GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first, author) AS rank FROM c)
SELECT author AS name, CAST(SUM(n) AS BIGINT) AS commits FROM k WHERE rank <= 3 GROUP BY author ORDER BY commits DESC, name LIMIT 8""")
def top_contributors(spark: SparkSession, d: str) -> DataFrame:
    return serving.top_contributors(gold.authorship(touches(spark, d)))


@query(f"WITH {PATHS} SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS dir, COUNT(*) AS file_count FROM pp GROUP BY 1")
def structure_dirs(spark: SparkSession, d: str) -> DataFrame:
    return gold.directory_counts(page_paths(spark, d))


@query(f"WITH names AS (SELECT path || '.' || lang AS path FROM (SELECT 'docs/' || doc_id AS path, lang FROM documents)) SELECT CASE WHEN {EXT} = '' THEN '[no_ext]' ELSE {EXT} END AS extension, COUNT(*) AS file_count FROM names GROUP BY 1")
def structure_ext(spark: SparkSession, d: str) -> DataFrame:
    return gold.suffix_counts(table(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id"), F.lit("."), F.col("lang")).alias("path")))


DOC_NAMES = """names AS (SELECT doc_id, CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'README.' || lang WHEN 1 THEN 'docs/' || doc_id || '.md' WHEN 2 THEN 'src/main.' || lang WHEN 3 THEN 'tests/t' || doc_id || '.py' WHEN 4 THEN 'logo.png'
  WHEN 5 THEN '.github/workflows/' || source || '.yml' WHEN 6 THEN source || '/' || lang || '/poetry.lock' WHEN 7 THEN source || '/.eslintrc.json' ELSE 'lib/' || source || '.JS' END AS path FROM documents)"""


def doc_names(spark: SparkSession, d: str) -> DataFrame:
    """Documents under made-up repository paths."""
    n = F.pmod("doc_id", F.lit(9))
    lit, ident = F.lit, F.col("doc_id").cast("string")
    path = (
        F.when(n == 0, F.concat(lit("README."), "lang")).when(n == 1, F.concat(lit("docs/"), ident, lit(".md"))).when(n == 2, F.concat(lit("src/main."), "lang")).when(n == 3, F.concat(lit("tests/t"), ident, lit(".py"))).when(n == 4, lit("logo.png"))
        .when(n == 5, F.concat(lit(".github/workflows/"), "source", lit(".yml"))).when(n == 6, F.concat("source", lit("/"), "lang", lit("/poetry.lock"))).when(n == 7, F.concat("source", lit("/.eslintrc.json"))).otherwise(F.concat(lit("lib/"), "source", lit(".JS")))
    )
    return table(spark, d, "documents").select("doc_id", path.alias("path"), "text", "lang", "source")


def _points(patterns: tuple[tuple[str, str, int], ...]) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(path, '{p}') THEN {n} ELSE 0 END" for p, _, n in patterns)


def _reasons(patterns: tuple[tuple[str, str, int], ...]) -> str:
    some = ", ".join(f"CASE WHEN regexp_matches(path, '{p}') THEN '{r}' END" for p, r, _ in patterns)
    return f"array_to_string(list_sort(list_distinct([{some}])), ',')"


@query(f"WITH {DOC_NAMES}, u AS (SELECT DISTINCT path FROM names WHERE path NOT LIKE '%.png') SELECT path, {_points(gold.START_HERE)} AS score, {_reasons(gold.START_HERE)} AS reasons FROM u WHERE score > 0 ORDER BY score DESC, path LIMIT 15")
def start_here(spark: SparkSession, d: str) -> DataFrame:
    return gold.start_here(doc_names(spark, d).select("path").distinct()).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {DOC_NAMES}, u AS (SELECT DISTINCT path FROM names) SELECT path, {_points(gold.START_HERE_PROMPT)} AS score, {_reasons(gold.START_HERE_PROMPT)} AS reasons FROM u WHERE score > 0 ORDER BY score DESC, path LIMIT 12")
def start_here_prompt(spark: SparkSession, d: str) -> DataFrame:
    return gold.start_here(doc_names(spark, d).select("path").distinct(), top=12, patterns=gold.START_HERE_PROMPT, skip_binary=False).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {DOC_NAMES}, u AS (SELECT lower(path) AS low, arg_max(path, doc_id) AS path, MIN(doc_id) AS place FROM names GROUP BY 1)
SELECT CASE WHEN low LIKE '%poetry.lock' THEN 'package_manager' ELSE 'linter' END AS convention, CASE WHEN low LIKE '%poetry.lock' THEN 'poetry' ELSE 'eslint' END AS value, arg_min(path, place) AS config_path
FROM u WHERE low LIKE '%/poetry.lock' OR low LIKE '%/.eslintrc.json' GROUP BY ALL""")
def conventions_first_match(spark: SparkSession, d: str) -> DataFrame:
    return gold.named_conventions(doc_names(spark, d), order="doc_id").drop("prio")


@query(f"WITH {DOC_NAMES} SELECT 'github_actions' AS platform, arg_min(path, doc_id) AS config_path FROM names WHERE path LIKE '.github/workflows/%' HAVING COUNT(*) > 0")
def conventions_ci(spark: SparkSession, d: str) -> DataFrame:
    return gold.ci_pipelines(doc_names(spark, d), order="doc_id")


@query(f"WITH {DOC_NAMES} SELECT DISTINCT split_part(path, '/', 1) AS test_dir FROM names WHERE lower(split_part(path, '/', 1)) IN ('tests', 'test', '__tests__', 'spec')")
def conventions_test_dirs(spark: SparkSession, d: str) -> DataFrame:
    return gold.test_dirs(doc_names(spark, d))


@query(f"""WITH {DOC_NAMES} SELECT 3 AS place, '- Python dependencies: requirements file is present' AS message FROM names WHERE lower(path) LIKE '%requirements.txt' GROUP BY 1 HAVING COUNT(*) > 0
UNION ALL SELECT 4, '- CI/CD: GitHub Actions workflow files are present' FROM names WHERE path LIKE '.github/workflows/%' HAVING COUNT(*) > 0""")
def conventions_prompt(spark: SparkSession, d: str) -> DataFrame:
    return serving.prompt_conventions(doc_names(spark, d))


SLUG = """regexp_replace(replace(CASE WHEN contains(rest, '/') THEN regexp_replace(rest, '^[^/]*/', '') ELSE rest END, '/', '__'), '[^a-zA-Z0-9._-]', '_', 'g')"""


@query(f"WITH u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '/+$', ''), '[.]git$', ''), '^.*?://', '') AS rest FROM pages) SELECT page_id, CASE WHEN {SLUG} = '' THEN 'repo' ELSE {SLUG} END AS slug FROM u")
def url_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", paths.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, sha256('pepper::' || regexp_replace(lower(trim(url)), '/+$', '')) AS ref_hash, sha256(lower(regexp_replace(trim(url), '/+$', ''))) AS repo_id FROM pages")
def repo_ref_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", sync.fingerprint(F.col("url"), "pepper").alias("ref_hash"), paths.repo_id(F.col("url")).alias("repo_id"))


@query("SELECT c_custkey, sha256(c_mktsegment || ':' || c_name || ':' || c_nationkey) AS version_key FROM customer")
def version_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", paths.version_key(F.col("c_mktsegment"), F.col("c_name"), F.col("c_nationkey").cast("string")).alias("version_key"))


@query(f"WITH {DOC_NAMES} SELECT doc_id, CASE WHEN path LIKE '%.png' OR octet_length(encode(text)) > 1048576 THEN '' ELSE sha256(text) END AS content_hash FROM names JOIN documents USING (doc_id)")
def file_hash_gate(spark: SparkSession, d: str) -> DataFrame:
    return doc_names(spark, d).select("doc_id", paths.content_hash(F.col("path"), F.col("text")).alias("content_hash"))


@query(f"""WITH {DOC_NAMES} SELECT doc_id, CASE WHEN path LIKE '%.py' THEN 'python' WHEN lower(path) LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.yml' THEN 'yaml' WHEN path LIKE '%.json' THEN 'json'
  WHEN text LIKE '#!%' THEN CASE WHEN contains(lower(split_part(text, chr(10), 1)), 'python') THEN 'python' WHEN contains(lower(split_part(text, chr(10), 1)), 'node') THEN 'javascript' WHEN contains(lower(split_part(text, chr(10), 1)), 'sh') THEN 'shell' END END AS language
FROM names JOIN documents USING (doc_id)""")
def file_language(spark: SparkSession, d: str) -> DataFrame:
    return doc_names(spark, d).select("doc_id", paths.language(F.col("path"), F.col("text")).alias("language"))


@query("""WITH e AS (SELECT page_id AS page, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages) SELECT page, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS href FROM e""")
def link_graph(spark: SparkSession, d: str) -> DataFrame:
    return imports.link_edges(table(spark, d, "pages"))


@query("""WITH e AS (SELECT page_id AS page, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT href AS key, COUNT(*) AS n, string_agg(CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS files FROM e GROUP BY href""")
def linked_by(spark: SparkSession, d: str) -> DataFrame:
    edges = imports.link_edges(table(spark, d, "pages")).select(F.col("page").cast("string").alias("path"), F.col("href").alias("key"))
    return imports.imported_by(edges).select("key", F.size("files").cast("long").alias("n"), F.array_join("files", ",").alias("files"))


@query(f"WITH {TOUCHES}, {SPOTS} SELECT sha256('pepper::' || path) AS file_hash, touch_count, last_touched FROM h")
def redacted_payload(spark: SparkSession, d: str) -> DataFrame:
    return sync.redact_hotspots(with_day(gold.hotspots(touches(spark, d), 200)), "pepper")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and from the middle of their dates, as two states keyed by customer."""
    rows = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    state = lambda r: r.groupBy("o_custkey").agg(F.min("day").cast("string").alias("first_seen"), F.max("day").cast("string").alias("last_seen"), F.count("*").alias("orders"))
    return state(rows.where("day < '1996-01-01'")), state(rows.where("day >= '1996-01-01'"))


@query("""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders), a AS (SELECT o_custkey, MIN(day) AS first_seen, MAX(day) AS last_seen, COUNT(*) AS orders FROM o WHERE day < '1996-01-01' GROUP BY 1),
b AS (SELECT o_custkey, MIN(day) AS first_seen, MAX(day) AS last_seen, COUNT(*) AS orders FROM o WHERE day >= '1996-01-01' GROUP BY 1)
SELECT COALESCE(a.o_custkey, b.o_custkey) AS o_custkey, CAST(COALESCE(a.first_seen, b.first_seen) AS VARCHAR) AS first_seen, CAST(COALESCE(b.last_seen, a.last_seen) AS VARCHAR) AS last_seen, COALESCE(b.orders, a.orders) AS orders FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def merge_first_last_seen(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return sync.merge(old, new, ["o_custkey"], ["first_seen"], ["last_seen"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (CAST(o_orderdate AS DATE) >= '1996-01-01') DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    old, new = (rows.where(c).select("o_custkey", "o_orderkey", "o_totalprice") for c in ("to_date(o_orderdate) < '1996-01-01'", "to_date(o_orderdate) >= '1996-01-01'"))
    return vectors.upsert(old, new, ["o_custkey"], "o_orderkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'")
def delete_by_key(spark: SparkSession, d: str) -> DataFrame:
    return vectors.delete_by(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "1-URGENT")[0]


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def index_replace(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    pick = lambda c: rows.where(c).select("o_custkey", "o_orderkey")
    return sync.replace_keyed(pick("o_orderstatus <> 'F'"), pick("o_orderstatus = 'F'"), ["o_custkey"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT MIN(s_suppkey), 'supplier' FROM supplier WHERE s_nationkey >= 10 GROUP BY s_nationkey HAVING MIN(s_suppkey) >= 10")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    new = table(spark, d, "supplier").where("s_nationkey >= 10").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("n_nationkey")).select("n_nationkey", F.lit("supplier").alias("n_name"))
    return sync.insert_missing(old, new, ["n_nationkey"])


@query("SELECT (SELECT COUNT(*) FROM region) AS region, (SELECT COUNT(*) FROM nation) AS nation, (SELECT COUNT(*) FROM customer) AS customer, (SELECT COUNT(*) FROM supplier) AS supplier, (SELECT COUNT(*) FROM part) AS part, (SELECT COUNT(*) FROM orders) AS orders")
def preset_summary(spark: SparkSession, d: str) -> DataFrame:
    return sync.table_counts({n: table(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders")})


def _star(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    repos = table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_mktsegment").alias("tenant_id"))
    versions = table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("repo_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    spots = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("file_hash")).agg(F.count("*").alias("touch_count"), F.date_format(F.max(F.when(F.col("l_quantity") > 5, F.col("l_shipdate"))), "yyyy-MM-dd").alias("last_touched"))
    return repos, versions, spots


STAR = """repos AS (SELECT c_custkey AS repo_id, c_mktsegment AS tenant_id FROM customer), versions AS (SELECT o_orderkey AS version_id, o_custkey AS repo_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM orders),
spots AS (SELECT l_orderkey AS version_id, l_partkey AS file_hash, COUNT(*) AS touch_count, strftime(MAX(CASE WHEN l_quantity > 5 THEN l_shipdate END), '%Y-%m-%d') AS last_touched FROM lineitem GROUP BY ALL)"""


@query(f"WITH {STAR} SELECT repo_id, version_id, created_at, tenant_id FROM versions JOIN repos USING (repo_id) WHERE tenant_id = 'BUILDING' ORDER BY created_at DESC, version_id LIMIT 50")
def preset_versions(spark: SparkSession, d: str) -> DataFrame:
    repos, versions, _ = _star(spark, d)
    return sync.preset_versions(versions, repos, 50, "BUILDING")


@query(f"WITH {STAR} SELECT * FROM spots JOIN versions USING (version_id) JOIN repos USING (repo_id) WHERE tenant_id = 'BUILDING' ORDER BY touch_count DESC, last_touched DESC NULLS LAST, file_hash, version_id LIMIT 50")
def preset_hotspots(spark: SparkSession, d: str) -> DataFrame:
    repos, versions, spots = _star(spark, d)
    return sync.preset_hotspots(spots, versions, repos, 50, "BUILDING")


@query("SELECT o_orderkey AS run_id, o_orderstatus AS tenant_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM orders WHERE o_orderstatus = 'F' ORDER BY created_at DESC, run_id LIMIT 25")
def preset_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("tenant_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    return sync.preset_runs(runs, 25, "F")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return sync.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, COALESCE(MAX(o_orderkey), 0) + 1 AS next_version FROM orders GROUP BY 1")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    return sync.next_version(table(spark, d, "orders"), ["o_custkey"], "o_orderkey")


@query("""WITH a AS (SELECT doc_id AS path, sha256(text) AS was FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS now FROM documents WHERE doc_id % 10 <> 1)
SELECT COALESCE(a.path, b.path) AS path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE was IS DISTINCT FROM now""")
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    new = docs.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return sync.changed_files(old, new)


def _probe(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COSINE} DESC, e.vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.search(table(spark, d, "embeddings"), _probe(spark, d), 10, vector="embedding", order="vec_id")
    return rows.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, e.label, round({COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY {COSINE} DESC, e.vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.search(table(spark, d, "embeddings"), _probe(spark, d), 10, {"label": 3, "repo": None}, "embedding", "vec_id")
    return rows.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS x FROM documents), i AS (SELECT doc_id, unnest(range(8)) AS i, x FROM h) SELECT doc_id, CAST(i AS INT) AS pos, round(CAST('0x' || substr(x, 2 * i + 1, 2) AS INT) / 255.0::DOUBLE, 5) AS value FROM i""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.hash_embedding(F.col("text"))).alias("pos", "v"))
    return rows.select("doc_id", "pos", F.round(F.col("v").cast("double"), 5).alias("value"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("repo_slug"), F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))


@query()
def chunk_naive(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_files(_files(spark, d)).select("file_path", "start_byte", "end_byte", "start_line", "end_line", "strategy", "chunk_id")


@query()
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.index_files(_files(spark, d), "head")[1]


@query("SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 16) AS INT) AS batch FROM documents")
def batch_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.batches_by_count(table(spark, d, "documents").select("doc_id", "source"), 16, "doc_id", "source")


FULL = "(n >= 16 OR used + o.size > 1000000)"


@query(f"""WITH RECURSIVE o AS (SELECT doc_id, source, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT doc_id, source, size, k, 0 AS batch, size AS used, 1 AS n FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.source, o.size, o.k, CASE WHEN {FULL} THEN batch + 1 ELSE batch END, CASE WHEN {FULL} THEN o.size ELSE used + o.size END, CASE WHEN {FULL} THEN 1 ELSE n + 1 END FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.k = f.k + 1)
SELECT doc_id, source, size, CAST(batch AS INT) AS batch FROM f""")
def batch_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").alias("size"))
    return chunking.batches_by_budget(rows, "size", 1_000_000, 16, "doc_id", "source")


@query("SELECT conv_id, turn, role, text FROM conversations")
def chat_history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").orderBy("conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3 AND trim(text) <> ''")
def last_n_history(spark: SparkSession, d: str) -> DataFrame:
    return serving.last_turns(table(spark, d, "conversations"), "conv_id", "turn", "text", 3).select("conv_id", "turn", "role", "text")


@query("""WITH s AS (SELECT *, MAX(CASE WHEN turn = m AND role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS sys, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM (SELECT *, MIN(turn) OVER (PARTITION BY conv_id) AS m FROM conversations)),
b AS (SELECT *, i - sys AS j FROM s) SELECT conv_id, COUNT(*) FILTER (j >= 0) >= 2 AND bool_and(CASE WHEN j < 0 THEN TRUE ELSE role = CASE WHEN j % 2 = 0 THEN 'user' ELSE 'assistant' END AND length(COALESCE(text, '')) > 0 END) AS valid FROM b GROUP BY conv_id""")
def conversation_valid(spark: SparkSession, d: str) -> DataFrame:
    return corpus.conversations(table(spark, d, "conversations")).select("conv_id", corpus.is_valid(F.col("messages")).alias("valid"))


MERGED = """s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, COUNT(*) OVER (PARTITION BY conv_id) AS n, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' AS sys, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS lead FROM conversations),
merged AS (SELECT conv_id, CAST(CASE WHEN sys AND n > 1 THEN i - 1 ELSE i END AS INT) AS pos, role, CASE WHEN sys AND n > 1 AND i = 1 THEN lead || chr(10) || chr(10) || text ELSE text END AS content FROM s WHERE NOT (sys AND n > 1 AND i = 0))"""


@query(f"WITH {MERGED} SELECT * FROM merged")
def merge_system_turn(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.conversations(table(spark, d, "conversations")).select("conv_id", F.posexplode(corpus.merge_system(F.col("messages"))).alias("pos", "m"))
    return rows.select("conv_id", "pos", "m.role", "m.content")


@query(f"WITH {MERGED} SELECT conv_id, CAST(SUM(length(content)) FILTER (role <> 'user') AS BIGINT) + 17 * COUNT(*) FILTER (role <> 'user') AS trained, CAST(SUM(length(content)) AS BIGINT) + 7 + SUM(CASE WHEN role = 'user' THEN 26 ELSE 36 END) AS total FROM merged GROUP BY conv_id")
def assistant_mask_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.conversations(table(spark, d, "conversations")).select("conv_id", F.explode(corpus.render_segments(corpus.merge_system(F.col("messages")))).alias("p"))
    return rows.groupBy("conv_id").agg(F.sum(F.when(F.col("p.mask") == 1, F.length("p.text"))).alias("trained"), F.sum(F.length("p.text")).alias("total"))


@query("""WITH l AS (SELECT doc_id AS path, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT path, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM l) SELECT path, CAST(line AS INT) AS line, text FROM x WHERE contains(lower(text), 'license') ORDER BY path, line LIMIT 50""")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    return serving.grep(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), "license")


@query(f"WITH {DOC_NAMES} SELECT DISTINCT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) || '/' ELSE path END AS name FROM names ORDER BY name LIMIT 200")
def list_children(spark: SparkSession, d: str) -> DataFrame:
    return serving.children(doc_names(spark, d))


@query("SELECT doc_id AS path, substr(text, 1, 200) AS content, length(text) > 200 AS truncated FROM documents")
def read_prefix(spark: SparkSession, d: str) -> DataFrame:
    return serving.read_prefix(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), 200)


@query("""WITH l AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || '## '), chr(10) || '## ') AS p FROM documents), x AS (SELECT doc_id, generate_subscripts(p, 1) - 2 AS pos, unnest(p) AS part FROM l) SELECT doc_id, CAST(pos AS INT) AS pos, trim(part) AS title, '' AS body FROM x WHERE pos >= 0""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n## ")).alias("text"))
    return serving.sections(rows, "doc_id", "text")


@query("SELECT lang, AVG(quality::DOUBLE) AS accuracy, COUNT(*) AS n, (AVG(quality::DOUBLE) - 0.01::DOUBLE * 25) / (1 - 0.01::DOUBLE * 25) AS centered FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def centered_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    base = rows.select("lang").distinct().withColumn("baseline", F.lit(25.0))
    return metrics.core_metric(rows, base, "lang", "quality")[0].select("lang", "accuracy", "n", "centered")


@query("SELECT AVG(c) AS core FROM (SELECT (AVG(quality::DOUBLE) - 0.25::DOUBLE) / 0.75::DOUBLE AS c FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def macro_metric(spark: SparkSession, d: str) -> DataFrame:
    return centered_accuracy(spark, d).agg(F.avg("centered").alias("core"))


@query("SELECT CASE WHEN COUNT(*) = 4 THEN AVG((a - 0.25::DOUBLE) / 0.75::DOUBLE) END AS chat_core FROM (SELECT lang, AVG(quality::DOUBLE) AS a FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def chat_metric(spark: SparkSession, d: str) -> DataFrame:
    langs = ("de", "en", "es", "fr")
    return metrics.chat_metric(centered_accuracy(spark, d).select("lang", "accuracy"), dict.fromkeys(langs, 0.25), "lang")


@query("SELECT source, AVG(ok) AS accuracy, COUNT(*) AS n FROM (SELECT source, lang, MAX(quality) AS ok FROM labels JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY source")
def any_sample_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return metrics.any_correct(rows, "source", "lang", "quality")


@query("""WITH r AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), f AS (SELECT user_id, MIN(k) FILTER (ok AND k <= 5) AS first FROM r GROUP BY user_id)
SELECT CAST(k AS INT) AS k, AVG(CASE WHEN first <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pass_rate, COUNT(*) AS problems FROM f, range(1, 6) g(k) GROUP BY k""")
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ok", F.col("event_type") == "purchase")
    return metrics.pass_at_k(rows, "user_id", ["ts", "event_id"], "ok", 5)


@query("SELECT event_id, round(value - AVG(value) OVER (PARTITION BY user_id), 6) AS advantage FROM events")
def advantage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.advantages(table(spark, d, "events"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("SELECT round(AVG(m), 6) AS mean_reward FROM (SELECT AVG(value) AS m FROM events GROUP BY user_id)")
def mean_reward(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_reward(table(spark, d, "events"), "user_id", "value").select(F.round("mean_reward", 6).alias("mean_reward"))


@query("SELECT source, round(SUM(n_chars * (1 + quality)) / (ln(2) * SUM(octet_length(encode(text)))), 8) AS bpb FROM labels JOIN documents USING (doc_id) GROUP BY source")
def bits_per_byte(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("loss", (F.col("n_chars") * (1 + F.col("quality"))).cast("double")).withColumn("size", F.octet_length("text"))
    return metrics.bits_per_byte(rows, "loss", "size", "toxic", ["source"]).select("source", F.round("bpb", 8).alias("bpb"))


@query("""WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT a.user_id, a.event_id, round(SUM(b.value * 0.1::DOUBLE * pow(0.9::DOUBLE, a.i - b.i)) / (1 - pow(0.9::DOUBLE, a.i + 1)), 6) AS ema FROM o a JOIN o b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.user_id, a.event_id, a.i""")
def ema_debiased(spark: SparkSession, d: str) -> DataFrame:
    return metrics.smoothed(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id", F.round("ema", 6).alias("ema"))


@query("SELECT event_id, MIN(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running_min FROM events")
def running_min(spark: SparkSession, d: str) -> DataFrame:
    return metrics.running_min(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "running_min")


@query("""SELECT p_partkey, replace(CAST(CAST(p_retailprice * 100 AS BIGINT) AS VARCHAR), ',', '') AS answer FROM part""")
def answer_extract(spark: SparkSession, d: str) -> DataFrame:
    cents = F.format_number((F.col("p_retailprice") * 100).cast("decimal(20,0)"), 0)
    text = F.concat(F.lit("It costs a lot.\n#### "), cents, F.lit(" cents"))
    return table(spark, d, "part").select("p_partkey", corpus.extract_answer(text).alias("answer"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_tax, round(greatest(0.0::DOUBLE, 1 - abs(l_extendedprice - l_extendedprice * (1 - l_discount)) / (abs(l_extendedprice) + 1e-8::DOUBLE)), 6) AS reward FROM lineitem")
def reward_relative(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    reward = corpus.relative_reward(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_tax", F.round(reward, 6).alias("reward"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM part")
def step_bonus(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("so <<"), F.col("p_size").cast("string"), F.lit("*2="), (F.col("p_size") * 2 + F.col("p_size") % 2).cast("string"), F.lit(">>"))
    return table(spark, d, "part").select("p_partkey", corpus.step_bonus(text).alias("bonus"))


@query("SELECT CAST((r - 5) // 7 AS INT) AS \"index\", doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r >= 5 AND r < 500 AND (r - 5) % 7 = 0")
def slice_step(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sliced(table(spark, d, "documents").select("doc_id"), "doc_id", 5, 500, 7)


@query("SELECT doc_id, CASE WHEN source = (SELECT MAX(source) FROM documents) THEN 'val' ELSE 'train' END AS split FROM documents")
def split_last_shard(spark: SparkSession, d: str) -> DataFrame:
    return corpus.split_last_shard(table(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", "split")


@query("WITH r AS (SELECT doc_id, least(length(text), 10000) AS n FROM documents), s AS (SELECT *, SUM(n) OVER (ORDER BY doc_id) - n AS before FROM r) SELECT doc_id, CAST(n AS INT) AS n FROM s WHERE before <= 2000000000")
def corpus_crop(spark: SparkSession, d: str) -> DataFrame:
    return corpus.crop_corpus(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 10_000, 2_000_000_000).select("doc_id", F.length("text").alias("n"))


ENDS = "(total + o.n_chars >= 50000 AND (n + 1) % 8 = 0)"


@query(f"""WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
f AS (SELECT lang, 0::BIGINT AS k, 0::BIGINT AS doc_id, 0::BIGINT AS n_chars, 0 AS next, 0 AS shard, 0::BIGINT AS total, 0 AS n FROM (SELECT DISTINCT lang FROM documents)
  UNION ALL SELECT o.lang, o.k, o.doc_id, o.n_chars, CASE WHEN {ENDS} THEN next + 1 ELSE next END, next, CASE WHEN {ENDS} THEN 0 ELSE total + o.n_chars END, CASE WHEN {ENDS} THEN 0 ELSE n + 1 END FROM f JOIN o ON o.lang IS NOT DISTINCT FROM f.lang AND o.k = f.k + 1)
SELECT lang, doc_id, n_chars, CAST(CASE WHEN shard < MAX(next) OVER (PARTITION BY lang) THEN shard ELSE -1 END AS INT) AS shard FROM f WHERE k > 0""")
def shard_assign(spark: SparkSession, d: str) -> DataFrame:
    return corpus.shards(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), "lang", "doc_id", "n_chars", 50_000, 8)


@query()
def pack_bestfit_crop(spark: SparkSession, d: str) -> DataFrame:
    return corpus.best_fit(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 2049, 1000, True)


@query()
def pack_bestfit_pad(spark: SparkSession, d: str) -> DataFrame:
    return corpus.best_fit(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 2049, 100, False)


@query("SELECT l_returnflag, round(regr_slope(log10(l_extendedprice), log10(l_quantity)), 6) AS exponent, round(pow(10, regr_intercept(log10(l_extendedprice), log10(l_quantity))), 4) AS factor, round(regr_r2(log10(l_extendedprice), log10(l_quantity)), 6) AS r2 FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")
def powerlaw_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.power_law(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rows.select("l_returnflag", F.round("exponent", 6).alias("exponent"), F.round("factor", 4).alias("factor"), F.round("r2", 6).alias("r2"))


@query("""WITH d AS (SELECT l_returnflag, log10(l_quantity) - AVG(log10(l_quantity)) OVER (PARTITION BY l_returnflag) AS u, log10(l_quantity) AS x, log10(l_extendedprice) AS y, AVG(log10(l_quantity)) OVER (PARTITION BY l_returnflag) AS m FROM lineitem),
s AS (SELECT l_returnflag, m, COUNT(*) AS n, SUM(u * u) AS s2, SUM(u * u * u) AS s3, SUM(u * u * u * u) AS s4, SUM(y) AS t0, SUM(u * y) AS t1, SUM(u * u * y) AS t2, MIN(y) AS y0, arg_min(x, y) AS x0 FROM d GROUP BY ALL),
a AS (SELECT *, (n * s2 * t2 - n * s3 * t1 - s2 * s2 * t0) / (n * s2 * s4 - n * s3 * s3 - s2 * s2 * s2) AS a FROM s),
b AS (SELECT *, (t1 - a * s3) / s2 AS b0, (t0 - a * s2) / n AS c0 FROM a),
c AS (SELECT *, b0 - 2 * a * m AS b, c0 - b0 * m + a * m * m AS c FROM b)
SELECT l_returnflag, round(a, 5) AS a, round(b, 5) AS b, round(c, 5) AS c, round(CASE WHEN a > 0 THEN -b / (2 * a) ELSE x0 END, 4) AS x_best, round(CASE WHEN a > 0 THEN c - b * b / (4 * a) ELSE y0 END, 4) AS y_best FROM c""")
def quadratic_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = metrics.parabola(table(spark, d, "lineitem"), F.log10("l_quantity"), F.log10("l_extendedprice"), ["l_returnflag"])
    return fit.select("l_returnflag", *(F.round(c, 5).alias(c) for c in "abc"), *(F.round(c, 4).alias(c) for c in ("x_best", "y_best")))


@query()
def ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(*(F.avg(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")))
    return metrics.ridge(rows, "l_returnflag", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"


@query(rf"SELECT lang, round(SUM(octet_length(encode(text))) / SUM({WORDS})::DOUBLE, 6) AS ratio, round(SUM(octet_length(encode(text))) / SUM(length(text))::DOUBLE, 6) AS base_ratio, round((SUM(length(text)) - SUM({WORDS})) / SUM(length(text))::DOUBLE * 100, 6) AS diff_percent, 'ours' AS better FROM documents GROUP BY lang")
def compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", F.octet_length("text").alias("size"), chunking.token_count(F.col("text")).alias("tokens"), F.length("text").alias("base"))
    out = metrics.compression(rows, "lang", "size", "tokens", "base")
    return out.select("lang", *(F.round(c, 6).alias(c) for c in ("ratio", "base_ratio", "diff_percent")), "better")


@query(rf"SELECT MIN(n) AS tokens_min, MAX(n) AS tokens_max, round(AVG(n), 6) AS tokens_mean, round(stddev_samp(n), 6) AS tokens_std FROM (SELECT CAST({WORDS} AS INT) AS n FROM documents) WHERE n > 0")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(chunking.token_count(F.col("text")).alias("n"))
    return metrics.number_stats(rows, "n", "tokens").select("tokens_min", "tokens_max", F.round("tokens_mean", 6).alias("tokens_mean"), F.round("tokens_std", 6).alias("tokens_std"))


@query("SELECT event_type, round(SUM(CASE WHEN user_id % 2 = 0 THEN value END), 4) AS even, round(SUM(CASE WHEN user_id % 2 = 1 THEN value END), 4) AS odd FROM events GROUP BY event_type")
def metric_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("stage")).agg(F.round(F.sum("value"), 4).alias("value"))
    return metrics.metric_table(rows, "event_type", "stage", ["even", "odd"], "value")


@query("SELECT p_partkey, len(p_name) - len(replace(p_name, 'e', '')) AS n FROM part")
def letter_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", corpus.letter_count(F.col("p_name"), F.lit("e")).alias("n"))


@query("SELECT p_partkey, 'Multiple Choice question: ' || p_name || chr(10) || '- ' || p_brand || '=A' || chr(10) || '- ' || p_type || '=B' || chr(10) || chr(10) || 'Respond only with the letter of the correct answer.' AS prompt FROM part")
def render_choices(spark: SparkSession, d: str) -> DataFrame:
    prompt = corpus.render_choices(F.col("p_name"), F.array(F.lit("A"), F.lit("B")), F.array("p_brand", "p_type"))
    return table(spark, d, "part").select("p_partkey", prompt.alias("prompt"))


@query("SELECT vec_id, CAST(list_position(CAST(embedding AS DOUBLE[]), list_max(CAST(embedding AS DOUBLE[]))) - 1 AS INT) AS choice FROM embeddings")
def categorical_choice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", corpus.first_most(F.col("embedding")).alias("choice"))


@query("SELECT event_type, arg_min(value, (ts, event_id)) AS value, arg_min(user_id, (ts, event_id)) AS user_id FROM events GROUP BY event_type")
def first_row_per_group(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_known(table(spark, d, "events"), "event_type", ["ts", "event_id"], ["value", "user_id"])


@query("SELECT o_orderpriority, o_custkey FROM (SELECT DISTINCT o_orderpriority FROM orders) p, (SELECT DISTINCT o_custkey FROM orders) c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = p.o_orderpriority AND o.o_custkey = c.o_custkey)")
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("budget"), F.col("o_custkey").alias("depth")).distinct()
    grid = metrics.sweep_grid(rows.select("budget").distinct(), rows.select("depth").distinct(), rows)
    return grid.select(F.col("budget").alias("o_orderpriority"), F.col("depth").alias("o_custkey"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS answer, 'Multiple Choice question: ' || p_name || chr(10) || '- ' || p_brand || '=A' || chr(10) || '- ' || p_type || '=B' || chr(10) || chr(10) || 'Respond only with the letter of the correct answer.' AS prompt FROM part")
def choice_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.array("p_brand", "p_type").alias("choices"), (F.col("p_size") % 2).alias("answer"))
    rows = tasks.choice_conversations(rows, "p_name", "choices", "answer")
    return rows.select("p_partkey", F.col("messages")[1]["content"].alias("answer"), F.col("messages")[0]["content"].alias("prompt"))


@query("""WITH m AS (SELECT conv_id, COUNT(*) AS n, SUM(length(text)) AS total, MAX(length(text)) AS longest, bool_or(role NOT IN ('user', 'assistant')) AS odd, bool_or(length(text) = 0) AS empty FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN n > 4 THEN 'too many messages' WHEN empty THEN 'empty message' WHEN longest > 1000 THEN 'message too long' WHEN total > 2000 THEN 'conversation too long' WHEN odd THEN 'unknown role' WHEN conv_id % 10 = 0 THEN 'temperature out of range' END AS error FROM m""")
def request_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.conversations(table(spark, d, "conversations")).withColumns({"temperature": F.when(F.col("conv_id") % 10 == 0, 3.0).otherwise(1.0), "top_k": F.lit(50), "max_tokens": F.lit(256)})
    return tasks.request_errors(rows, 4, 1000, 2000).select("conv_id", "error")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM k WHERE r <= 10 AND trim(text) <> '' GROUP BY 1""")
def agent_prompt(spark: SparkSession, d: str) -> DataFrame:
    return tasks.agent_prompt(table(spark, d, "conversations"))


def queries() -> dict[str, Query]:
    from stratum.plans import data_queries, function_queries  # noqa: F401  each registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


