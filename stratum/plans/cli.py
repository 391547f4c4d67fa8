"""Command line: ingest, transform and load of repositories, indexing, and preset reports.

    python -m stratum.plans.cli ingest --repo URL --raw-root raw [--clones DIR] [--branch B] [--depth N]
    python -m stratum.plans.cli transform --raw-root raw --out gold [--top-n-hotspots 20]
    python -m stratum.plans.cli load --gold gold --out snapshots
    python -m stratum.plans.cli index --raw-root raw --out vectors [--max-bytes 1200 --overlap 120 --min-split 300]
    python -m stratum.plans.cli report summary|versions|hotspots|sync-runs --tables DIR [--limit 20] [--tenant-id T]
    python -m stratum.plans.cli snapshot --snapshots snapshots --slice hotspots [--repo SLUG]

All folders may lie on any file system that Spark reads, but for that of the clones, which must be
mounted on all machines; it is the raw root if none is given.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratum.functions.paths import slug
from stratum.operators import chunking, gold, imports, sync
from stratum.sources import git as git_source, text

SLICES = ("hotspots", "risk_levels", "conventions", "authorship", "co_change_pairs", "import_edges", "directories", "suffixes", "start_here")


def session(name: str = "stratum") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def gold_tables(tables: dict[str, DataFrame], top_n: int = gold.TOP_HOTSPOTS) -> dict[str, DataFrame]:
    """All sections of one repository's analysis from its files and touches."""
    files = tables["files"].withColumn("ord", F.xxhash64("path"))
    touches = tables["touches"]
    spots, pairs = gold.hotspots(touches, top_n), gold.co_changes(touches)
    owners = gold.authorship(touches, files)
    found = gold.conventions(files, files.where(F.lower("path").rlike(r"(^|/)(pyproject\.toml|setup\.cfg)$")).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")))
    habits = None
    for kind, df in found.items():
        one = df.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("value"))
        habits = one if habits is None else habits.union(one)
    sources = files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return {
        "hotspots": spots, "co_change_pairs": pairs, "authorship": owners, "risk_levels": gold.risk_levels(spots, pairs, owners), "directories": gold.directory_counts(files),
        "suffixes": gold.suffix_counts(files), "start_here": gold.start_here(files), "conventions": habits, "import_edges": imports.import_edges(sources),
    }


def ingest(args: argparse.Namespace) -> int:
    """Bring each repository in; a failing one is told and passed over. 0 if any succeeded."""
    spark, good = session(), 0
    for url in args.repo:
        name = spark.range(1).select(slug(F.lit(url))).first()[0]
        folder = Path(args.clones or args.raw_root) / name / "repo"
        try:
            git_source.fetch_or_clone(url, folder, args.branch, args.depth)
            for table, df in git_source.ingest(spark, url, str(folder.resolve())).items():
                df.write.mode("overwrite").parquet(f"{args.raw_root}/{name}/{table}.parquet")
            good += 1
        except Exception as e:  # noqa: BLE001
            print(f"{url}: {e}", file=sys.stderr)
    return int(not good)


def transform(args: argparse.Namespace) -> int:
    spark, good = session(), 0
    for repo in text.folders(spark, args.raw_root, "touches.parquet"):
        try:
            tables = {t: spark.read.parquet(f"{args.raw_root}/{repo}/{t}.parquet") for t in ("files", "touches")}
            for name, df in gold_tables(tables, args.top_n_hotspots).items():
                df.write.mode("overwrite").parquet(f"{args.out}/{repo}/{name}")
            good += 1
        except Exception as e:  # noqa: BLE001
            print(f"{repo}: {e}", file=sys.stderr)
    return int(not good)


def load(args: argparse.Namespace) -> int:
    """Snapshots of each repository as JSON, and an index in which a repository replaces its old entry."""
    spark = session()
    found = text.folders(spark, args.gold, "hotspots")
    for repo in found:
        for name in SLICES:
            spark.read.parquet(f"{args.gold}/{repo}/{name}").coalesce(1).write.mode("overwrite").json(f"{args.out}/{repo}/{name}")
    new = spark.createDataFrame([(repo,) for repo in found], "repo_slug string").withColumn("loaded_at", F.current_timestamp().cast("string"))
    at = f"{args.out}/index"
    old = spark.read.schema(new.schema).json(at) if text.exists(spark, at) else new.limit(0)
    # written beside the old index, which it then replaces
    sync.replace_keyed(old, new, ["repo_slug"]).orderBy("repo_slug").write.mode("overwrite").json(f"{at}.new")
    text.put_in_place(spark, f"{at}.new", at)
    return int(not found)


def index(args: argparse.Namespace) -> int:
    spark = session()
    config = chunking.ChunkConfig(args.max_bytes, args.overlap, args.min_split)
    for repo in text.folders(spark, args.raw_root, "files.parquet"):
        head = spark.read.parquet(f"{args.raw_root}/{repo}/repo.parquet").first()["head_commit"]
        files = spark.read.parquet(f"{args.raw_root}/{repo}/files.parquet")
        known = files.withColumns({"present": F.lit(True), "ord": F.col("path")})
        files = chunking.eligible_files(known, args.limit, args.max_file_bytes, args.skip_empty_hashes)
        records, stats = chunking.index_files(files.withColumn("repo_slug", F.lit(repo)), head, config)
        records.write.mode("overwrite").parquet(f"{args.out}/{repo}")
        stats.show()
    return 0


def report(args: argparse.Namespace) -> int:
    spark = session()
    read = lambda name: spark.read.parquet(f"{args.tables}/{name}")
    if args.name == "summary":
        names = ("tenants", "repos", "repo_versions", "version_hotspots", "version_files", "sync_runs")
        sync.table_counts({n: read(n) for n in names}).show()
    elif args.name == "versions":
        sync.preset_versions(read("repo_versions").withColumnRenamed("last_seen_at", "created_at"), read("repos"), args.limit, args.tenant_id).show(args.limit, False)
    elif args.name == "hotspots":
        sync.preset_hotspots(read("version_hotspots"), read("repo_versions"), read("repos"), args.limit, args.tenant_id).show(args.limit, False)
    else:
        sync.preset_runs(read("sync_runs"), args.limit, args.tenant_id).show(args.limit, False)
    return 0


def snapshot(args: argparse.Namespace) -> int:
    spark = session()
    names = [args.repo] if args.repo else [n for n in text.folders(spark, args.snapshots) if n != "index"]
    for name in names:
        path = f"{args.snapshots}/{name}/{args.slice}"
        if not text.exists(spark, path):
            print(f"{name}: no {args.slice}", file=sys.stderr)
            return 1
        spark.read.json(path).show(50, False)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("--repo", action="append", required=True)
    p.add_argument("--raw-root", required=True)
    p.add_argument("--clones")
    p.add_argument("--branch")
    p.add_argument("--depth", type=int)
    p.set_defaults(run=ingest)
    p = sub.add_parser("transform")
    p.add_argument("--raw-root", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--top-n-hotspots", type=int, default=gold.TOP_HOTSPOTS)
    p.set_defaults(run=transform)
    p = sub.add_parser("load")
    p.add_argument("--gold", required=True)
    p.add_argument("--out", required=True)
    p.set_defaults(run=load)
    p = sub.add_parser("index")
    p.add_argument("--raw-root", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--max-bytes", type=int, default=1200)
    p.add_argument("--overlap", type=int, default=120)
    p.add_argument("--min-split", type=int, default=300)
    p.add_argument("--limit", type=int)
    p.add_argument("--max-file-bytes", type=int)
    p.add_argument("--skip-empty-hashes", action=argparse.BooleanOptionalAction, default=True)
    p.set_defaults(run=index)
    p = sub.add_parser("report")
    p.add_argument("name", choices=("summary", "versions", "hotspots", "sync-runs"))
    p.add_argument("--tables", required=True)
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--tenant-id")
    p.set_defaults(run=report)
    p = sub.add_parser("snapshot")
    p.add_argument("--snapshots", required=True)
    p.add_argument("--slice", choices=SLICES, required=True)
    p.add_argument("--repo")
    p.set_defaults(run=snapshot)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
