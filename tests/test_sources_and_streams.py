"""A generated repository end to end, files in and out, and streams."""

import os
import subprocess

from pyspark.sql import functions as F

from stratum.operators import gold
from stratum.plans import cli
from stratum.sources import git as git_source, keyed, text
from stratum.streaming import streams


def commit(folder, files, day):
    for name, body in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    env = os.environ | {"GIT_COMMITTER_DATE": f"2026-01-0{day}T00:00:00+00:00", "GIT_AUTHOR_DATE": f"2026-01-0{day}T00:00:00+00:00"}
    run = lambda *a: subprocess.run(["git", *a], cwd=folder, check=True, capture_output=True, env=env)
    run("add", "-A")
    run("-c", "user.name=Test User", "-c", "user.email=t@example.com", "commit", "-qm", f"change {day}\n\nmore")


def test_repository_end_to_end(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    subprocess.run(["git", "init", "-q"], cwd=repo, check=True)
    commit(repo, {"README.md": "# r", "src/app.py": "1"}, 1)
    commit(repo, {"src/app.py": "2", "src/utils.py": "1", "node_modules/x.js": "1", "logo.png": "1"}, 2)
    commit(repo, {"src/app.py": "3", "src/utils.py": "2"}, 3)
    commit(repo, {"src/app.py": "4", "src/utils.py": "3"}, 4)
    got = git_source.ingest(spark, "https://host/owner/repo.git", str(repo))
    assert got["repo"].first()["repo_slug"] == "owner__repo" and len(got["repo"].first()["head_commit"]) == 40
    hashes = {r["path"]: r["content_hash"] for r in got["files"].collect()}
    assert set(hashes) == {"README.md", "src/app.py", "src/utils.py", "logo.png"} and hashes["logo.png"] == "" and len(hashes["README.md"]) == 64
    first = got["commits"].orderBy("ord").first()
    assert first["message"] == "change 4\n\nmore" and {f["path"] for f in first["files_changed"]} == {"src/app.py", "src/utils.py"}
    spots = gold.hotspots(got["touches"]).collect()
    assert (spots[0]["path"], spots[0]["touch_count"]) == ("src/app.py", 4) and spots[0]["last_touched"].startswith("2026-01-04")
    assert [tuple(r) for r in gold.co_changes(got["touches"]).collect()] == [("src/app.py", "src/utils.py", 3)]
    raw, out, snap = (str(tmp_path / n) for n in ("raw", "gold", "snap"))
    assert cli.main(["ingest", "--repo", f"file://{repo}", "--repo", "file:///none", "--raw-root", raw]) == 0
    assert cli.main(["transform", "--raw-root", raw, "--out", out]) == 0
    assert cli.main(["load", "--gold", out, "--out", snap]) == 0 and cli.main(["load", "--gold", out, "--out", snap]) == 0
    assert cli.main(["index", "--raw-root", raw, "--out", str(tmp_path / "v")]) == 0
    name = next(p.name for p in (tmp_path / "snap").iterdir() if p.name != "index")
    assert spark.read.json(f"{snap}/index").count() == 1 and spark.read.json(f"{snap}/{name}/risk_levels").count() == 5
    assert cli.main(["snapshot", "--snapshots", snap, "--slice", "hotspots", "--repo", name]) == 0
    assert cli.main(["ingest", "--repo", "file:///none", "--raw-root", str(tmp_path / "x")]) == 1
    # tables by a path of Spark's, apart from the clones
    away = f"file://{tmp_path}/away"
    assert cli.main(["ingest", "--repo", f"file://{repo}", "--raw-root", away, "--clones", str(tmp_path / "clones")]) == 0
    assert not (tmp_path / "away" / name / "repo").exists() and (tmp_path / "clones" / name / "repo" / ".git").exists()
    assert cli.main(["transform", "--raw-root", away, "--out", f"{away}-gold"]) == 0
    assert spark.read.parquet(f"{away}-gold/{name}/hotspots").count() == 5
    assert cli.main(["snapshot", "--snapshots", snap, "--slice", "hotspots", "--repo", "none"]) == 1
    assert cli.main(["transform", "--raw-root", str(tmp_path / "nothing"), "--out", out]) == 1


def test_numstat_lines(spark):
    lines = ["__COMMIT__a", "1\t-\ta\\b.py", "bad", "x\ty\tz", "__COMMIT__b", "", "2\t3\tc.py"]
    rows = spark.createDataFrame([("r", k, v) for k, v in enumerate(lines)], "repo string, line_no int, value string")
    assert [(r["sha"], r["path"], r["additions"], r["deletions"]) for r in git_source.parse_numstat(rows).orderBy("line_no").collect()] == [("a", "a/b.py", 1, 0), ("b", "c.py", 2, 3)]


def test_shards_results_and_settings(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("a", 0), ("b", 1), ("c", -1)], "text string, shard int").transform(lambda d: text.write_shards(d, str(tmp_path / "s")) or d)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    (tmp_path / "r.csv").write_text("Task, Accuracy, Centered\nA   , 0.5, 0.25\nCORE, , 0.25\n")
    assert [tuple(r) for r in text.read_results(spark, str(tmp_path / "r.csv")).collect()] == [("A", 0.5, 0.25), ("CORE", None, 0.25)]
    (tmp_path / ".env").write_text("# c\nSTRATUM_A='x=1'\nSTRATUM_B=2\n")
    monkeypatch.setenv("STRATUM_B", "old")
    monkeypatch.delenv("STRATUM_A", raising=False)
    assert text.settings(str(tmp_path / ".env")) == {"STRATUM_A": "x=1", "STRATUM_B": "2"} and os.environ["STRATUM_A"] == "x=1" and os.environ["STRATUM_B"] == "old"
    monkeypatch.delenv("STRATUM_A", raising=False)
    (tmp_path / "c.jsonl").write_text('[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]\n\n')
    assert text.read_conversations(spark, str(tmp_path / "c.jsonl")).count() == 1
    assert text.read_object(spark, str(tmp_path / "none")) is None


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, t int").coalesce(1).write.parquet(src)
    stream = streams.corpus_stream(spark, src, "k string, t int")
    streams.append_log(stream, str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    streams.append_log(streams.corpus_stream(spark, src, "k string, t int"), str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    tables = keyed.KeyedTables(spark, str(tmp_path / "keyed"), {"seen": ["k"]}, 4)
    seen = stream.select("k", F.col("t").alias("first_seen"), F.col("t").alias("last_seen"))
    streams.sync_stream(seen, tables, "seen", str(tmp_path / "c2")).awaitTermination()
    spark.createDataFrame([("a", 9)], "k string, t int").coalesce(1).write.mode("append").parquet(src)
    again = streams.corpus_stream(spark, src, "k string, t int").select("k", F.col("t").alias("first_seen"), F.col("t").alias("last_seen"))
    streams.sync_stream(again, tables, "seen", str(tmp_path / "c2")).awaitTermination()
    assert sorted(map(tuple, tables.read("seen").collect())) == [("a", 1, 9), ("b", 2, 2)]
