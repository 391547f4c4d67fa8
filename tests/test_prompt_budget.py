"""Prompt sections against a plain loop: empty and null files, odd white space, hot and null groups."""

import random
import re

from stratum.operators import serving


def plain(files, file_chars, total):
    rank = lambda p: next((k for k, x in enumerate(serving.PREFERRED) if re.search(x, p.replace("\\", "/"))), 100)
    left, out = total, []
    for path, text in sorted(((p, t or "") for p, t in files), key=lambda x: (rank(x[0]), x[0], x[1])):
        if left <= 0:
            break
        limit = min(file_chars, left)
        shown = text if len(text) <= limit else text[:limit].rstrip() + serving.MARK
        left -= len(shown)
        out.append((len(out), path, shown))
    return out


def some_files(draw, n):
    texts = ["", None, "x", "short text", "a" * 30, "b" * 26 + " " * 40, " " * 60, " " * 50, "é\n" * 35, "word " * 9]
    return [(draw.choice(["README.md", "docs/", "src/", "Dockerfile", "z/"]) + f"{draw.randrange(40)}", draw.choice(texts)) for _ in range(n)]


def test_sections(spark):
    draw = random.Random(1)
    groups = {(None if g == 0 else f"g{g}"): some_files(draw, draw.choice([1, 5, 60])) for g in range(9)}
    groups["hot"] = some_files(draw, 300)
    groups["empty"] = [("a", ""), ("b", None)]
    rows = spark.createDataFrame([(k, p, t, 1) for k, own in groups.items() for p, t in own], "n string, path string, content string, rank int").repartition(6)
    for file_chars, total in ((30, 100), (25, 25), (40, 400), (30, 4000)):
        got = {}
        for r in serving.prompt_sections(rows, ["n"], file_chars, total).collect():
            got.setdefault(r["n"], []).append((r["place"], r["path"], r["excerpt"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: plain(own, file_chars, total) for k, own in groups.items()}
    one = serving.prompt_sections(rows.where("n = 'hot'").drop("n"), (), 30, 200)
    assert one.columns == ["place", "path", "excerpt"] and sorted(map(tuple, one.collect())) == plain(groups["hot"], 30, 200)
    assert serving.prompt_sections(rows.limit(0), ["n"]).collect() == []


def test_no_group_is_one_function_call(spark):
    rows = spark.range(50).selectExpr("id % 2 as k", "'p' || id as path", "'text' as content")
    plan = serving.prompt_sections(rows, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan
