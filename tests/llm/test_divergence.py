"""The audit of sources against its definition."""

import random
import re
from collections import Counter, defaultdict

import pytest

from stratum.llm import divergence


def plain(rows, least=10, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for text, lang, source in rows]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang, source, [t.translate(low) for t in terms]) for lang, source, terms in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for *_, terms in own for t in set(terms))
        kept = sorted(t for t, n in seen.items() if n >= least)
        count = defaultdict(Counter)
        for _, source, terms in own:
            count[source].update(t for t in terms if seen[t] >= least)
        everything = sum(count.values(), Counter())

        def share(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        shares, q = {s: share(c) for s, c in count.items()}, share(everything)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in shares.items():
            pairs = [(o, sum(f(p[t], po[t]) for t in kept)) for o, po in shares.items() if o != s]
            terms = [(t, f(p[t], q[t])) for t in kept if count[s][t] > 0 and p[t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def some_rows(seed=1, n=400):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "BETA", "gamma9delta", "ÄRA", "ära", "日本", "x", "İ", "straße", "e-mail", "...", "42"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(n):
        source = "hot" if k % 3 == 0 else f"s{rnd.randrange(6)}"
        bias = words[hash_of(source) % 50 :][:8]
        rows.append((" ".join(rnd.choice(words if rnd.random() < 0.7 else bias) for _ in range(rnd.randrange(0, 30))), rnd.choice(["en", "de", None]), rnd.choice([source, source, None])))
    return [*rows, (None, "en", "bare"), ("12 34 --", "fr", "numbers"), ("lonely words", "fr", "x"), ("", None, None), ("word " * 30_000 + "Tail", "en", "s1"), *[rows[0]] * 5]


def hash_of(text):
    return sum(map(ord, text))


def frame(spark, rows):
    return spark.createDataFrame([(1, "q", *r) for r in rows], "n int, term string, text string, lang string, source string").repartition(4)


def audited(df):
    return sorted(tuple(r) for r in divergence.audit(df).collect())


def test_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 700)
    rows = some_rows()
    assert audited(frame(spark, rows)) == plain(rows)


def test_empty_tables_and_languages_without_terms(spark):
    assert audited(frame(spark, some_rows()).limit(0)) == []
    rows = [("a b", "en", "x"), ("a c", "en", "y"), (None, "en", None)]
    got = audited(frame(spark, rows))
    assert got == plain(rows) and all(v == 0 and part == "pair" for _, _, part, _, v, _ in got) and len(got) == 6


def test_more_groups_than_may_be_broadcast(spark, monkeypatch):
    from stratum.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = some_rows(seed=2, n=150)
    assert audited(frame(spark, rows)) == plain(rows)


@pytest.mark.parametrize("count,total", [(2, 3), (2, 7), (999_999_999, 1_000_000_007), (90_000_000_000_000 - 1, 90_000_000_000_000), (2, 90_000_000_000_000), (5, 5)])
def test_shares_are_exact(spark, count, total):
    from pyspark.sql import functions as F

    got = spark.range(1).select(divergence.share(F.lit(count).cast("long"), F.lit(total).cast("long")).alias("p")).first()["p"]
    assert got == 1 + 10**9 * count // total
