"""Last turns of running chats against the batch operator, after any split into batches."""

import random

from stratum.operators import serving
from stratum.streaming import streams

SCHEMA = "conv long, turn long, role string, text string"


def test_equals_the_batch_operator_after_any_split(spark, tmp_path, request):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled"))
    draw = random.Random(1)
    rows = [(c if c else None, t, draw.choice(["user", "assistant"]), draw.choice(["hello", " ", "", None, f"text {t}"])) for c in range(5) for t in range(draw.randrange(1, 9))]
    sent = [*rows, *draw.sample(rows, 5)]  # some come again
    draw.shuffle(sent)
    cuts = sorted(draw.sample(range(1, len(sent)), 2))
    seen = {}
    for a, b in zip([0, *cuts], [*cuts, len(sent)], strict=True):
        # each batch in a run of its own: state comes from the checkpoint
        spark.createDataFrame(sent[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.running_turns(streams.corpus_stream(spark, str(tmp_path / "in"), SCHEMA, 10), "conv", "turn", "text", 3)
        got = {}
        q = stream.writeStream.foreachBatch(lambda df, _, got=got: got.update({r["conv"]: [tuple(t) for t in r["turns"]] for r in df.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert got.keys() == {c for c, *_ in sent[a:b] if c is not None}
        seen |= got
        so_far = spark.createDataFrame(list(dict.fromkeys(r for r in sent[:b] if r[0] is not None)), SCHEMA)
        want = {c: [] for c in seen}
        for r in serving.last_turns(so_far, "conv", "turn", "text", 3).collect():
            want[r["conv"]].append((r["turn"], r["role"], r["text"]))
        assert {c: sorted(t) for c, t in seen.items()} == {c: sorted(t) for c, t in want.items()}
