"""Running context accounting against the same over whole tables."""

import time

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import context
from tessera.streaming import events, messages

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def put(rows, data, folder):
    rows(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def expected(rows, data):
    table = rows(data, SCHEMA)
    used = {r.conv_id: (r.system_tokens, r.current_tokens, r.history_tokens, r.total_tokens, r.warning_level) for r in context.usage(table, 10, 300).collect()}
    kept = context.sliding_window(table, 60).filter("kept and role <> 'system'").groupBy("conv_id").agg(F.min("turn").alias("first")).collect()
    first = {r.conv_id: r["first"] for r in kept}
    return {c: (*u, first.get(c)) for c, u in used.items()}


def run(spark, folder):
    stream = messages.running_usage(messages.read_messages(spark, f"{folder}/said"), 10, 300, 60)
    last = events.run_updates(stream, f"{folder}/table", f"{folder}/checkpoint", ["conv_id"])
    return {r.conv_id: r for r in last.collect()}


def test_any_order_and_a_restart_give_the_batch_result(spark, rows, tmp_path):
    draw = np.random.default_rng(4)
    data = [(c, t, "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2], "x" * int(draw.integers(0, 150))) for c in range(12) for t in range(int(draw.integers(1, 9)))]
    data.append((3, 40, "user", None))
    data = [data[i] for i in draw.permutation(len(data))]
    folder = str(tmp_path)
    for at in (0, 25):
        put(rows, data[at : at + 12], f"{folder}/said")
        put(rows, data[at + 12 : at + 25 if at == 0 else None], f"{folder}/said")
        # the second round is a new query that goes on from the first one's checkpoint
        found = run(spark, folder)
        seen = data[: 25 if at == 0 else None]
        got = {c: (r.system_tokens, r.current_tokens, r.history_tokens, r.total_tokens, r.warning_level, r.kept_from) for c, r in found.items()}
        assert got == expected(rows, seen)
        assert sum(r.messages for r in found.values()) == len(seen) and not any(r.closed for r in found.values())


def test_idle_conversations_end(spark, rows, tmp_path):
    folder = str(tmp_path)
    put(rows, [(1, 0, "user", "a" * 40), (None, 0, "user", "b"), (2, None, "user", "b")], f"{folder}/said")
    stream = messages.running_usage(messages.read_messages(spark, f"{folder}/said"), 10, 300, 60, 1)
    query = stream.writeStream.outputMode("update").format("memory").queryName("idle").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="1 second").start()

    def wait(done):
        until = time.time() + 40
        while not done(found := spark.table("idle").collect()) and time.time() < until and query.isActive:
            time.sleep(0.5)
        return found

    try:
        closed = [r for r in wait(lambda found: any(r.closed for r in found)) if r.closed]
        assert [(r.conv_id, r.messages, r.current_tokens) for r in closed] == [(1, 1, 10)]
        put(rows, [(1, 1, "user", "a" * 8)], f"{folder}/said")
        anew = [r for r in wait(lambda found: any(r.total_tokens == 12 for r in found)) if r.total_tokens == 12]
        assert anew and anew[0].messages == 1 and anew[0].kept_from == 1
    finally:
        query.stop()
