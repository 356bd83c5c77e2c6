import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from tessera.llm import prefix_trie, queries  # noqa: E402

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(data):
    """The nodes by a walk over lists; rows of one turn have to be alike or told apart by their key."""

    def key(role, text):
        return hashlib.md5(hashlib.md5(role.encode()).digest() + hashlib.md5(text.encode()).digest()).digest()

    own = defaultdict(list)
    for conv, turn, role, text in data:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[x] for x in below) if below else 1
        saved[path] = sum(saved[x] for x in below) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        out.append((convs[0], len(path), parent, len(convs), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations(seed, n, turns=9, words=3):
    draw = random.Random(seed)
    data = []
    for conv in [*range(n), *range(100, 100 + n), 250, 300, -7, -100, -205]:
        for turn in range(draw.randint(1, turns)):
            data.append((conv, draw.choice([turn, turn, turn + 20, None if turn == 0 else turn]), draw.choice(["user", "assistant", None, ""]), draw.choice(["hi", "Grüße 🙂", "", None] + [f"w{i}" for i in range(words)])))
    return data


def found_of(frame):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame).collect()), key=str)


@pytest.mark.parametrize("sizes", [(256, 64), (8, 2), (16, 3)])
def test_trie_by_brute_force(rows, monkeypatch, sizes):
    monkeypatch.setattr(prefix_trie, "SHARD", sizes[0])
    monkeypatch.setattr(prefix_trie, "BAND", sizes[1])
    data = odd_conversations(1, 40)
    data += [(i, t, "user", "same") for i in (400, 401, 402, 407, 455) for t in range(12)]  # copies, through several bands
    data += data[:5] + [(None, 1, "user", "no conversation"), (500, None, None, None), (701, 1, "a", "x"), (702, 1, "a", "x")]
    assert found_of(rows(data, SCHEMA).repartition(3)) == plain_trie(data)


def test_long_and_common_conversations(rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 8)
    data = [(c, t, "user" if t % 2 else "assistant", f"turn {t}") for c in range(1000, 1030) for t in range(3)]
    data += [(5, t, "user", f"long {t % 7}") for t in range(700)] + [(6, t, "user", f"long {t % 7}") for t in range(650)] + [(1, 0, "user", "x" * 100_000)]
    assert found_of(rows(data, SCHEMA).repartition(4)) == plain_trie(data)


def test_separators_in_texts_and_roles(rows):
    data = [(10 * i, 0, role, text) for i, (role, text) in enumerate([("a", "bc"), ("ab", "c"), ("a,b", "c"), ("a", "b,c"), ("", "abc"), (None, "abc"), ("abc", None)])]
    assert found_of(rows(data, SCHEMA)) == plain_trie(data)


def test_none_and_one(rows):
    assert found_of(rows([], SCHEMA)) == []
    assert found_of(rows([(None, 0, "a", "b")], SCHEMA)) == []
    for conv in (1, 3):  # one of them takes turns from a conversation that isn't there, and has none left
        assert found_of(rows([(conv, 0, "a", "b")], SCHEMA)) == plain_trie([(conv, 0, "a", "b")])


def test_other_columns(rows):
    data = odd_conversations(2, 10)
    frame = rows(data, SCHEMA)
    for name in ("key", "pos", "depth", "node", "size", "shard", "at", "band", "turns", "n", "place", "position", "_id", "parent", "turn_key"):
        frame = frame.withColumn(name, F.lit("clash"))
    assert found_of(frame) == plain_trie(data)


def test_query_against_sql_and_brute_force(spark, rows, tmp_path):
    data = odd_conversations(3, 60)
    rows(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = sorted((tuple(r) for r in queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect()), key=str)
    assert found == plain_trie(data) == sorted(connection.sql(prefix_trie.ORACLE).fetchall(), key=str)


def test_registered_table(spark):
    data = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op13_prefix_trie"](spark, "/root/testdata/sf0.01").collect()), key=str) == plain_trie(data)
