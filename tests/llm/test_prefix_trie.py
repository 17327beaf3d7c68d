import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lexloom.llm.prefix_trie import Parentheses, conversation_codes, hash_of_ids, prefix_trie, regrown

SCHEMA = "conv_id long, turn long, role string, text string"


def code_of(role, text):
    said = f"{len(role.encode())}:{role}{text}".encode()
    return hashlib.sha256(said).digest()[:16]


def conversations_of(rows):
    by_conversation = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            by_conversation[conv_id].append((turn is not None, turn or 0, code_of(role, text), role, text))
    return {conv_id: [(role, text) for *_, role, text in sorted(turns)] for conv_id, turns in by_conversation.items()}


def plain_regrown(own):
    made = {}
    for conv_id in own:
        h = zlib.crc32(str(conv_id).encode()) % 9
        made[conv_id] = tuple(own.get(conv_id - conv_id % 5, [])[:h] + own[conv_id][h:])
    return made


def plain_nodes(paths):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv_id, path in paths.items():
        ends[path].append(conv_id)
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv_id)
            if depth:
                children[path[: depth - 1]].add(path[:depth])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        own = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for depth in range(len(node) + 1):
            saved[node[:depth]] += own
            leaves[node[:depth]] += not children[node]
    made = []
    for node, convs in members.items():
        ids = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        made.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(made, key=str)


def found(trie):
    return sorted(map(tuple, trie.collect()), key=str)


def odd_turns():
    """Null turns, roles, texts and ids, ties, repeated rows, copies of a whole conversation, and one that is long."""
    at = random.Random(5)
    rows = []
    for conv_id in range(1, 160):
        for turn in [None] * (conv_id % 7 == 0) + list(range(at.randint(0, 11))):
            text = "same" if at.random() < 0.6 else at.choice(["a", "éß", None, ""])
            rows.append((conv_id, turn, at.choice(["user", "user", None]), text))
    rows += [(200, 1, "user", "tie b"), (200, 1, "user", "tie a"), (200, 1, "user", "tie a"), (None, 1, "user", "nobody's")]
    rows += [(conv_id, turn, "user", f"copied {turn}") for conv_id in range(300, 420) for turn in range(12)]
    return rows + [(500, turn, "user", f"long {turn}") for turn in range(900)]


@pytest.mark.parametrize("shard_size", [1, 7, 100_000])
def test_nodes_are_those_of_a_plain_trie(spark, shard_size):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "'x' AS path", "1 AS n", "2 AS line")
    trie = prefix_trie(regrown(conversation_codes(turns)), shard_size)
    assert found(trie) == plain_nodes(plain_regrown(conversations_of(rows)))


def test_given_conversations(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = list(map(tuple, turns.select("conv_id", "turn", "role", "text").collect()))
    own = conversations_of(rows)
    assert found(prefix_trie(conversation_codes(turns), 50)) == plain_nodes({at: tuple(path) for at, path in own.items()})


def test_no_conversations_make_no_node(spark):
    turns = spark.createDataFrame([(None, 1, "user", "nobody's")], SCHEMA)
    assert prefix_trie(regrown(conversation_codes(turns))).count() == 0
    alone = spark.createDataFrame([(7, [])], "conv_id long, codes array<binary>")
    assert [row[:7] for row in map(tuple, prefix_trie(alone).collect())] == [(7, 0, None, 1, 0, 1, 0)]


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_parentheses_close_where_a_stack_says(block):
    at = random.Random(block)
    for _ in range(60):
        row, open_, left = [True], 1, at.randint(0, 150)
        while open_:
            opening = left > 0 and at.random() < 0.55
            left -= opening
            open_ += 1 if opening else -1
            row.append(opening)
        stack, close = [], {}
        for place, opening in enumerate(row):
            if opening:
                stack.append(place)
            else:
                close[stack.pop()] = place
        tree = Parentheses(np.array(row), block)
        assert tree.find_close(tree.opens).tolist() == [close[place] for place in tree.opens.tolist()]
        assert tree.leaf_rank[-1] == sum(a and not b for a, b in zip(row, row[1:], strict=False))


def test_ids_of_a_key_may_lie_in_many_tasks(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, X'01', unhex(hex(id))) AS key", "id * 7 % 20011 AS id")
    ids = defaultdict(list)
    for row in rows.collect():
        ids[bytes(row.key)].append(row.id)
    wanted = {key: hashlib.sha256(",".join(map(str, sorted(of))).encode()).hexdigest() for key, of in ids.items()}
    assert {bytes(row.key): row.ends_sha256 for row in hash_of_ids(rows).collect()} == wanted
