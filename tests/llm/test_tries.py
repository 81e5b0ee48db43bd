import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from llm.helpers import clashing

from siftstone.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes by their definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends, paths = defaultdict(list), defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - int(abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(lender, [])[:h] + own[c][h:])
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
        ends[paths[c]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), children[n], leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n in members
    )


def conversations(seed, count=60, most=20):
    """Conversations that go along with each other for a while, some of them whole copies or beginnings."""
    random_ = random.Random(seed)
    trunk = [("user" if i % 2 else "assistant", f"turn {i} é" * random_.randrange(3)) for i in range(most)]
    rows = []
    for c in random_.sample(range(-40, 300), count):
        shared = random_.randrange(most + 1)
        turns = trunk[:shared] + [(random_.choice("ab"), random_.choice(["x", "yy", ""])) for _ in range(random_.randrange(4))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    return rows


def found(spark, rows, **parameters):
    frame = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    return sorted(map(tuple, tries.prefix_trie(frame, **parameters).collect()))


@pytest.mark.parametrize("block", [1, 3, 8])
def test_brute_force(spark, block):
    rows = conversations(block)
    assert found(spark, rows, block=block) == brute(rows)


def test_long_conversations(spark, monkeypatch):
    """Paths carried through windows of two blocks, turns numbered in several ranges, and more members than one string of ids holds."""
    from siftstone.operators import ordered

    monkeypatch.setattr(tries, "CHAIN", 2)
    monkeypatch.setattr(tries, "SPAN_BITS", 2)
    monkeypatch.setattr(ordered, "TASK_ROWS", 100)
    rows = [(c, i, "user", f"{i % 7}") for c in (5, 6, 7, 9) for i in range(150 + c % 2)] + [(c, 0, "user", "0") for c in range(100, 160)]
    assert found(spark, rows, block=2) == brute(rows)


def test_odd_tables(spark):
    assert found(spark, []) == []
    rows = [(None, 1, "a", "b"), (3, None, None, "x"), (3, None, "r", None), (3, 1, "r", "y"), (3, 1, "q", "y"), (3, 1, "q", "y"), (4, 2, None, None), (-7, 0, "u", "z" * 200_000)]
    assert found(spark, rows) == brute(rows)
    # no turn is left to a conversation whose lender is absent and which is not longer than what it gives up
    alone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(alone, 0, "u", "a"), (alone, 1, "u", "b")]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 1
