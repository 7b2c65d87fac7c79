import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from strataquery.llm import components, conversations

SCHEMA = "id string, aliases array<string>, related array<string>, advisory_id string, group_id int, u string"


def brute_groups(data):
    import re

    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def name(x):
        x = (x or "").strip().upper()
        return x if re.search("[0-9]", x) else None

    for i, a, r in data:
        u = i.strip().upper()
        find(u)
        for x in (a or []) + (r or []):
            if name(x) and name(u):
                parent[find(u)] = find(name(x))
    ids = {i.strip().upper() for i, _, _ in data}
    by = {}
    for i in ids:
        by.setdefault(find(i), []).append(i)
    return sorted(((i, min(v)) for v in by.values() for i in v), key=repr)


def run(spark, scratch, data):
    return rows(components.advisory_groups(spark.createDataFrame([(*d, "x", 1, None) for d in data], SCHEMA), scratch))


def test_edges_of_the_definition(spark, scratch):
    data = [("b1", [" A1\n", None, "", "none"], None), ("A1", None, []), ("a2", ["z9"], None), ("c3", None, ["Z9 "]), ("junk", ["A1"], None), ("d4", ["n/a", "pending"], ["N/A"]), ("e5", ["n/a"], None), ("d4", ["f6"], None), ("f6", [], []), ("g7", ["g7"], None)]
    assert run(spark, scratch, data) == brute_groups(data)
    assert ("JUNK", "JUNK") in run(spark, scratch, data)


def test_empty(spark, scratch):
    assert run(spark, scratch, []) == []
    assert run(spark, scratch, [("a1", None, None)]) == [("A1", "A1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_union_find(spark, scratch, seed):
    rng = random.Random(seed)
    data = [(f"n{rng.randrange(400)}", [f"n{rng.randrange(700)}" for _ in range(rng.choice([0, 0, 1, 2]))], None) for _ in range(500)]
    data += [(f"m{i}", [f"m{i + 1}"], None) for i in range(120)]  # a chain
    data += [(f"h{i}", ["hub1"], None) for i in range(200)]  # a star
    assert run(spark, scratch, data) == brute_groups(data)


def test_heavy_vertices_are_salted(spark, scratch, monkeypatch):
    from strataquery.operators import skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    monkeypatch.setattr(skew, "SHARE", 16)
    data = [(f"h{i}", ["hub1"], None) for i in range(300)] + [(f"k{i}", [f"k{i // 2}"], None) for i in range(1, 60)]
    assert run(spark, scratch, data) == brute_groups(data)


T0 = dt.datetime(2025, 1, 1)
MSG = "id long, conversation_id string, role string, text string, status string, error string, created_at timestamp, turn int, message_id long, c string"


def msg(i, c, role, minute, text="t", status="complete"):
    return (i, c, role, text, status, "", None if minute is None else T0 + dt.timedelta(minutes=minute), 7, 8, "clash")


def rebuilt(spark, scratch, data, **kw):
    got = conversations.rebuild(spark.createDataFrame(data, MSG), scratch, **kw)
    return rows(got.select("conversation_id", "turn", "message_id"))


def test_whole_conversations(spark, scratch):
    data = [
        msg(4, "a", " User", 3, status=None), msg(3, "a", "ASSISTANT ", 2, status=" Complete"), msg(2, "a", "user", 1, status=""), msg(9, "a", "assistant", 4), msg(9, "a", "assistant", 4),
        msg(11, "tie", "user", 1), msg(12, "tie", "assistant", 1), msg(14, "bad tie", "user", 1), msg(13, "bad tie", "assistant", 1),
        msg(20, "odd", "user", 1), msg(21, "start", "assistant", 1), msg(22, "start", "user", 2), msg(23, "two", "user", 1), msg(24, "two", "user", 2), msg(25, "two", "assistant", 3), msg(26, "two", "assistant", 4),
        msg(30, "blank", "user", 1, text=" \n"), msg(31, "blank", "assistant", 2), msg(32, "null", "user", 1, text=None), msg(33, "null", "assistant", 2), msg(34, "time", "user", None), msg(35, "time", "assistant", 2),
        msg(36, "stat", "user", 1, status="failed"), msg(37, "stat", "assistant", 2), msg(38, "role", "user", 1), msg(39, "role", "assistant", 2), msg(40, "role", "system", 3), msg(41, "role", None, 4),
        msg(50, None, "user", 1), msg(51, None, "assistant", 2), msg(52, "", "user", 1), msg(53, "", "assistant", 2),
    ]
    want = [("a", 1, 2), ("a", 2, 3), ("a", 3, 4), ("a", 4, 9), ("tie", 1, 11), ("tie", 2, 12)]
    assert rebuilt(spark, scratch, data) == sorted(want, key=repr)
    assert rebuilt(spark, scratch, []) == []


def test_skewed_clocks(spark, scratch):
    # The assistant's clock is 30 minutes behind; every reply would come first.
    data = [msg(1, "s", "user", 100), msg(2, "s", "assistant", 71), msg(3, "s", "user", 110), msg(4, "s", "assistant", 81)]
    assert rebuilt(spark, scratch, data) == []
    fixed = conversations.rebuild(spark.createDataFrame(data, MSG), scratch, max_offset_us=3_600_000_000)
    assert rows(fixed.select("turn", "message_id")) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert fixed.first().offset_us == 29 * 60_000_000
    # Bounds that cross: no offset fits.
    clash = [msg(i, "s", role, at) for i, (role, at) in enumerate([("user", 0), ("user", 1), ("user", 2), ("assistant", 0), ("assistant", 100), ("assistant", 101)])]
    assert rebuilt(spark, scratch, clash, max_offset_us=10**12) == []


def test_conversations_against_brute_force(spark, scratch):
    rng = random.Random(3)
    data, n = [], 0
    for c in range(150):
        clock = 0
        for k in range(rng.choice([0, 1, 2, 2, 4, 4, 6])):
            n += 1
            clock += rng.choice([0, 1, 1, 2])
            role = ("user", "assistant")[k % 2] if rng.random() > 0.05 else rng.choice(["user", "assistant", "tool"])
            data.append(msg(n if rng.random() > 0.1 else n + 5000, f"c{c}", role, clock, "t" if rng.random() > 0.03 else " "))
    rng.shuffle(data)
    want = []
    for c in {d[1] for d in data}:
        v = sorted({(d[6], d[0], d[2], d[3]) for d in data if d[1] == c})
        if len(v) % 2 == 0 and all(m[2] == ("user", "assistant")[i % 2] and m[3].strip() for i, m in enumerate(v)):
            want += [(c, i + 1, m[1]) for i, m in enumerate(v)]
    assert rebuilt(spark, scratch, data) == sorted(want, key=repr)


def test_skewed_clocks_are_corrected(spark, scratch):
    """Answering clocks that are off by up to minutes: every order comes back, with each sender moved by half."""
    rng, data, nth = random.Random(8), [], 0
    for c in range(40):
        off, at = rng.randrange(-300, 300), 1_000_000 + c * 10_000
        for turn in range(1, 9):
            at += rng.randrange(1, 20)
            nth += 1
            answer = turn % 2 == 0
            data.append((f"c{c:02}", nth * 7919 % 10_007, "assistant" if answer else "user", "x", None, at - (off if answer else 0), turn))
    df = spark.createDataFrame([d[:6] for d in data], "conversation_id string, id long, role string, text string, status string, s long").withColumn("created_at", F.timestamp_seconds("s"))
    got = {(r.conversation_id, r.message_id): (r.turn, r.at_us) for r in conversations.rebuild(df, scratch, 600_000_000).collect()}
    assert {k: v[0] for k, v in got.items()} == {(d[0], d[1]): d[6] for d in data}
    by_conversation = {}
    for (c, _), (turn, at) in got.items():
        by_conversation.setdefault(c, []).append((turn, at))
    assert all(a[1] <= b[1] for turns in by_conversation.values() for a, b in zip(sorted(turns), sorted(turns)[1:]))
    # Least squares: half of the smallest difference that fits falls to each sender.
    one = [d for d in data if d[0] == "c03"]
    asks, answers = [d[5] for d in one[::2]], [d[5] for d in one[1::2]]
    low, high = max((q - a) * 10**6 for q, a in zip(asks, answers)), min((q - a) * 10**6 for q, a in zip(asks[1:], answers))
    assert len({r.offset_us for r in conversations.rebuild(df, scratch, 600_000_000).filter("conversation_id = 'c03'").collect()} & set(range(low, high + 2))) == 1
