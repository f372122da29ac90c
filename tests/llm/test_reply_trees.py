"""Reply trees against a recursive walk, and edge cases."""

import random

from sparkfeat.llm import reply_trees as rt

SCHEMA = "tree long, node string, parent string, role string, text string, score double, leaf int"


def brute(rows):
    out = {}
    for tree in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == tree}
        kids = {}
        for r in mine.values():
            kids.setdefault(r[2], []).append(r[1])

        def walk(n, path):
            path = [*path, n]
            if n not in kids:
                out[(tree, n)] = path
            for k in kids.get(n, []):
                walk(k, path)

        for root in kids.get(None, []):
            walk(root, [])
    return out


def test_paths_and_ranks(spark):
    r = random.Random(5)
    rows = []
    for tree in range(15):
        for k in range(r.randint(1, 25)):
            rows.append((tree, f"n{k:02}", f"n{r.randrange(k):02}" if k and r.random() < 0.9 else None, r.choice(["user", "assistant"]), f"t{tree}.{k}", float(r.randrange(4)), 0))
    got = rt.conversations_of(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    by = {(x[0], x[1]): x for x in rows}
    assert {(g.conv_id, g.leaf) for g in got} == set(want)
    for g in got:
        path = [by[(g.conv_id, n)] for n in want[(g.conv_id, g.leaf)]]
        assert g.text == "".join(f"<|im_start|>{x[3]}\n{x[4]}<|im_end|>\n" for x in path)
        assert abs(g.score - sum(x[5] for x in path) / len(path)) < 1e-8
    for tree in range(15):
        mine = sorted((g for g in got if g.conv_id == tree), key=lambda g: g.rank)
        assert [g.rank for g in mine] == list(range(1, len(mine) + 1))
        assert mine == sorted(mine, key=lambda g: (-g.score, g.n_messages, g.leaf))
    assert rt.conversations_of(spark.createDataFrame(rows, SCHEMA), keep=1).count() == 15


def test_odd_messages(spark):
    rows = [(1, "a", None, None, None, None, 0), (1, "a", None, None, None, None, 0), (1, "b", "gone", "user", "x", 1.0, 0), (1, "c", "d", "user", "x", 1.0, 0), (1, "d", "c", "user", "x", 1.0, 0), (1, "e", "e", "user", "x", 1.0, 0), (None, "a", None, "user", "x", 1.0, 0), (2, None, None, "user", "x", 1.0, 0)]
    got = rt.conversations_of(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(g.conv_id, g.leaf, g.text, g.score) for g in got] == [(1, "a", "<|im_start|>\n<|im_end|>\n", 0.0)]
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 5, "assistant", "b" * 200000), (1, 5, "assistant", "a"), (1, 7, None, None), (None, 1, "user", "x"), (2, None, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {g.leaf: g.n_messages for g in rt.conversations_of(rt.messages(turns)).collect()}
    assert got == {"2/2": 2, "3/1": 3}
    assert rt.conversations_of(rt.messages(turns.limit(0))).count() == 0


def test_deep_trees_circles_and_a_hot_tree(spark):
    rows = [(1, f"n{k:04}", f"n{k - 1:04}" if k else None, "user", f"{k}", 1.0, 0) for k in range(700)]  # a chain, and a side branch at every hundredth message
    rows += [(1, f"s{k:04}", f"n{k:04}", "user", "side", 0.5, 0) for k in range(0, 690, 100)]
    rows += [(2, f"c{k}", f"c{(k + 1) % 5}", "user", "circle", 1.0, 0) for k in range(5)]
    rows += [(2, f"h{k}", f"c{k}", "user", "hangs on a circle", 1.0, 0) for k in range(5)]
    rows += [(3, "o1", "gone", "user", "orphan", 1.0, 0), (3, "o2", "o1", "user", "its reply", 1.0, 0)]
    rows += [(4, "root", None, "user", "q", 2.0, 0), *((4, f"r{k:03}", "root", "assistant", f"a{k}", float(k % 7), 0) for k in range(400))]
    got = rt.conversations_of(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(g.conv_id, g.leaf): g.n_messages for g in got} == {(1, "n0699"): 700} | {(1, f"s{k:04}"): k + 2 for k in range(0, 690, 100)} | {(4, f"r{k:03}"): 2 for k in range(400)}
    assert next(g for g in got if g.leaf == "n0699").text == "".join(f"<|im_start|>user\n{k}<|im_end|>\n" for k in range(700))
    hot = sorted((g for g in got if g.conv_id == 4), key=lambda g: g.rank)
    assert [g.rank for g in hot] == list(range(1, 401)) and hot == sorted(hot, key=lambda g: (-g.score, g.leaf))
