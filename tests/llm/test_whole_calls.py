"""Derived calls carry whole texts."""

import json
import random

from freshet.llm import tool_calls


def test_calls_carry_whole_texts(spark):
    same = "x" * 40
    texts = [same + "first" + " " * 15 + "é\"\\", same + "other" + "." * 50, "short", "", "y" * 61, "z" * 5000, "odd one", "four"] + ["q" * n for n in range(50, 66)]
    rows = [(1, 2 * i + 1, "assistant", t) for i, t in enumerate(texts)] + [(1, 99, "assistant", None)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results, refs, _ = tool_calls.calls_of_turns(conversations)
    got = {r.turn: r for r in tool_calls.link_tool_calls(calls, results, refs, tool_calls.TOOLS).collect()}
    for _, turn, _, text in rows:
        args = json.loads(got[turn].line)["arguments"]
        assert args.get("query", args.get("text")) == (text or ""), turn
        searches = got[turn].name == "search"
        assert got[turn].errors == ("unknown tool" if got[turn].name == "unknown" else "limit: missing" if searches and len(text) < 60 else "")
    assert {r.name for r in got.values()} == {"search", "summarise", "unknown"} and {r.errors for r in got.values()} >= {"", "limit: missing"}


def test_turns_that_are_calls_and_context(spark):
    """Calls given as JSON are taken as they are; system turns and turns of no known role stay as context."""
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "assistant", '{"id": "z9", "name": "search", "arguments": {"query": "q", "limit": 2}}'), (1, 2, "tool", '{"call_id": "z9", "content": "found"}'),
        (1, 3, "assistant", '{"id": "z8", "name": "search", "arguments": {"after": "z9", "query": 1}}'), (1, 4, "user", "thanks"), (1, 5, "assistant", "{not json"), (1, 6, None, None), (1, 7, "robot", "x" * 300_000),
    ]
    calls, results, refs, context = tool_calls.calls_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.turn: r for r in tool_calls.link_tool_calls(calls, results, refs, tool_calls.TOOLS, context).collect()}
    assert len(got) == 7 and got[1].line == '{"arguments":{"limit":2,"query":"q"},"id":"z9","name":"search","result":{"content":"found","turn":2}}' and got[1].level == 0
    assert got[3].level == 1 and got[3].errors == "query: not string; limit: missing" and got[3].status == "no_result"
    assert got[5].call_id == "call_5" and got[4].status == "orphan"
    assert [(got[i].status, got[i].valid, json.loads(got[i].line)) for i in (0, 6, 7)] == [("context", True, {"content": "be brief", "role": "system"}), ("context", True, {"content": ""}), ("context", True, {"content": "x" * 300_000, "role": "robot"})]


def test_levels_equal_longest_paths(spark):
    """Random graphs with chains, joints and cycles, against plain longest paths."""
    r = random.Random(8)
    calls, refs = [], []
    for conv in range(12):
        n = r.randint(1, 40)
        calls += [(conv, f"c{i}") for i in range(n)]
        for i in range(1, n):
            refs += [(conv, f"c{i}", f"c{max(0, i - r.choice([1, 1, 1, 2, 5]))}") for _ in range(r.choice([0, 1, 1, 1, 1, 2, 3]))]
        if conv % 4 == 0 and n > 3:
            refs.append((conv, "c0", f"c{r.randrange(1, n)}"))
    ups = {}
    for conv, a, b in refs:
        ups.setdefault((conv, a), set()).add((conv, b))
    level, changed = {}, True
    while changed:
        changed = False
        for x in calls:
            if x not in level and all(u in level for u in ups.get(x, ())):
                level[x], changed = max((level[u] + 1 for u in ups.get(x, ())), default=0), True
    got = tool_calls.call_levels(spark.createDataFrame(calls, "conv_id long, call_id string"), spark.createDataFrame(refs, "conv_id long, call_id string, ref string"))
    assert {(x.conv_id, x.call_id): x.level for x in got.collect()} == level and len(level) < len(calls)


def _longest(calls, refs):
    """Level of each call that has one, in plain Python."""
    ups, level = {}, {}
    for conv, a, b in refs:
        ups.setdefault((conv, a), set()).add((conv, b))
    changed = True
    while changed:
        changed = False
        for conv, a, _ in calls:
            if (conv, a) not in level and all(u in level for u in ups.get((conv, a), ())):
                level[conv, a], changed = max((level[u] + 1 for u in ups.get((conv, a), ())), default=0), True
    return level


def _levels(spark, calls, refs):
    got = tool_calls.call_levels(spark.createDataFrame(calls, "conv_id long, call_id string, turn long"), spark.createDataFrame(refs, "conv_id long, call_id string, ref string"))
    return {(x.conv_id, x.call_id): x.level for x in got.collect()}


def test_two_references_at_every_call(spark):
    """A conversation of 2000 calls, each referring to the two before it, beside short ones: rounds follow the logarithm."""
    calls = [(1, f"call_{i}", 2 * i) for i in range(2000)] + [(2, "call_0", -3), (2, "call_1", 4), (3, "a", 1)]
    refs = [(1, f"call_{i}", f"call_{i - d}") for i in range(2000) for d in (1, 2) if i >= d] + [(2, "call_1", "call_0"), (2, "call_1", "none"), (3, None, "a")]
    assert _levels(spark, calls, refs) == {**{(1, f"call_{i}"): i for i in range(2000)}, (2, "call_0"): 0, (2, "call_1"): 1, (3, "a"): 0}


def test_levels_by_turn_with_forward_references_and_cycles(spark):
    """Random references, most of them to earlier turns, some forward, some in cycles, and calls of one turn or none."""
    r = random.Random(3)
    calls, refs = [], []
    for conv in range(10):
        n = r.randint(1, 60)
        calls += [(conv, f"c{i}", None if r.random() < 0.02 else i - i % 3 if conv % 2 else i) for i in range(n)]
        for i in range(1, n):
            refs += [(conv, f"c{i}", f"c{max(0, i - r.choice([1, 1, 2, 2, 4, 9, 30]))}") for _ in range(r.choice([0, 1, 2, 2, 3]))]
        if conv % 3 == 0 and n > 8:
            refs += [(conv, f"c{n // 2}", f"c{n // 2 + 2}"), (conv, "c3", "c3")]
        if conv % 3 == 1 and n > 8:
            calls.append((conv, "late", 10_000))
            refs += [(conv, "c1", "late"), (conv, "late", "c0")]
    want = _longest(calls, refs)
    assert _levels(spark, calls, refs) == want and 0 < len(want) < len({(c, a) for c, a, _ in calls})
