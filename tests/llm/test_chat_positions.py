"""op10: positions of messages that share a conversation and a turn, or have none."""

import json

from hushline.llm import chat_tools, queries

SCHEMA = "name string, arg string, type string, required boolean"


def test_positions_within_one_turn(spark):
    plain = [(conv, turn, "user", f"text {i:03d}") for conv in (1, None) for turn in (None, 4) for i in range(200)]
    call = json.dumps({"tool_call": {"id": "c", "name": "search", "arguments": {"query": "q", "limit": 1}}})
    result = json.dumps({"tool_result": {"id": "c", "content": "found"}})
    rows = [*plain, (1, 9, "assistant", call), (1, 2, "tool", result), (1, 9, "assistant", call)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_tools.link(df, spark.createDataFrame(queries.SCHEMAS, SCHEMA)).collect()
    text = lambda r: json.loads(r["json"]).get("content")
    for conv, more in ((1, [(9, "call", None), (2, "result", "found")]), (None, [])):
        own = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(400 + len(more)))
        want = [(turn, "message", f"text {i:03d}") for turn in (None, 4) for i in range(200)] + more
        assert [(r["turn"], r["kind"], text(r)) for r in own] == want
