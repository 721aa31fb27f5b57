"""Held-out accuracy of the toxicity chain; tool-call linking against plain code."""

import json
import random

import numpy as np
import pytest
from test_contracts import SF, frame, hostile

from hushline.llm import chat_tools, queries, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    return docs.select("doc_id", "text", "quality", "toxic").orderBy("doc_id").collect()


def test_held_out_accuracy(labelled):
    train = [r for r in labelled if r["doc_id"] % 4]
    test = [r for r in labelled if not r["doc_id"] % 4]
    targets = np.array([[r["quality"] == 0, r["toxic"] == 1] for r in train], int)
    chain = toxicity.train_chain([r["text"].encode() for r in train], targets, np.arange(len(train)) % 4, ["low_quality", "toxic"])
    p = chain.probabilities(chain.rows([r["text"].encode() for r in test]))[:, -1] >= 0.5
    truth = np.array([r["toxic"] == 1 for r in test])
    assert p[truth].mean() > 0.85 and p[~truth].mean() < 0.01


def test_chain_feeds_earlier_probabilities():
    rnd = random.Random(1)
    texts, targets = [], []
    for _ in range(600):
        a = rnd.random() < 0.4
        texts.append(" ".join(rnd.choices("alpha beta gamma delta".split(), k=5) + (["bad"] if a else [])).encode())
        targets.append([a, a and rnd.random() < 0.9])
    chain = toxicity.train_chain(texts, np.array(targets, int), np.arange(600) % 4, ["one", "two"])
    assert len(chain.models[0].earlier) == 0 and chain.models[1].earlier[0] > 0


def test_toxicity_hostile(spark):
    docs = frame(spark, hostile(8))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.detect(docs, none, queries.CATEGORIES).collect()
    assert len(got) == docs.count() and not any(r["toxic"] for r in got)
    few = spark.createDataFrame([(1, None, None), (1, 0, 1), (7, 1, 0), (999_999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.detect(docs, few, queries.CATEGORIES).count() == docs.count()
    assert toxicity.detect(docs.limit(0), few, queries.CATEGORIES).count() == 0


def test_op1(spark):
    rows = queries.op1_toxicity(spark, SF).collect()
    assert len(rows) == 200 and all(0 <= r["p_toxic"] <= 1 for r in rows)


def plain_link(messages):
    """Positions and states of distinct messages of one conversation table."""
    out = {}
    by_conv = {}
    for m in set(messages):
        by_conv.setdefault(m[0], []).append(m)
    low = lambda v: (v is not None, v if v is not None else 0)
    for conv, rows in by_conv.items():
        first = {}
        info = {}
        for m in rows:
            _, turn, role, text = m
            kind = ident = after = None
            try:
                value = json.loads(text) if text and text.lstrip(" ").startswith("{") else {}
            except ValueError:
                value = {}
            call, result = value.get("tool_call") or {}, value.get("tool_result") or {}
            if role == "assistant" and call.get("id") is not None and call.get("name") is not None:
                kind, ident, after = "call", str(call["id"]), call.get("after")
            elif role == "tool" and result.get("id") is not None:
                kind, ident = "result", str(result["id"])
            info[m] = (kind, ident, after)
            if kind and ((kind, ident) not in first or (low(turn), text) < (low(first[kind, ident][1]), first[kind, ident][3])):
                first[kind, ident] = m

        def up(m):
            kind, ident, after = info[m]
            if kind == "result":
                return first.get(("call", ident))
            return (first.get(("result", after)) or first.get(("call", after))) if after is not None else None

        for m in rows:
            kind, ident, _ = info[m]
            late, depth, status = m[1], 0, None
            if kind:
                if first[kind, ident] != m:
                    status = "duplicate"
                else:
                    seen, at = set(), m
                    while at is not None and at not in seen:
                        seen.add(at)
                        at = up(at)
                    if at is not None:
                        status = "cyclic"
                    else:
                        depth = len(seen) - 1
                        late = max((x[1] for x in seen if x[1] is not None), default=None)
                        other = first.get(("result" if kind == "call" else "call", ident))
                        status = ("answered" if other else "unanswered") if kind == "call" else ("linked" if other else "orphan")
            out[m] = (kind or "message", ident, status, (conv, late, depth))
    return out


def envelope(kind, ident, after=None, **arguments):
    body = {"id": ident, "name": "search", "arguments": arguments} | ({"after": after} if after else {}) if kind == "call" else {"id": ident, "content": arguments}
    return json.dumps({"tool_call" if kind == "call" else "tool_result": body})


SCHEMA = "name string, arg string, type string, required boolean"


def test_linking_against_plain_code(spark):
    rnd = random.Random(4)
    messages = []
    for conv in [*range(12), None]:
        for turn in range(rnd.randint(1, 25) if conv != 3 else 120):
            ident = f"c{rnd.randint(0, 12)}"
            after = f"c{rnd.randint(0, 12)}" if rnd.random() < 0.6 else None
            pick = rnd.random()
            if pick < 0.4:
                messages.append((conv, turn, "assistant", envelope("call", ident, after, query="x", limit=turn)))
            elif pick < 0.8:
                messages.append((conv, rnd.randint(-2, turn), "tool", envelope("result", ident, b=1, a=[1, {"z": 1, "y": None}])))
            else:
                messages.append((conv, turn if rnd.random() < 0.9 else None, rnd.choice(["user", None, "tool"]), rnd.choice(["hi", None, "", "{broken", '{"a": 1}', "é\n\"q\""])))
    messages += messages[:10]
    df = spark.createDataFrame([(*m, 1) for m in messages], "conv_id long, turn long, role string, text string, id int")
    schemas = spark.createDataFrame(queries.SCHEMAS, SCHEMA)
    rows = chat_tools.link(df, schemas).collect()
    want = plain_link(messages)
    count = lambda values: sorted(map(repr, values))
    assert count((r["conv_id"], r["turn"], r["kind"], r["id"], r["status"]) for r in rows) == count((m[0], m[1], w[0], w[1], w[2]) for m, w in want.items())
    for conv in {m[0] for m in messages}:
        own = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        key = lambda w: (w[3][1] is not None, w[3][1] or 0, w[3][2])
        expected = sorted((key(w), (m[1], w[0], w[1])) for m, w in want.items() if m[0] == conv and m[1] is not None)
        places = {}
        for k, v in expected:
            places.setdefault(v, []).append(k)
        ranks = [min(places[r["turn"], r["kind"], r["id"]]) for r in own if (r["turn"], r["kind"], r["id"]) in places and len(places[r["turn"], r["kind"], r["id"]]) == 1]
        assert ranks == sorted(ranks)
    for r in rows:
        value = json.loads(r["json"])
        assert r["json"] == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert chat_tools.link(df.limit(0), schemas).count() == 0


def test_arguments(spark):
    cases = [
        ({"query": "a", "limit": 3}, []), ({"query": "a"}, ["missing limit"]), ({"query": 1, "limit": 3}, ["query is no string"]),
        ({"query": "a", "limit": "3", "more": 1}, ["limit is no integer", "unexpected more"]), ({"query": None, "limit": 2.5}, ["limit is no integer", "query is no string"]),
    ]
    rows = [(1, i, "assistant", envelope("call", str(i), **a)) for i, (a, _) in enumerate(cases)]
    rows.append((1, 99, "assistant", json.dumps({"tool_call": {"id": "x", "name": "search", "arguments": [1]}})))
    rows.append((1, 100, "assistant", json.dumps({"tool_call": {"id": "y", "name": "nothing", "arguments": {}}})))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r["errors"] for r in chat_tools.link(df, spark.createDataFrame(queries.SCHEMAS, SCHEMA)).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    assert got[99] == ["missing limit", "missing query"] and got[100] == ["unknown tool"]


def test_op10(spark):
    rows = queries.op10_chat_tools(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/conversations.parquet").count()
    assert {"answered", "linked"} <= {r["status"] for r in rows}
