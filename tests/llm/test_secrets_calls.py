import hashlib
import json
import re

from tradepost.llm import secret_scan, tool_calls

HEX = "0123456789abcdef" * 3
KEY = "A" * 20 + "b+/9" * 5
ACCESS = "AKIA" + "Q7" * 9
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
TEXTS = [
    "", None, "plain words", f"token = \"{HEX}\" é {HEX}", "secret:token : abcdefgh", "password=abc token='abcdef' x", f"🙂 {ACCESS}{'z' * 3} {KEY}",
    f"{ACCESS} at https://s3.example.com/b?x=1 and {KEY}", f"far {KEY} away" + " x" * 400 + f" {ACCESS}", f"https://lonely.example.com {'w ' * 300} {HEX}",
    f"{KEY} https://host.example.org", "API_KEY = abcdef1", "apikey:'a.b-c=d'", "tokentoken=abcdefg", f"{HEX} " * 900, "AKIA" * 5, "passwd : \"\nabcdefgh",
]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_equal_plain_matching(make_docs):
    got = secret_scan.digest(secret_scan.secret_spans(make_docs(list(enumerate(TEXTS))))).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        base = base_spans(TEXTS[r["id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in dict(zip(("assign", "access", "hex"), "abc"))] == (base.split(",") if base else [])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(base.count(k + ":") for k in ("assign", "access", "hex"))


def test_weak_parts_need_a_complement_nearby(make_docs):
    got = {r["id"]: r["spans"] for r in secret_scan.digest(secret_scan.secret_spans(make_docs(list(enumerate(TEXTS))))).collect()}
    assert "key:" in got[6] and "key:" in got[7] and "endpoint:" in got[7]
    assert "key:" not in got[8]  # out of reach
    assert "endpoint:" not in got[9]
    assert "key:" in got[10] and "endpoint:" in got[10]


def test_repeated_and_missing_ids(make_docs):
    rows = [(None, f"token={HEX}"), (None, f"token={HEX}"), (5, f"{HEX}"), (5, f"{HEX}"), (6, None)]
    got = secret_scan.digest(secret_scan.secret_spans(make_docs(rows))).collect()
    assert sorted((r["n_assign"], r["n_hex"]) for r in got) == [(0, 0), (0, 1), (0, 1), (1, 1), (1, 1)]


def test_redaction(make_docs):
    rows = list(enumerate(TEXTS))
    docs = make_docs(rows)
    got = secret_scan.redact(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        text = TEXTS[r["doc_id"]]
        if not base_spans(text):
            assert r["text"] == text or "[secret]" in r["text"]
        else:
            assert HEX not in r["text"] and ACCESS not in r["text"] and "[secret]" in r["text"]
            assert r["n_chars"] == len(r["text"])
    assert next(r["text"] for r in got.collect() if r["doc_id"] == 3) == "[secret]\" é [secret]"


def test_no_rows_no_spans(no_docs):
    assert secret_scan.secret_spans(no_docs).collect() == []
    assert secret_scan.redact(no_docs).collect() == []


CALLS = "scope int, call_id string, tool string, arguments string, needs array<string>"
RESULTS = "call_id string, content string, level string"


def run(spark, calls, results, schemas=None):
    schemas = [("f", "a", "string", True, 1.0, 3.0), ("f", "n", "integer", False, 0.0, 9.0)] if schemas is None else schemas
    tables = (spark.createDataFrame(r, s) for r, s in ((calls, CALLS), (results, RESULTS), (schemas, tool_calls.SCHEMA)))
    return tool_calls.tool_calls(*tables).collect()


def test_linking_and_validation(spark):
    arguments = ['{"n": 3, "a": "x"}', '{"a": ""}', '{"a": 1}', '{"n": 1.5, "a":"xy"}', '{"a":"x","z":{"q":1,"b":[2, 1]}}', "[1]", "no", None, '{"a":"x","a":"y"}']
    calls = [(1, f"c{i}", "f", a, []) for i, a in enumerate(arguments)]
    calls += [(1, None, "f", '{"a":"x"}', None), (1, "u", "g", "{}", ["nobody"]), (1, "c0", "f", '{"a":"x"}', [])]
    results = [("c0", "r", ""), ("c1", "b", ""), ("c1", "a", ""), (None, "lost", ""), ("x", "lost", "")]
    got = run(spark, calls, results)
    assert len(got) == len(calls)
    by = {(r["call_id"], r["arguments"]): r for r in got}
    r = by["c0", arguments[0]]
    assert (r["linked"], r["result"], r["valid"], r["problems"]) == ("ok", "r", True, [])
    assert r["json"] == '{"arguments":{"a":"x","n":3},"id":"c0","level":0,"name":"f","result":"r"}'
    assert (by["c1", arguments[1]]["linked"], by["c1", arguments[1]]["result"]) == ("repeated", "a")
    assert by["c1", arguments[1]]["problems"] == ["a: out of range"]
    assert by["c2", arguments[2]]["problems"] == ["a: not string"]
    assert by["c3", arguments[3]]["problems"] == ["n: not integer"]
    assert by["c4", arguments[4]]["problems"] == ["z: unknown"]
    assert json.loads(by["c4", arguments[4]]["json"])["arguments"] == {"a": "x", "z": {"b": [2, 1], "q": 1}}
    assert '"z":{"b":[2,1],"q":1}' in by["c4", arguments[4]]["json"]
    for i in (5, 6, 7, 8):
        assert by[f"c{i}", arguments[i]]["problems"] == ["arguments are no object"]
    assert by["c6", "no"]["json"] is None and by["c8", arguments[8]]["json"] is None
    assert by[None, '{"a":"x"}']["linked"] == "missing" and by[None, '{"a":"x"}']["level"] == 0
    assert by["u", "{}"]["problems"] == ["no such tool"] and by["u", "{}"]["level"] == 0


def test_levels_are_longest_paths(spark):
    chain = [(1, f"k{i}", "f", "{}", [f"k{i - 1}", f"k{max(0, i - 7)}"] if i else []) for i in range(60)]
    graph = [(2, "a", "f", "{}", []), (2, "b", "f", "{}", ["a"]), (2, "c", "f", "{}", ["a", "b"]), (2, "d", "f", "{}", ["c", "a", "nobody"])]
    circle = [(3, "x", "f", "{}", ["y"]), (3, "y", "f", "{}", ["x"]), (3, "z", "f", "{}", ["y", "a"]), (3, "self", "f", "{}", ["self"])]
    got = {r["call_id"]: r["level"] for r in run(spark, chain + graph + circle, [])}
    assert got == {**{f"k{i}": i for i in range(60)}, "a": 0, "b": 1, "c": 2, "d": 3, "x": None, "y": None, "z": None, "self": None}


def test_one_identifier_in_two_chats(spark):
    calls = spark.createDataFrame([(i, "call_1", "f", '{"a":"x"}', ["call_0"]) for i in (1, 2, None)] + [(2, "call_0", "f", "{}", None)], CALLS)
    results = spark.createDataFrame([(1, "call_1", "one"), (2, "call_1", "two"), (None, "call_1", "none"), (3, "call_1", "lost")], "scope int, call_id string, content string")
    schemas = spark.createDataFrame([], tool_calls.SCHEMA)
    got = tool_calls.tool_calls(calls, results, schemas, "scope").collect()
    assert {(r["scope"], r["call_id"]): (r["linked"], r["n_results"], r["result"], r["level"]) for r in got} == {
        (1, "call_1"): ("ok", 1, "one", 0), (2, "call_1"): ("ok", 1, "two", 1), (None, "call_1"): ("ok", 1, "none", 0), (2, "call_0"): ("missing", 0, None, 0),
    }
    assert [r["content"] for r in tool_calls.orphans(results, calls, "scope").collect()] == ["lost"]
    assert {r["n_results"] for r in tool_calls.tool_calls(calls, results, schemas).collect()} == {4, 0}


def test_a_small_circle_among_many_calls_takes_few_rounds(spark, monkeypatch):
    chain = [(1, f"k{i}", "f", "{}", [f"k{i - 1}"] if i else []) for i in range(900)]
    circle = [(1, "x", "f", "{}", ["y", "z"]), (1, "y", "f", "{}", ["x"]), (1, "z", "f", "{}", ["k50"]), (1, "w", "f", "{}", ["y"]), (1, "v", "f", "{}", ["z"])]
    rounds, cut = [], tool_calls.Scratch.cut
    monkeypatch.setattr(tool_calls.Scratch, "cut", lambda self, df: rounds.append("to" in df.columns) or cut(self, df))
    got = {r["call_id"]: r["level"] for r in run(spark, chain + circle, [])}
    assert got == {**{f"k{i}": i for i in range(900)}, "z": 51, "v": 52, "x": None, "y": None, "w": None}
    assert sum(rounds) < 15


def test_columns_with_names_of_new_ones_are_replaced(spark):
    columns = ", ".join(f"{n} string" for n in (*tool_calls.NEW, "_level", "extra"))
    calls = spark.createDataFrame([(1, "c", "f", '{"a":"x"}', ["c0"], *"abcdefghi"), (1, "c0", "f", '{"a":"x"}', None, *"abcdefghi")], f"{CALLS}, {columns}")
    results = spark.createDataFrame([("c", "r", "q")], RESULTS)
    got = tool_calls.tool_calls(calls, results, spark.createDataFrame([], tool_calls.SCHEMA)).collect()
    assert {r["call_id"]: (r["result"], r["n_results"], r["linked"], r["level"], r["extra"]) for r in got} == {"c": ("r", 1, "ok", 1, "i"), "c0": (None, 0, "missing", 0, "i")}
    assert all(r["valid"] is False and r["problems"] == ["no such tool"] and r["json"].startswith("{") for r in got)


def test_long_texts_and_ties(spark):
    long = "x" * 300_000
    got = run(spark, [(1, "c", "f", json.dumps({"a": long}), None)] * 2, [("c", long, ""), ("c", long, "")])
    assert [(r["linked"], r["result"] == long, r["problems"]) for r in got] == [("repeated", True, ["a: out of range"])] * 2


def test_no_calls(spark):
    assert run(spark, [], [("c", "r", "")]) == []
    assert run(spark, [(1, "c", "f", "{}", None)], [], [])[0]["problems"] == ["no such tool"]


def test_orphans(spark):
    results = spark.createDataFrame([("c", "r", ""), ("o", "q", ""), (None, "n", "")], RESULTS)
    calls = spark.createDataFrame([(1, "c", "f", "{}", None)], CALLS)
    assert sorted(r["content"] for r in tool_calls.orphans(results, calls).collect()) == ["n", "q"]
