import json

from pyspark.sql import functions as F

from loomlog.operators import transcripts as tr
from loomlog.sources import readers

LINES = [
    {"type": "custom-title", "customTitle": "Sorting the attic", "sessionId": "k7"},
    {"type": "user", "message": {"content": "where do the boxes go?"}},
    {"type": "assistant", "message": {"content": [{"type": "text", "text": "on the left shelf"}]}},
]


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")
    return str(path)


def load(spark, path):
    return tr.real_user_message(readers.read_transcripts(spark, path))


def last_turn(entries):
    return {r["session_id"]: r["text"] for r in tr.last_assistant_turn(entries, tr.text_pieces(entries)).collect()}


def test_title_and_answer(spark, tmp_path):
    e = load(spark, write(tmp_path, "k7.jsonl", LINES))
    assert last_turn(e) == {"k7": "on the left shelf"}
    assert tr.session_titles(e).collect()[0]["title"] == "Sorting the attic"


def test_dated_copies_of_a_session(spark, tmp_path):
    for day, n in (("2026-04-01", 2), ("2026-04-02", 3)):
        (tmp_path / day).mkdir()
        write(tmp_path, f"{day}/080000_k7.jsonl", LINES[:n])
    lines = readers.read_transcripts(spark, str(tmp_path))
    assert lines.count() == 5 and lines.select("file", "line_no").distinct().count() == 5
    assert sorted(str(r["log_date"]) for r in lines.select("log_date").distinct().collect()) == ["2026-04-01", "2026-04-02"]
    assert last_turn(tr.real_user_message(readers.latest_copies(lines))) == {"k7": "on the left shelf"}


def test_malformed_blank_and_non_object_lines(spark, tmp_path):
    e = load(spark, write(tmp_path, "a_s1.jsonl", [LINES[1], "", "{bad", "[1]", "7", "   ", LINES[2]]))
    assert e.count() == 5
    assert e.filter("is_entry").count() == 2
    assert [r["session_id"] for r in e.select("session_id").distinct().collect()] == ["s1"]


def test_line_separator_inside_json_does_not_split(spark, tmp_path):
    text = json.dumps({"type": "user", "message": {"content": "a\u2028b"}}, ensure_ascii=False)
    e = load(spark, write(tmp_path, "s.jsonl", [text]))
    assert e.filter("is_entry").count() == 1


def test_real_user_message(spark, tmp_path):
    def user(content, **more):
        return {"type": "user", "message": {"content": content}, **more}
    cases = [(user("hi"), True), (user("  \n"), False), (user([{"type": "text", "text": "x"}]), True),
             (user([{"type": "text", "text": "x"}, {"type": "tool_result", "tool_use_id": "t"}]), False),
             (user([{"type": "text", "text": "  "}]), False), (user(["bare", {"type": "text", "text": "x"}]), True),
             (user(5), False), (user([]), False), ({"type": "user"}, False)]
    e = load(spark, write(tmp_path, "s.jsonl", [c for c, _ in cases]))
    got = [r["is_real_user"] for r in e.orderBy("line_no").collect()]
    assert got == [want for _, want in cases]


def test_last_turn_plans_sidechains_and_strings(spark, tmp_path):
    def said(*blocks, **more):
        return {"type": "assistant", "message": {"content": list(blocks)}, **more}
    plan = {"type": "tool_use", "name": "ExitPlanMode", "input": {"plan": "do it"}}
    empty = {"type": "tool_use", "name": "ExitPlanMode", "input": {"plan": ""}}
    e = load(spark, write(tmp_path, "s.jsonl", [
        said({"type": "text", "text": "early"}), LINES[1], said({"type": "text", "text": "one"}, "bare", plan, empty),
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t"}]}},
        said({"type": "text", "text": "hidden"}, isSidechain=True), {"type": "assistant", "message": {"content": "two"}},
        said({"type": "tool_use", "id": "t", "name": "Read", "input": {}})]))
    assert last_turn(e) == {"s": "one\n\n**[Plan]**\n\ndo it\n\ntwo"}


def test_no_user_message_gives_nothing(spark, tmp_path):
    assert last_turn(load(spark, write(tmp_path, "s.jsonl", [LINES[2]]))) == {}


def test_a_turn_is_one_row_however_files_are_split(spark, tmp_path):
    many = [{"type": "assistant", "message": {"content": f"t{i} " + "x" * 40_000}} for i in range(6)]
    path = write(tmp_path, "s.jsonl", [LINES[1], *many])
    whole = last_turn(load(spark, path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        e = load(spark, path)
        assert e.rdd.getNumPartitions() > 2
        rows = tr.last_assistant_turn(e, tr.text_pieces(e)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["session_id"], r["text"]) for r in rows] == list(whole.items())
    assert whole["s"] == "\n\n".join(f"t{i} " + "x" * 40_000 for i in range(6))


def test_filter_modes(spark, tmp_path):
    plan = {"type": "tool_use", "id": "p", "name": "ExitPlanMode", "input": {"plan": "x"}}
    call = {"type": "tool_use", "id": "t", "name": "Read", "input": {"p": 1}}
    result = {"type": "tool_result", "tool_use_id": "t", "content": "out"}
    entry = {"type": "assistant", "uuid": "u", "message": {"role": "assistant", "content": [
        {"type": "thinking", "thinking": "h"}, plan, call, "bare", result]}}
    e = load(spark, write(tmp_path, "s.jsonl", [entry, LINES[1], "{bad"]))

    def run(mode):
        rows = tr.filter_tool_blocks(e, mode).orderBy("line_no").collect()
        return [r["sanitized"] for r in rows]
    kept = json.loads(run("none")[0])
    assert kept["uuid"] == "u" and kept["message"]["role"] == "assistant"
    assert kept["message"]["content"] == [entry["message"]["content"][0], plan, "bare"]
    hollow = json.loads(run("minimal")[0])["message"]["content"]
    assert hollow[2] == {**call, "input": "[STRIPPED]"} and hollow[4] == {**result, "content": "[STRIPPED]"}
    assert json.loads(run("full")[0]) == entry and run("full")[2] == "{bad"
    assert run("typo") == run("none") and run("none")[2] is None
    assert json.loads(run("none")[1]) == LINES[1]


def test_line_order_across_splits(spark, tmp_path):
    path = write(tmp_path, "s.jsonl", [json.dumps({"type": "user", "n": i, "pad": "x" * 50}) for i in range(20000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        lines = readers.read_transcript_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 4
        n = F.get_json_object("raw", "$.n").cast("int")
        got = [r["n"] for r in lines.select("line_no", n.alias("n")).orderBy("line_no").collect()]
        assert got == list(range(20000))
        pos = tr.line_number(lines, chunk_width=1000).select("position", n.alias("n"))
        assert pos.filter("position <> n + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tool_call_pairs_and_usage(spark):
    b = spark.createDataFrame([("s", 1, "tool_use", "Read", "a"), ("s", 2, "tool_result", None, "a"),
                               ("s", 3, "tool_use", "Bash", "b"), ("s", 4, "tool_use", "Read", None), ("z", 1, "tool_result", None, "b")],
                              "session_id string, line_no long, type string, name string, id string")
    assert {(r["id"], r["result_line"]) for r in tr.tool_call_pairs(b).collect()} == {("a", 2), ("b", None), (None, None)}
    assert {(r["name"], r["n_calls"]) for r in tr.tool_usage(b).collect()} == {("Read", 2), ("Bash", 1)}


def test_flat_real_user_message_and_modes(spark):
    rows = spark.createDataFrame([("s", 1, "text", None, "hi"), ("s", 2, "text", None, "x"), ("s", 2, "tool_result", None, "o"),
                                  ("s", 3, "tool_use", "ExitPlanMode", "p"), ("s", 3, "tool_use", "Read", "q")],
                                 "session_id string, line_no long, type string, name string, body string")
    real = {r["line_no"]: r["is_real_user"] for r in tr.real_user_message_flat(rows, ["session_id", "line_no"]).collect()}
    assert real == {1: True, 2: False, 3: False}
    assert [tr.filter_block_rows(rows, m).count() for m in ("none", "minimal", "full", "?")] == [3, 5, 5, 3]
