"""Sessions: append turn, summaries, session files (dict / list / broken forms), fences."""

import json
import os


from corpusworks.operators import messages as msg
from corpusworks.operators import sessions as ss
from corpusworks.sources import sessions as src


def test_append_turn_golden(spark):
    ex = spark.createDataFrame([("s1", "Merhaba", None, "Nasıl yardımcı olabilirim?", None),
                                ("s2", "", "q", None, ""), ("s3", None, None, None, None)],
                               "session string, input string, question string, output string, answer string")
    rows = ss.append_turns(ex).orderBy("session", "msg_no").collect()
    assert [(r["session"], r["role"], r["content"]) for r in rows] == [
        ("s1", "human", "Merhaba"), ("s1", "ai", "Nasıl yardımcı olabilirim?"), ("s2", "human", "q")]


def test_session_records_and_summary(spark):
    t = spark.createDataFrame([("a", 0, "human", "Merhaba", "2024-01-01 10:00:00"),
                               ("a", 1, "ai", "Selam", "2024-01-01 10:00:00")],
                              "session string, turn long, role string, content string, time string")
    rec = ss.session_records(t, model_name="test_model").first()
    assert rec["model_name"] == "test_model" and rec["message_count"] == 2
    assert rec["created_at"] == "2024-01-01 10:00:00" and rec["messages"][0]["content"] == "Merhaba"
    s = ss.session_summary(t).first()
    assert (s["message_count"], s["preview"], s["updated_at"]) == (2, "Merhaba", "2024-01-01 10:00:00")


def write(path, name, content):
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False))


def test_session_file_forms(spark, tmp_dir):
    m = [{"role": "human", "content": "x" * 60, "time": "2024-01-02 03:04:05"},
         {"role": "ai", "content": "b", "time": "2024-01-02 03:05:00"}]
    write(tmp_dir, "full.json", {"model_name": "m", "session_id": "s", "created_at": "2024-01-02 03:04:05",
                                 "updated_at": "2024-02-01 00:00:00", "message_count": 2, "messages": m})
    write(tmp_dir, "noupd.json", {"model_name": "m2", "created_at": "2024-01-03 00:00:00", "messages": m})
    write(tmp_dir, "wrongcount.json", {"model_name": "m3", "message_count": 7, "messages": m})
    write(tmp_dir, "old_list.json", m)
    write(tmp_dir, "empty.json", {"model_name": "e", "messages": []})
    write(tmp_dir, "number.json", "3")
    write(tmp_dir, "broken.json", "{not json")
    write(tmp_dir, "notes.txt", "ignored")
    rows = {r["filename"]: r for r in src.list_sessions(spark, tmp_dir).collect()}
    assert set(rows) == {"full.json", "noupd.json", "wrongcount.json", "old_list.json"}
    assert rows["full.json"]["updated_at"] == "2024-02-01 00:00:00"
    assert rows["noupd.json"]["updated_at"] == "2024-01-03 00:00:00"
    assert rows["wrongcount.json"]["message_count"] == 7
    assert rows["wrongcount.json"]["model_name"] == "m3" and rows["wrongcount.json"]["created_at"] == ""
    assert rows["old_list.json"]["model_name"] == "old_list"
    assert rows["old_list.json"]["updated_at"] == "2024-01-02 03:05:00"
    assert rows["full.json"]["preview"] == "x" * 50 + "..."
    assert rows["full.json"]["date_short"] == "02/01 03:04"
    one = src.load_session(spark, tmp_dir, "old_list.json").first()
    assert one["model_name"] == "old_list" and one["session_id"] == ""


def test_fences(spark):
    texts = ["no fences here", "intro ```python\nprint(1)\n``` outro", "a ```inline``` b",
             "```x\n1```mid```y\n2```", "open ```sh\nls -la"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    code = sorted((r["id"], r["part_no"], r["lang"], r["code"]) for r in msg.code_blocks(df, "text").collect())
    want, prose_want = [], []
    for i, t in enumerate(texts):
        parts = t.split("```")
        for j, p in enumerate(parts):
            if j % 2 == 1:
                ls = p.split("\n", 1)
                want.append((i, j, ls[0].strip() if len(ls) > 1 else "", (ls[1] if len(ls) > 1 else ls[0]).strip()))
            elif "```" in t and p.strip():
                prose_want.append((i, j, p.strip()))
            elif "```" not in t and p:
                prose_want.append((i, j, p))
    assert code == sorted(want)
    prose = sorted((r["id"], r["part_no"], r["text"]) for r in msg.prose_segments(df, "text").collect())
    assert prose == sorted(prose_want)


def test_delete_and_replay(spark):
    t = spark.createDataFrame([("a", 1, "human", "q", "t"), ("a", 0, "ai", "p", "t"), ("b", 0, "human", "z", "t")],
                              "session string, turn long, role string, content string, time string")
    left = ss.delete_sessions(t, spark.createDataFrame([("b",)], "session string"))
    assert {r["session"] for r in left.collect()} == {"a"}
    rp = ss.replay(left).collect()
    assert [(r["turn"], r["role"]) for r in rp] == [(0, "ai"), (1, "user")]
