import hashlib
import json
import random

import pytest

from locspark.llm.chat_format import LAYOUTS, canonical_turns, chat_digests, field_paths, fingerprint, format_chats, json_layout, json_turns, read_chats, select_layout

SCHEMA = "conv_id long, turn long, role string, text string"


def rows():
    r = random.Random(3)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "<\\s>", "<\\\\/s>", "</\\s>", "INST]", "s>", "é\n", "𝔘", "$1", ""]
    out = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, None, None), (None, 0, "user", "x"), (2, 0, "assistant", "z" * 9000), (3, 1, "user", "a"), (3, 1, "user", "a"), (3, 1, "assistant", "b")]
    for c in range(10, 60):
        for t in range(r.randint(1, 6)):
            out.append((c, t, r.choice(["user", "assistant", "system", "</s>", "a]\n"]), "".join(r.choice(bits) for _ in range(r.randint(0, 12)))))
    return out


def test_round_trip(spark):
    data = rows()
    shuffled = data[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame([(*x, "other") for x in shuffled], SCHEMA + ", formatted string")
    got = {r.conv_id: r for r in chat_digests([df]).collect()}
    back = {r.conv_id: r for r in read_chats(format_chats(canonical_turns(df))).collect()}
    convs = {x[0] for x in data}
    assert set(got) == convs
    for c in convs:
        turns = sorted((t, r or "", x or "") for i, t, r, x in data if i == c)
        assert [(t.role, t.text) for t in back[c].turns] == [x[1:] for x in turns]
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
        assert got[c].formatted_chars == len(back[c].formatted) and back[c].formatted.count("</s>") == len(turns)


def test_layouts(spark):
    want = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    tables = [
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], 5)], "conv_id long, messages array<struct<role:string,content:string>>, extra int"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "id int, conversations array<struct<from:string,value:string>>"),
        spark.createDataFrame([(1, "q", "", "a")], "id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, "q", "a", 0)], "id long, prompt string, completion string, turn int"),
        spark.createDataFrame(want, SCHEMA),
    ]
    names = [select_layout(t.schema).name for t in tables]
    assert names == ["messages", "from and value", "instruction", "prompt", "turn rows"]
    for t in tables:
        assert sorted(map(tuple, canonical_turns(t).collect())) == want
    with pytest.raises(ValueError):
        select_layout(spark.createDataFrame([(1,)], "id long").schema)
    with pytest.raises(ValueError):  # another kind is another path
        select_layout(spark.createDataFrame([("1", "q", "a")], "id string, prompt string, completion string").schema)
    assert fingerprint(field_paths(tables[1].schema)) == fingerprint(LAYOUTS[2].paths) != fingerprint(field_paths(tables[0].schema))


def test_rows_of_several_layouts(spark):
    data = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a", "weight": 1}]},
        {"output": "a", "input": "more", "instruction": "q", "id": 3},
        {"id": 4, "prompt": "q", "completion": "a", "turn": 9, "extra": {"id": 1}},
        {"conv_id": 5, "turn": 3, "role": "system", "text": "s"},
        {"id": None, "prompt": "é</s>", "completion": None},
        {"id": 7}, {"conv_id": 8, "messages": []}, [1], None,
    ]
    df = spark.createDataFrame([(json.dumps(x), i) for i, x in enumerate(data)] + [("{broken", 10), (None, 11)], "json string, layout int")
    names = [r.name for r in df.orderBy("layout").select(json_layout(df.json).alias("name")).collect()]
    assert names == ["messages", "from and value", "instruction", "prompt", "turn rows", "prompt"] + [None] * 6
    want = [(1, 0, "user", "q"), (1, 1, "assistant", ""), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "q\nmore"), (3, 1, "assistant", "a"), (4, 0, "user", "q"), (4, 1, "assistant", "a"), (5, 3, "system", "s"), (None, 0, "user", "é</s>"), (None, 1, "assistant", "")]
    assert sorted(map(tuple, json_turns(df).collect()), key=str) == sorted(want, key=str)
    assert json_turns(df.limit(0)).collect() == []


def test_empty(spark):
    assert chat_digests([spark.createDataFrame([], SCHEMA)]).collect() == []
