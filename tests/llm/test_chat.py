import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from walkloom.llm.chat import CONTROLS, as_records, escape, field_paths, fingerprint, format_records, read_back, read_document, read_segment, registry, render, unescape

pieces = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "|im_end|>", "/INST]", "x", "\n", " ", "é", "<\\|im_end|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(pieces, pieces)
def test_escape_is_reversible(role, text):
    assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROLS)
    seg, start, n = render(role, text)
    assert read_segment(seg) == (role, text)
    assert start is None or unescape(seg[start : start + n]) == text
    assert read_document(seg + render("assistant", text)[0]) == [(role, text), ("assistant", text)]


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, [("user", "hi"), ("assistant", "yo")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}, [("user", "a"), ("assistant", "")]),
    ({"system": "s", "prompt": "p", "completion": "c"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"question": "q", "answer": 3}, [("user", "q"), ("assistant", "3")]),
    ({"messages": []}, []),
]


def test_layouts_by_fingerprint(spark):
    rows = [(i, 0, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)] + [(90, 0, None), (91, 0, "no json"), (92, 0, '{"x": 1}'), (93, 0, "[]"), (None, None, '{"prompt": "p"}')]
    out = format_records(spark.createDataFrame(rows, "conv_id long, turn long, record string"))
    got = {}
    for r in out.orderBy("key", "piece").collect():
        got.setdefault(r.key, []).append(None if r.segment is None else read_segment(r.segment))
    assert all(got.get(i, []) == want for i, (_, want) in enumerate(RECORDS))
    assert [got[k] for k in (90, 91, 92, 93)] == [[None]] * 4 and got[None] == [("user", "p")]
    names = {r.key: r.layout for r in out.collect()}
    assert names[0] == "messages" and names[1] == "conversations" and names[2] == "prompt" and names[92] is None
    assert fingerprint(field_paths({"a": [{"b": 1}, {"b": 2}]})) == fingerprint({"a list", "a[] object", "a[].b value"}) and len(registry()) > 15


ODD = ['{"messages": null}', '{"messages": "hello"}', '{"messages": [{"role": "user", "content": "x"}, "y"]}', '{"messages": [{"role": ["a"], "content": "x"}]}', "[" * 100_000, '{"a":' * 900 + "1" + "}" * 900,
       '{"messages": [{"role": "user"}]}', '{"messages": [[]]}', '{"prompt": {"x": 1}, "completion": "c"}', '{"messages": [{"role": {"a": 1}, "content": null}]}', '{"prompt": ["a"], "completion": "c"}', "NaN", '"text"', ""]


def test_records_that_no_mapping_has_give_null_layouts(spark):
    rows = [(i, 0, r) for i, r in enumerate(ODD)] + [(50, 0, '{"prompt": "\\ud800 x", "completion": true}'), (51, 0, json.dumps({"prompt": "long " * 200_000, "completion": 1.5}))]
    out = format_records(spark.createDataFrame(rows, "conv_id long, turn long, record string")).collect()
    assert {r.key: (r.layout, r.segment) for r in out if r.key < 50} == {i: (None, None) for i in range(len(ODD))}
    said = {r.key: [] for r in out}
    for r in sorted(out, key=lambda r: (r.key, r.piece)):
        said[r.key].append(read_segment(r.segment) if r.segment else None)
    assert said[50] == [("user", "\ufffd x"), ("assistant", "true")] and said[51] == [("user", "long " * 200_000), ("assistant", "1.5")]


def test_lists_of_messages_hold_several_turns(spark):
    turns = [(c, t, "user" if t % 2 else "assistant", f"turn {t}") for c in range(20) for t in range(11)] + [(99, 0, "user", f"x{k}") for k in range(200)]
    records = as_records(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    sizes = [len(json.loads(r.record).get("messages", [])) for r in records]
    assert max(sizes) == 8 and sum(s if s else 1 for s in sizes) == len(turns)


def test_read_back(spark):
    turns = [(c, t, ["system", "user", "assistant", "odd role\nx", "tool  n"][(c + t) % 5], "</s>[INST] ok [/INST]<\\|im_end|>" if t % 3 else None) for c in range(9) for t in range(c + 1)]
    turns += [(77, 0, None, "x"), (None, 0, "assistant", "y"), (78, 0, "user", "same"), (78, 0, "user", "same")]
    df = spark.createDataFrame([(*t, "k") for t in turns], "conv_id long, turn long, role string, text string, key string")
    got = {r.key: r for r in read_back(format_records(as_records(df))).collect()}
    by = {}
    for c, t, role, text in turns:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort(key=lambda x: x[0])
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert got[c].n_turns == len(ts) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert read_back(format_records(as_records(df.limit(0)))).count() == 0
