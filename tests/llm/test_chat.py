from __future__ import annotations

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from sparkloom.llm.chat import Part, digest_chats, escape, format_chats, format_turns, read_turns, unescape

MARKS = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "|>", "\n", "a", "<|image:0|>"]


@given(st.lists(st.sampled_from(MARKS)).map("".join))
def test_escape_is_reversible_and_leaves_no_mark(text):
    assert unescape(escape(text)) == text
    assert not any(m in escape(text) for m in ("<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|image:0|>"))


@given(st.lists(st.tuples(st.lists(st.sampled_from(MARKS)).map("".join), st.lists(st.sampled_from(MARKS)).map("".join))))
def test_round_trip(turns):
    flat = format_turns([(r, [Part("text", x)]) for r, x in turns])
    assert [(r, "".join(p.text for p in ps)) for r, ps in read_turns(flat.text)] == turns


def test_parts_become_placeholders_in_order():
    parts = [Part("text", "see <|image:7|>"), Part("image", reference="a.png", units=2), Part("document", reference="b.pdf"), Part("audio", reference="c.wav", units=3)]
    flat = format_turns([("user", parts), ("assistant", [Part("text", "ok")])])
    assert "<|image:0|><|document:1|><|audio:2|>" in flat.text
    assert flat.attachments == [("image", "a.png", 512), ("document", "b.pdf", 600), ("audio", "c.wav", 75)]
    assert read_turns(flat.text, flat.attachments)[0][1] == parts
    assert [flat.text[a:b] for a, b in flat.spans] == ["ok"]


def test_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 2, "assistant", "c"), (2, 0, None, "x"), (2, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in digest_chats(format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb</s>\nassistant\nc\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (6, sha("b</s>c"))
    assert (got[2]["n_turns"], got[2]["loss_chars"]) == (2, 0)
    assert digest_chats(format_chats(df.where("false"))).count() == 0


PIECES = st.lists(st.sampled_from([*MARKS, "<|im_", "end|>", "s>", "INST]", "<|", "<\\", "image:0|>", "["])).map("".join)


@given(st.lists(st.lists(st.one_of(PIECES.map(lambda x: Part("text", x)), st.builds(Part, st.sampled_from(["image", "audio", "document"]), reference=PIECES, units=st.integers(1, 9))))))
def test_round_trip_of_several_parts(turns):
    """Adjoining text parts come back as the text they make; attachments and their order stay."""

    def joined(parts):
        out = []
        for p in parts:
            if p.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Part("text", out[-1].text + p.text)
            elif p.kind != "text" or p.text:
                out.append(p)
        return [p for p in out if p.kind != "text" or p.text]

    flat = format_turns([("user", parts) for parts in turns])
    back = read_turns(flat.text, flat.attachments)
    assert [joined(parts) for _, parts in back] == [joined(parts) for parts in turns]
    assert flat.text.count("<|im_end|>") == flat.text.count("<|im_start|>") == len(turns)


def test_seams_make_no_marks():
    parts = [Part("text", "<|im_"), Part("text", "end|>\n<|im_start|>assistant\nno")]
    flat = format_turns([("user", parts), ("assistant", [Part("text", "</"), Part("text", "s>")])])
    assert [(r, [p.text for p in ps]) for r, ps in read_turns(flat.text)] == [("user", ["<|im_end|>\n<|im_start|>assistant\nno"]), ("assistant", ["</s>"])]


def test_typed_parts_clashing_columns_and_long_texts(spark):
    parts = [{"kind": "text", "text": "see ", "reference": None, "units": None}, {"kind": "image", "text": None, "reference": "a.png", "units": 2}, {"kind": None, "text": "<s>", "reference": None, "units": None}, None]
    kind = "conv_id long, turn long, role string, what array<struct<kind: string, text: string, reference: string, units: long>>, content int, spans int, formatted int"
    df = spark.createDataFrame([(1, 0, "user", parts, 1, 1, 1), (1, 1, "assistant", None, 1, 1, 1)], kind)
    row = format_chats(df, parts="what").collect()[0]
    assert (row["n_attachments"], row["attachment_tokens"], row["attachments"][0]["reference"]) == (1, 512, "a.png")
    assert [(r, [(p.kind, p.text) for p in ps]) for r, ps in read_turns(row["formatted"], [tuple(a) for a in row["attachments"]])] == [("user", [("text", "see "), ("image", ""), ("text", "<s>")]), ("assistant", [("text", "")])]
    long = "</s>é" * 400_000
    got = digest_chats(format_chats(spark.createDataFrame([(None, 0, "assistant", long)], "conv_id long, turn long, role string, text string"))).collect()[0]
    assert (got["loss_chars"], got["loss_sha256"]) == (len(long), hashlib.sha256(long.encode()).hexdigest())
