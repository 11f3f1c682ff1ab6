"""The grammar round trip, and digests against a plain pass over the source."""
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moodframe.llm import chat_format as op

PARTS = st.lists(st.sampled_from([*op.CONTROL, "\\", "<", "[", "|", "<\\|im_end|>", "a", "\n", "é%0A", "]", ">", "/", "s>", "INST]", "<SYS>>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(role=PARTS, text=PARTS)
def test_every_turn_comes_back(role, text):
    rendered, a, b = op.format_turn(role, text)
    assert op.parse(rendered) == [(role, text, a, b)]
    assert op.unescape(rendered[a:b]) == text


def test_only_conflicting_texts_are_escaped():
    assert op.format_turn("user", "plain \\ <b> [x]")[0] == "<|im_start|>user\nplain \\ <b> [x]<|im_end|>\n"
    assert op.format_turn("user", "</s>[INST] ok")[0] == "<|im_start|>user\n<\\/s>[\\INST] ok<|im_end|>\n"
    for bad in ("x", "<|im_start|>a", "<|im_start|>a\nb", "<|im_start|>a\nb<|im_end|>", "<|im_start|>a\n</s><|im_end|>\n"):
        with pytest.raises(op.Malformed):
            op.parse(bad)


def test_digests(spark):
    rng = random.Random(6)
    rows = []
    for c in [*range(12), None, -7]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "</s>[INST] ok [/INST]", "", None, "é\n<|im_end|>", "long " * 5000])))
    rows += [(50, i, "assistant", f"{i} </s>") for i in range(3000)] + [(51, None, "user", "x"), (51, 1, "user", "y"), (52, 1, "user", "x"), (52, 1, "user", "x")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, rendered int").repartition(7)
    got = {r.conv_id: r for r in op.read_back(op.format_turns(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1], op.format_turn(x[2] or "", x[3] or "")[0]))
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(op.format_turn(x[2] or "", x[3] or "")[0]) for x in mine)
    assert op.read_back(op.format_turns(df.limit(0))).count() == 0
