import hashlib
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from histshift.llm import chat as C
from histshift.llm.queries import ORACLE, QUERIES
from histshift.testing.compare import compare
from tests.conftest import SF001

SCHEMA = "conv_id long, turn long, role string, text string, valid string"
ROWS = [(1, 0, "tool", "a[ROLE]\\<s>"), (1, 1, "user", None), (1, None, None, "[\\INST][INST]<<s>\\"),
        (2, 0, "assistant", "<<<SYS>>"), (2, 0, "assistant", "<<<SYS>>"), (None, 1, "[ROLE]\\", "x</s>\n\U0001d54f"),
        (3, 0, "system", "be <s>"), (3, 1, "user", "hi<"), (3, 2, "assistant", "[/INST]\\\\ yo"), (4, 0, "user", "q"),
        (4, 1, "assistant", ""), (4, 2, "user", "again"), (5, 7, "assistant", "first"), (5, 9, "user", "z" * 20000),
        (6, 0, "user", "</s>[INST] ok [/INST]"), (6, 1, "assistant", "</s>[INST] ok [/INST]")]


def conversations(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)


def expected():
    out = {}
    order = sorted(ROWS, key=lambda r: tuple((x is not None, x) for x in r[1:]))
    for c, _, role, text in order:
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_turns_and_loss_text_read_back(spark):
    got = {r.conv_id: r for r in C.chat_digest(conversations(spark)).collect()}
    want = expected()
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c for c, r in got.items() if r.valid} == {3, 6}


def test_automaton_marks_the_first_invalid_turn(spark):
    got = {r.conv_id: (r.valid, r.first_invalid) for r in C.format_conversations(conversations(spark)).collect()}
    assert got[3] == (True, None) and got[4] == (False, None) and got[5] == (False, 1) and got[2] == (False, 1)
    assert got[None] == (False, 1) and got[1] == (False, 1)


def test_control_strings_never_stand_in_texts(spark):
    t = C.Template()
    marks = [a + b for a in ["", *t.controls(), "\\", "[", "<"] for b in ["", *t.controls(), "\\"]]
    df = spark.createDataFrame([(m,) for m in marks], "text string").select("text", C.escape(F.col("text"), t).alias("e"))
    for r in df.select("text", "e", C.unescape(F.col("e")).alias("back")).collect():
        assert r.back == r.text and not [m for m in t.controls() if m in r.e]


def test_no_python_in_the_plan(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES["op8_chat_format"](spark, SF001).explain("formatted")
    assert not [w for w in ("Python", "Pandas", "Arrow", "Scan ExistingRDD") if w in out.getvalue()]


def test_empty_table(spark):
    assert C.chat_digest(conversations(spark).limit(0)).count() == 0


@pytest.mark.parametrize("key", ["op8_chat_format", "op1_exact_topk"])
def test_oracle(spark, key):
    r = compare(QUERIES[key](spark, SF001), ORACLE[key], SF001)
    assert r["columns_match"] and r["values_match"], r
