import hashlib
import re

import numpy as np
import pytest

from histshift.llm import fim
from histshift.llm.queries import ORACLE, QUERIES
from histshift.testing.compare import compare
from tests.conftest import SF001
from tests.llm.fixtures import edge_rows, frame

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, seed=7, fim_percent=100, spm_percent=50, marks=fim.MARKS):
    text = text or ""
    units = LINES.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in marks) or h3 % 100 >= fim_percent:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    one, mid, two = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if h4 % 100 < spm_percent:
        return n, "spm", s + two + p + one + m + mid, len(one), len(mid)
    return n, "psm", p + one + s + two + m + mid, len(one), len(mid)


def rows():
    more = [(100, "a\nb\n\n\nc", "en", 8), (101, "\n", "en", 1), (102, "x <P>\ny", "en", 7), (103, "end <\n<S\n>x\n", "en", 12),
            (104, " \u0085é\r\n\U0001d54f\n<M", "en", 9), (105, "only one line", "en", 13), (105, "another\nrow", "en", 11),
            (-7, "l\n" * 150_000, "en", 300_000), (106, "\n" * 70_000 + "x" * 140_000 + "\ny\n", "en", 210_003)]
    many = [(200 + i, "\n".join("w" * (j % 7) for j in range(i % 12)), "en", None) for i in range(200)]
    return edge_rows() + more + many


@pytest.mark.parametrize("percent,marks", [((100, 50), fim.MARKS), ((60, 100), ("⟦p", "⟦s", "⟦m")), ((0, 0), fim.MARKS)])
def test_every_row_against_the_plain_version(spark, percent, marks):
    df = fim.restored(fim.fill_in_middle(frame(spark, rows()), 7, *percent, marks), marks)
    got = sorted(((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.restored) for r in df.collect()), key=repr)
    want = sorted(((i, *brute(i, t, 7, *percent, marks), t or "") for i, t, *_ in rows()), key=repr)
    assert got == want
    if percent == (100, 50):
        assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("values,kinds", [
    (np.arange(0, 9000, 2), ["bitmap"]), (np.arange(0, 4000, 3), ["array"]), (np.arange(5, 9000), ["run"]),
    (np.r_[0:70_000, 70_001:200_000:9, 300_000], ["run", "bitmap", "bitmap", "bitmap", "array"]), (np.array([0]), ["array"]),
    (np.zeros(0, np.int64), [])])
def test_containers_select_every_value(values, kinds):
    s = fim.BoundarySet(values.astype(np.int64))
    assert len(s) == len(values) and s.ends.tolist() == np.cumsum([np.sum(values >> 16 == k) for k in s.keys]).tolist()
    for k in np.r_[np.arange(0, len(values), max(1, len(values) // 500)), len(values) - 1][:len(values)]:
        assert s.select(int(k)) == values[k]
    with pytest.raises(IndexError):
        s.select(len(values))
    found = [c.kind for c in s.containers]
    assert len(found) == len(kinds) and (len(kinds) > 1 or found == kinds)


def test_all_three_container_kinds_occur():
    rng = np.random.default_rng(2)
    dense = np.sort(rng.choice(65_536, 20_000, replace=False))
    s = fim.BoundarySet(np.r_[np.arange(50), 65_536 + dense, 131_072 + np.arange(0, 3000, 5)].astype(np.int64))
    assert [c.kind for c in s.containers] == ["run", "bitmap", "array"]
    assert [s.select(50 + k) for k in (0, 1, 9999, 19_999)] == (65_536 + dense[[0, 1, 9999, 19_999]]).tolist()


def test_marks_that_can_be_confused_are_refused(spark):
    for marks in (("<P>", "<P>x", "<M>"), ("", "a", "b"), ("aa", "b", "c"), ("ab", "ba", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(frame(spark), marks=marks)


def test_empty_table_null_ids_and_oracle(spark):
    assert fim.fim_digest(frame(spark, [])).count() == 0
    digest = {r.doc_id: r for r in fim.fim_digest(frame(spark, [(None, "a\nb", "x", 1), (2, None, "x", 0)])).collect()}
    assert digest[None].restored_sha256 == hashlib.sha256(b"a\nb").hexdigest() and digest[2].n == 0
    r = compare(QUERIES["op11_fill_in_middle"](spark, SF001), ORACLE["op11_fill_in_middle"], SF001)
    assert r["columns_match"] and r["values_match"], r
