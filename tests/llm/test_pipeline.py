import hashlib

import numpy as np

import __spark_entry__ as E
import corpus_pipeline as C
from histshift.llm import secrets as S
from histshift.llm.common import table, write_table
from tests.conftest import SF01
from tests.llm import test_jaccard_join, test_substring_dedup


def test_stages_in_order_keep_columns_and_decide(spark):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "secret scans",
                                        "best-fit packing"]
    docs = table(spark, SF01, "documents")
    outs = []
    for _, stage in C.STAGES[:-1]:
        outs.append(write_table(stage(spark, docs if not outs else outs[-1], SF01), "test-stage"))
        assert outs[-1].columns == docs.columns
    good, single, cut, clean = ({r.doc_id: r for r in o.collect()} for o in outs)
    original = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF01, "labels").collect()}
    judged = [i for i in original if i in labels]
    assert np.mean([(i in good) == (labels[i] == 1) for i in judged]) > 0.95
    assert all(r == original[i] for i, r in good.items())

    groups = {i: c for i, _, c in test_jaccard_join.brute([(r.doc_id, r.text) for r in good.values()])}
    assert set(single) == set(groups.values()) and all(r == good[i] for i, r in single.items())

    want = {r[0]: r for r in test_substring_dedup.brute([(r.doc_id, r.text) for r in single.values()])}
    assert set(cut) == set(single)
    for i, r in cut.items():
        found = r.text.encode().split()
        assert hashlib.sha256(b" ".join(found)).hexdigest() == want[i][3] and r.n_chars == len(r.text)
        assert want[i][2] or r.text == single[i].text

    assert set(clean) == set(cut)
    for i, r in clean.items():
        assert (r.text == cut[i].text) == (not S.base_spans(cut[i].text)) and not S.base_spans(r.text)

    packed = C.packing(spark, outs[-1], SF01).toPandas()
    assert set(packed.doc_id) == set(clean)
    total = int(packed["length"].sum())
    assert packed.sequence_id.nunique() == -(-total // 2048)


def test_registered(spark):
    assert E.queries()["pipeline"] is C.run
    numbers = sorted(int(k[2:].split("_")[0]) for k in E.queries() if k.startswith("op"))
    assert numbers == list(range(1, 14))
