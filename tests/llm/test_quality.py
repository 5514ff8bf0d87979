import zlib

import numpy as np

from histshift.llm import quality as Q
from histshift.llm.common import table
from tests.conftest import SF01
from tests.llm.fixtures import frame

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    scored = Q.classify(docs, labels).toPandas()
    assert len(scored) == docs.count() and scored.score.between(0, 1).all()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()
    assert (scored.predicted == (scored.score >= 0.3)).all()
    held = scored[scored.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad).mean() > 0.95
    kept = Q.keep_good(docs.withColumnRenamed("lang", "score"), labels)
    assert kept.columns == ["doc_id", "text", "score", "source", "n_chars"] and kept.count() == scored.predicted.sum()


def test_held_out_labels_teach_nothing(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    seen = [i for i in range(400) if i not in held][:60]
    rows = [(i, "clean words in a row " * 3 if k % 2 else "junk ### $$$ %%% " * 3, "en", 0) for k, i in enumerate(seen)]
    rows += [(i, "clean words in a row", "en", 0) for i in held]
    right = [(i, k % 2, 0) for k, i in enumerate(seen)] + [(9999, 1, 0)]        # no such text
    wrong = right + [(i, 0, 0) for i in held] + [(None, 0, 0), (seen[0], None, 0)]
    docs = frame(spark, rows)
    a, b = (Q.classify(docs, spark.createDataFrame(x, LABELS)).toPandas() for x in (right, wrong))
    assert a.equals(b) and a[a.held_out].predicted.all()


def test_degenerate_labels_and_texts(spark):
    docs = frame(spark)
    none = Q.classify(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5} and len(none) == docs.count()
    one = Q.classify(docs, spark.createDataFrame([(3, 1, 0), (4, 1, 0), (6, 1, 0)], LABELS)).collect()
    assert all(r.score > 0.99 and r.predicted == 1 for r in one)
    assert not [r for r in one if r.doc_id is None and r.held_out]
    assert Q.classify(frame(spark, []), spark.createDataFrame([(3, 1, 0)], LABELS)).count() == 0


def test_features_cover_whole_texts():
    f = Q.Features()
    text = np.frombuffer(b"ab " * 400_000 + b"#$%", np.uint8)
    assert len(np.setdiff1d(f.places(np.frombuffer(b"ab #$%", np.uint8))[:-2], f.places(text))) == 0 and not f.seen.any()
    assert f.places(text[:0]).tolist() == [1 << Q.BITS, (1 << Q.BITS) + 16]


def a_corpus():
    rng = np.random.default_rng(12)
    good, bad = ["clear plain words in order", "a second calm line", "facts and figures"], ["### $$$ buy", "zzz zzz zzz", "%%% ??? !!!"]
    texts, y = [], []
    for k in range(90):
        pool = good if k % 2 else bad
        text = " ".join(str(rng.choice(pool)) for _ in range(rng.integers(2, 9)))
        texts.append(text + (" mixed words" if k % 7 else " $$$ plain"))
        y.append(1 if k % 2 else -1)
    return texts, np.array(y)


def plain_places(text):
    """Distinct places of a text, n-gram by n-gram."""
    data, out = text.encode(), set()
    for n in Q.LENGTHS:
        for i in range(len(data) - n + 1):
            g = int.from_bytes(data[i:i + n], "big") + n
            out.add((g * 2654435761 & 0xFFFFFFFF) >> 32 - Q.BITS)
    words = data.split()
    twice = sum(a == b for a, b in zip(words, words[1:]))
    share = 0 if not twice else 1 + min(int(-np.log2(twice / len(words))), 14)
    return sorted(out) + [(1 << Q.BITS) + min(len(words).bit_length(), 15), (1 << Q.BITS) + 16 + share]


def test_ratios_hinge_optimum_and_scores_against_a_plain_version(monkeypatch):
    texts, y = a_corpus()
    f = Q.Features()
    rows = [f.places(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    assert [r.tolist() for r in rows] == [plain_places(t) for t in texts]
    ratio = Q.log_count_ratio(rows, y)
    totals = {s: sum(len(r) for r, k in zip(rows, y) if k == s) + Q.PLACES * Q.SMOOTH for s in (1, -1)}
    for place in (*plain_places(texts[0])[:40], *plain_places(texts[1])[-40:]):
        n = {s: sum(place in r for r, k in zip(rows, y) if k == s) + Q.SMOOTH for s in (1, -1)}
        assert abs(ratio[place] - np.log(n[1] / totals[1] / (n[-1] / totals[-1]))) < 1e-12

    def scaled(places):
        """Values of a text's places: ratios, each block of unit length."""
        v = ratio[places]
        block = np.array(places) < 1 << Q.BITS
        size = np.where(block, np.sqrt((v[block] ** 2).sum()), np.sqrt((v[~block] ** 2).sum()))
        return v / np.maximum(size, 1e-9)

    values = [ratio[r] / Q.lengths(r, ratio ** 2) for r in rows]
    assert all(np.allclose(v, scaled(r)) for v, r in zip(values, rows))
    cost = np.full(len(rows), 0.7)
    _, _, rough = Q.dual_coordinate_descent(rows, values, y, cost)
    with monkeypatch.context() as m:
        m.setattr(Q, "TOLERANCE", 1e-6)
        m.setattr(Q, "EPOCHS", 2000)
        w, bias, alpha = Q.dual_coordinate_descent(rows, values, y, cost)
    x = np.zeros((len(rows), Q.PLACES + 1))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r], x[i, -1] = v, 1.0
    full = np.r_[w, bias]
    assert np.allclose(full, (alpha * y) @ x) and ((alpha >= 0) & (alpha <= cost)).all()
    primal = 0.5 * full @ full + (cost * np.maximum(0, 1 - y * (x @ full))).sum()
    dual = alpha.sum() - 0.5 * full @ full
    assert -1e-9 <= primal - dual <= 1e-4 * primal
    ends = 0.5 * np.square((rough * y) @ x).sum()
    assert (rough.sum() - ends) >= 0.95 * dual          # where the production settings stop
    # a solver of another kind (projected gradient on the dual) meets the same optimum
    gram, a = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(len(rows))
    for _ in range(20_000):
        a = np.clip(a + (1 - gram @ a) / np.linalg.norm(gram, 2), 0, cost)
    assert abs((a.sum() - 0.5 * a @ gram @ a) - dual) <= 1e-3 * primal

    weights, squares, b = Q._model(rows, y)
    share = (y == 1).mean()
    w, bias, _ = Q.dual_coordinate_descent(rows, values, y, Q.COST * np.where(y == 1, 0.5 / share, 0.5 / (1 - share)))
    mean = np.abs(w[w != 0]).mean()
    for r, v in zip(rows, values):
        want = sum(((1 - Q.BETA) * mean * (w[p] != 0) + Q.BETA * w[p]) * z for p, z in zip(r, v)) + bias
        assert abs(Q.margin(r, weights, squares, b) - want) < 1e-3 * max(1.0, abs(want))


def test_a_hot_id_and_large_texts_stay_within_the_bounds(spark, monkeypatch):
    seen = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:40]
    rows = [(i, "clean words in a row " * 3 if k % 2 else "junk ### $$$ %%% " * 3, "en", 0) for k, i in enumerate(seen)]
    hot = [(seen[0], f"row {k} of one id " * 20, "en", 0) for k in range(300)]
    labels = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(seen)], LABELS)
    sample, counts = Q.training_sample(frame(spark, rows + hot), labels)
    found = sample.collect()
    assert sorted(r.doc_id for r in found) == sorted(seen) and counts == {0: 20, 1: 20}
    again = Q.training_sample(frame(spark, (rows + hot)[::-1]).repartition(7), labels)[0].collect()
    assert {r.doc_id: bytes(r._text) for r in found} == {r.doc_id: bytes(r._text) for r in again}
    whole = Q.classify(frame(spark, rows), labels).toPandas()
    monkeypatch.setattr(Q, "CLASS_BYTES", 900)          # room for a few texts only
    few = Q.classify(frame(spark, rows), labels).toPandas()
    assert len(few) == len(whole) and not few.score.equals(whole.score) and few.score.between(0, 1).all()
    monkeypatch.setattr(Q, "CLASS_BYTES", 0)
    assert set(Q.classify(frame(spark, rows), labels).toPandas().score) == {0.5}
