import hashlib
import random

import pytest

from histshift.llm import substring_dedup as S
from tests.llm.fixtures import frame, words


def brute(rows, window=50):
    least = {}
    texts = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_edge_rows_against_brute_force(spark):
    df = frame(spark)
    assert rows_of(S.dedup_digest(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_empty_table(spark):
    assert S.dedup_digest(frame(spark, [])).count() == 0 and S.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("window", [4, 7, 50])
def test_random_overlaps(spark, window):
    rng, source, rows = random.Random(window), words(9, 400, 30), []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(5)):
            a = rng.randrange(350)
            w += source[a:a + rng.randrange(3 * window)] + words(rng.randrange(999), rng.randrange(4), 5)
        rows.append((rng.randrange(80), " ".join(w + ["same"] * rng.choice([0, window, 2 * window]))))
    df = frame(spark, rows, "doc_id long, text string")
    assert rows_of(S.dedup_digest(df, window)) == brute(rows, window)


def test_remove_repeats_cuts_passages_and_keeps_the_rest(spark):
    df = frame(spark).withColumnRenamed("lang", "ranges")
    before = {r.doc_id: r for r in df.collect() if r.doc_id not in (5, None)}
    after = S.remove_repeats(df)
    assert after.columns == df.columns and after.count() == df.count()
    passage = " ".join(words(2, 60))
    for r in after.collect():
        if r.doc_id in (1, 2, 3, 4, 6, 10, 11, 17, 18, 19):
            assert r == before[r.doc_id]
        elif r.doc_id == 8:
            assert r.text == " ".join(words(5, 50)) and r.n_chars == len(r.text) and passage in before[7].text
