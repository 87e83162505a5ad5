import itertools
import math
import zlib

import pytest

from tests.llm.helpers import awkward, awkward_rows, empty
from vigil.llm import langid as G

PIECES = {"▁": (0.1, 0.2), "▁a": (0.2, 0.1), "a": (0.1, 0.1), "b": (0.2, 0.05), "ab": (0.1, 0.3), "ba": (0.05, 0.15), "▁ab": (0.25, 0.1)}


def all_segmentations(text):
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, start = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(text[start:i])
                start = i
        yield parts


def piece_probability(p, lang):
    return PIECES[p][lang] if p in PIECES else (G.UNKNOWN if len(p) == 1 else 0.0)


def test_the_forward_sum_equals_all_segmentations():
    auto = G.Automaton(PIECES, 2)
    words = ["a", "b", "ab", "abab", "bbaab", "aéb", "zz", "abbabaab"]
    for w, got in zip(words, auto.likelihoods(words)):
        for lang in (0, 1):
            want = sum(math.prod(piece_probability(p, lang) for p in parts) for parts in all_segmentations("▁" + w))
            assert got[lang] == pytest.approx(math.log(want), abs=1e-9)


def test_expected_counts_equal_all_segmentations():
    one = {p: v[0] for p, v in PIECES.items()}
    weights = {tuple(parts): math.prod(piece_probability(p, 0) for p in parts) for parts in all_segmentations("▁abab")}
    total = sum(weights.values())
    want = {p: sum(w * parts.count(p) for parts, w in weights.items()) / total for p in one}
    got = G.expected_counts("abab", one, 3)
    assert all(got.get(p, 0.0) == pytest.approx(want[p], abs=1e-12) for p in one)


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = G.identify(awkward(spark)).collect()
    assert len(got) == len(rows)
    texts = {(-1 if r[0] is None else r[0]): r[1] for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is None:
            assert not r.held_out
            continue
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0.0 <= r.score <= 1.0 and (r.lang_pred in ("en", "de") if letters else (r.lang_pred, r.score) == ("und", 0.0))


def test_empty_table_and_nothing_to_learn_from(spark):
    assert G.identify(empty(spark)).collect() == []
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    r = G.identify(df).first()
    assert (r.doc_id, r.lang_pred, r.score) == (1, "und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = G.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 100 and (out.lang_pred == out.lang).mean() >= 0.98
