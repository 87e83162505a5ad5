import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, awkward_rows, empty
from vigil.llm import word_bpe as B

LIBRARY = Tokenizer.from_file(B.default_vocabulary())
OWN = B.WordBpe(B.default_vocabulary())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = sorted(tuple(r) for r in B.round_trip(awkward(spark)).na.fill(-1, ["doc_id"]).collect())
    want = []
    for r in rows:
        ids = LIBRARY.encode(r[1] or "", add_special_tokens=False).ids
        want.append((-1 if r[0] is None else r[0], len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    encoded = B.encode_documents(awkward(spark))
    assert sorted(sha(r.decoded) for r in B.decode_documents(encoded).collect()) == sorted(w[3] for w in want)


def test_empty_table(spark):
    assert B.round_trip(empty(spark)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAéÉßΣς'<|> \n\t\x1c\x85 　́İ1٣½²_-日本😀stftld", max_size=60) | st.text(max_size=40))
def test_ids_and_decoding_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_special_tokens_and_long_words():
    for text in ("<|startoftext|> a <|endoftext|>b", "<|STARTOFTEXT|>", "a" * 3000, "ab" * 500 + "!" * 900):
        assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    rng = random.Random(1)
    for _ in range(500):
        parts = [rng.choice(OWN.inner) for _ in range(rng.randint(1, 80))]
        assert B.merge_scan(list(parts), OWN.pairs) == B.merge_heap(list(parts), OWN.pairs)
