import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, awkward_rows, empty
from vigil.llm import packing as P
from vigil.llm.byte_bpe import ChunkEncoder, default_vocabulary


def library_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_awkward_rows(spark):
    rows = awkward_rows()
    pieces = P.pack(awkward(spark)).cache()
    got = pieces.collect()
    want = sorted([*ids, 0] for ids in library_ids([r[1] for r in rows]))
    stream = {}
    for p in got:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.offset + p.length <= 1024
        stream[p.sequence_id * 1024 + p.offset] = p
    at, docs, current = 0, [], []
    for place in sorted(stream):  # gapless; a document's pieces follow each other
        p = stream[place]
        assert place == at and p.start == len(current)
        current += np.frombuffer(bytes(p.ids), "<u4").tolist()
        at += p.length
        if len(current) == p.doc_tokens:
            docs.append(current)
            current = []
    assert sorted(docs) == want and not current
    seqs = P.sequences(pieces).collect()
    assert sum(s.n_pad for s in seqs) == -at % 1024 and all(len(s.ids) == 1024 for s in seqs)


def test_empty_table(spark):
    assert P.pack(empty(spark)).collect() == []


def test_ids_equal_the_library_on_odd_spaces():
    enc = ChunkEncoder(default_vocabulary())
    texts = ["", " ", "a  b", " a", "a ", "x\n y", "x \ny", "\n\n a  \n", "<|endoftext|> foo <|endoftext|>", "é  b", "a\x1c b", "don't 's  's", "1 2  3\t4",
             "x  y", "a ́b", "end\n", "foo end\n x", "end\n", "a b c", "  ", " ", "a  b"]
    for t, want in zip(texts * 2, library_ids(texts) * 2):  # the second time from the cache
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == want, repr(t)
