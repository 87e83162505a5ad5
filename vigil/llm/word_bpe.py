"""BPE encoding and decoding with a contiguous rank array.

A word is an array of part ids beside an array with the merge rank of every
adjacent pair.  The smallest rank (leftmost on ties) is found by scanning, the
boundary between its parts is deleted, and the ranks left and right of the new
part are looked up again, until no pair has a rank.  Scanning is quadratic, so
words over ``SCAN_LIMIT`` parts keep the same arrays as a linked list and take
the minimum from a heap: the same merges in the same order.

The vocabulary file also fixes what happens before (NFC, white space to one
space, lower case, the split pattern, special tokens matched in the raw text)
and after: it names no decoder, so decoding joins the token strings by spaces.

Defined cases: null and empty texts have no ids and decode to ''; repeated rows
repeat; very long texts and words are encoded whole; an empty table gives no
rows; further input columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SCAN_LIMIT = 200
CHUNKS_KEPT = 1 << 18
WORDS_KEPT = 1 << 19
ID_BITS = 24
NO_MERGE = 1 << 60

# white space of the Unicode property, which leaves out 0x1C-0x1F
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
# fixed values: letters and numbers of later character tables that are symbols to the library
_NEWER = re.compile("[%s]" % "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
    10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
    16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
    1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
    1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F""".split()))
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next
    free one from 256 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = itertools.count(256)
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def merge_scan(parts: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """``parts`` after all merges; ``pairs`` maps two adjacent ids to rank << ID_BITS | merged id."""
    look = pairs.get
    ranks = [look(p, NO_MERGE) for p in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least == NO_MERGE:
            break
        i = ranks.index(least)
        parts[i] = merged = least & ((1 << ID_BITS) - 1)
        del parts[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = look((merged, parts[i + 1]), NO_MERGE)
        if i:
            ranks[i - 1] = look((parts[i - 1], merged), NO_MERGE)
    return parts


def merge_heap(parts: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same for long words in O(n log n)."""
    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(pairs[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i, pair = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or (parts[i], parts[j]) != pair:
            continue
        parts[i], alive[j], after[i] = rank & ((1 << ID_BITS) - 1), False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (parts[left], parts[right]) in pairs:
                pair = parts[left], parts[right]
                heapq.heappush(heap, (pairs[pair], left, pair))
    return [p for p, a in zip(parts, alive) if a]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a in self.vocab and b in self.vocab and a + b in self.vocab:
                self.pairs[self.vocab[a], self.vocab[b]] = rank << ID_BITS | self.vocab[a + b]
        alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in alphabet]
        self.last = [self.vocab.get(c + end) for c in alphabet]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.of_chunk: dict[str, list[int]] = {}
        self.of_word: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        got = self.of_word.get(word)
        if got is None:
            raw = word.encode("utf-8", "surrogatepass")
            parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
            parts = [p for p in parts if p is not None]
            got = merge_scan(parts, self.pairs) if len(parts) <= SCAN_LIMIT else merge_heap(parts, self.pairs)
            if len(word) < 64:
                if len(self.of_word) >= WORDS_KEPT:
                    self.of_word.clear()
                self.of_word[word] = got
        return got

    def split(self, chunk: str) -> list[str]:
        """The pattern's matches, with the library's character tables."""
        if chunk.isascii():
            return self.words.findall(chunk)
        return [chunk[m.start():m.end()] for m in self.words.finditer(_NEWER.sub("!", chunk))]

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a run of text without white space (no pre-token crosses white space)."""
        got = self.of_chunk.get(chunk)
        if got is None:
            got = [i for w in self.split(chunk) for i in self.word(w)]
            if len(chunk) < 64:
                if len(self.of_chunk) >= CHUNKS_KEPT:
                    self.of_chunk.clear()
                self.of_chunk[chunk] = got
        return got

    def _plain(self, text: str) -> list[int]:
        text = unicodedata.normalize("NFC", text)
        # each character by itself: a capital sigma at a word's end becomes no final sigma
        text = text.replace("Σ", "σ").lower()
        chunks = _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()
        return list(itertools.chain.from_iterable(map(self.chunk, chunks)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if "<" not in text:
            return self._plain(text)
        ids: list[int] = []
        for i, section in enumerate(self.special_at.split(text)):
            ids += [self.special[section]] if i % 2 else self._plain(section)
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder a worker process and vocabulary."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(pa.int64()), pa.array([bpe.encode(t) for t in piece.column(1).to_pylist()], pa.list_(pa.int32()))],
                    ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids)."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = word_bpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x) for x in b.column(1).to_pylist()], pa.string())],
                                             ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding, then decoding its ids, digested in the
    same task so that neither leaves it."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = word_bpe(path)
        decimal = {i: str(i) for i in bpe.tokens}

        def sha(text):
            return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(decimal.__getitem__, ids))))
                text_sha.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")) \
        .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
