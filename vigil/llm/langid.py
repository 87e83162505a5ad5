"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language.  A
word's likelihood is the sum over all its segmentations into pieces (forward
algorithm); a text's is the product over its words; the language with the largest
posterior wins.

Training reads (language, word, count) from at most about ``SAMPLE_DOCS`` labelled
documents a language (the documented bound: a hash of the id against the
language's document count, so each document has the same chance) and re-estimates
the pieces' probabilities by expected counts over all segmentations, a Spark job
an iteration.  What reaches the driver is the model: pieces times languages.

Words are maximal runs of letters in lower case; a run over ``LONGEST_RUN`` letters
is scored in stretches of that length, so the whole text counts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text if there is nothing to learn from; equal posteriors go to the smaller
language name; rows without an id are predicted, not learned from, and are not held
out; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Stored

SAMPLE_DOCS = 1000
ITERATIONS = 2
SMOOTHING = 0.05         # added to each expected count
LEAST_COUNT = 0.01       # expected uses under which a piece counts as unused
UNKNOWN = 1e-9           # probability of a character that is no piece, in any language
LONGEST_RUN = 64
WORDS_KEPT = 1 << 17
CHUNK = 1 << 16          # runs scored in one go
UNDETERMINED = "und"
WORD_START = "▁"

_RUN = re.compile(r"[^\W\d_]+")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def vocabulary_pieces(path: str) -> tuple[str, ...]:
    """The lower-case pieces of a sentencepiece file that consist of letters (and the word start)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return tuple(p for p in pieces if p == p.lower() and (p.removeprefix(WORD_START).isalpha() or p == WORD_START))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: a fifth, by checksum of the id's text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(5) == F.lit(0), F.lit(False))


def letter_runs(text: str) -> list[str]:
    """Runs of word characters; a run may hold characters that are no letters (see ``stretches``)."""
    return _RUN.findall(unicodedata.normalize("NFC", text).lower())


def stretches(run: str) -> list[str]:
    """The letters of a run: cut at other characters, then into lengths of LONGEST_RUN at most."""
    words = [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
    return [w[i:i + LONGEST_RUN] for w in words for i in range(0, len(w), LONGEST_RUN)]


# --- the forward algorithm ---------------------------------------------------------------------------------

def arcs(word: str, pieces: dict, longest: int):
    """(start, end, value) of every piece in the word, by end; characters that are no piece come as None."""
    chars = WORD_START + word
    for end in range(1, len(chars) + 1):
        for start in range(max(0, end - longest), end):
            value = pieces.get(chars[start:end])
            if value is not None:
                yield start, end, value
            elif end - start == 1:
                yield start, end, None


class Automaton:
    """The pieces as a table of states by character, so that many words go through it at once."""

    def __init__(self, pieces: dict[str, tuple[float, ...]], n_langs: int):
        chars = sorted({c for p in pieces for c in p})
        self.index = {c: i for i, c in enumerate(chars)}
        self.longest = max(map(len, pieces), default=1)
        steps: list[dict[int, int]] = [{}]
        values = {}
        for piece, value in pieces.items():
            state = 0
            for c in piece:
                if self.index[c] not in steps[state]:
                    steps[state][self.index[c]] = len(steps)
                    steps.append({})
                state = steps[state][self.index[c]]
            values[state] = value
        self.dead = len(steps)                                    # no piece begins like this
        self.next = np.full((len(steps) + 1, len(chars) + 1), self.dead, np.int32)  # last column: any other character
        self.value = np.zeros((len(steps) + 1, n_langs))
        for state, by_char in enumerate(steps):
            for c, to in by_char.items():
                self.next[state, c] = to
        for state, value in values.items():
            self.value[state] = value
        self.known = np.append(self.value[self.next[0]].any(axis=1)[:-1], False)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """log P(word) in each language, summed over all segmentations: the forward algorithm."""
        out = np.empty((len(words), self.value.shape[1]))
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        other = len(self.index)
        for length, at in by_length.items():
            chars = np.array([[self.index.get(c, other) for c in WORD_START + words[i]] for i in at], np.int32)
            ahead = np.zeros((length + 2, len(at), out.shape[1]))
            ahead[0] = 1.0
            for start in range(length + 1):
                state = np.zeros(len(at), np.int32)
                for end in range(start, min(length + 1, start + self.longest)):
                    state = self.next[state, chars[:, end]]
                    ahead[end + 1] += ahead[start] * self.value[state]
                    if (state == self.dead).all():
                        break
                ahead[start + 1] += ahead[start] * np.where(self.known[chars[:, start]], 0.0, UNKNOWN)[:, None]
            with np.errstate(divide="ignore"):
                out[at] = np.maximum(np.log(ahead[-1]), -700.0)
        return out


def expected_counts(word: str, pieces: dict[str, float], longest: int) -> dict[str, float]:
    """Expected number of uses of each piece over all segmentations of the word."""
    chars = WORD_START + word
    found = [(s, e, UNKNOWN if p is None else p) for s, e, p in arcs(word, pieces, longest)]
    ahead, behind = [1.0] + [0.0] * len(chars), [0.0] * len(chars) + [1.0]
    for s, e, p in found:
        ahead[e] += ahead[s] * p
    for s, e, p in reversed(found):
        behind[s] += p * behind[e]
    total, out = ahead[-1], defaultdict(float)
    if total > 0.0:
        for s, e, p in found:
            out[chars[s:e]] += ahead[s] * p * behind[e] / total
    return out


# --- training ------------------------------------------------------------------------------------------------

def training_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text) of the labelled documents to learn from."""
    usable = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text"), docs["lang"].cast("string").alias("lang")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    sizes = Stored(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "langid-sizes").df  # a row a language
    chance = (F.xxhash64("id", F.lit("sample")).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    return usable.join(sizes, "lang").where(chance * F.col("_n") < F.lit(sample_docs)).select("lang", "text")


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) over the sample."""
    def words(batches):
        for b in batches:
            seen: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for run in letter_runs(text):
                    for w in stretches(run):
                        seen[lang, w] += 1
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                                  pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    return sample.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _reestimate(words: DataFrame, probs: dict[str, dict[str, float]] | None, pieces: tuple[str, ...]) -> dict[str, dict[str, float]]:
    """Expected counts of the pieces by language, from probabilities by language (None: all equal)."""
    longest = max(map(len, pieces))
    uniform = dict.fromkeys(pieces, 1.0 / len(pieces)) if probs is None else None

    def run(batches):
        out: dict[tuple[str, str], float] = defaultdict(float)
        for b in batches:
            for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                for piece, c in expected_counts(word, uniform or probs[lang], longest).items():
                    out[lang, piece] += n * c
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()),
                                              pa.array(list(out.values()), pa.float64())], ["lang", "piece", "c"])

    got: dict[str, dict[str, float]] = defaultdict(dict)
    # at most pieces x languages rows
    for r in words.mapInArrow(run, "lang string, piece string, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).toLocalIterator():
        got[r["lang"]][r["piece"]] = r["c"]
    return got


class Model:
    """Languages, log priors, and the probability of each piece in each language."""

    def __init__(self, langs: list[str], priors: list[float], pieces: dict[str, tuple[float, ...]]):
        self.uid, self.langs, self.priors, self.pieces = uuid.uuid4().hex, langs, priors, pieces


def train(docs: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS, iterations: int = ITERATIONS) -> Model:
    pieces = vocabulary_pieces(vocabulary or default_vocabulary())
    words = Stored(word_counts(training_sample(docs, sample_docs)), "langid-words").df.repartition(F.xxhash64("lang", "word"))
    counts, probs = {}, None
    for _ in range(iterations):
        counts = _reestimate(words, probs, pieces)
        probs = {}
        for lang, c in counts.items():
            total = sum(c.get(p, 0.0) for p in pieces) + SMOOTHING * len(pieces)
            probs[lang] = {p: (c.get(p, 0.0) + SMOOTHING) / total for p in pieces}
    return build_model(counts, pieces)


def build_model(counts: dict[str, dict[str, float]], pieces: tuple[str, ...]) -> Model:
    """The model of the expected counts.  Longer pieces that no language uses tell nothing apart and are
    left out; single characters stay."""
    langs = sorted(counts)
    if not langs:
        return Model([], [], {})
    used = [p for p in pieces if len(p) == 1 or any(counts[x].get(p, 0.0) > LEAST_COUNT for x in langs)]
    totals = {x: sum(counts[x].get(p, 0.0) for p in used) + SMOOTHING * len(used) for x in langs}
    return Model(langs, [-math.log(len(langs))] * len(langs),
                 {p: tuple((counts[x].get(p, 0.0) + SMOOTHING) / totals[x] for x in langs) for p in used})


# --- prediction ----------------------------------------------------------------------------------------------

class Scorer:
    """Scores texts; the likelihoods of runs are kept (bounded, emptied when full)."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.automaton = Automaton(model.pieces, len(model.langs))
        self.table = np.zeros((1024, len(model.langs) + 1))  # log likelihoods, then the number of letters

    def _learn(self, runs: list[str]) -> None:
        new = [r for r in dict.fromkeys(runs) if r not in self.rows]
        if len(self.rows) + len(new) > max(WORDS_KEPT, len(new)):
            self.rows.clear()
            new = list(dict.fromkeys(runs))
        while len(self.table) < len(self.rows) + len(new):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        words, owner = [], []
        for r in new:
            self.rows[r] = row = len(self.rows)
            self.table[row] = 0.0
            for w in stretches(r):
                words.append(w)
                owner.append(row)
        if words:
            np.add.at(self.table, (np.array(owner)[:, None], np.arange(len(self.model.langs))[None, :]), self.automaton.likelihoods(words))
            np.add.at(self.table[:, -1], owner, [len(w) for w in words])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        m = self.model
        if not m.langs:
            return [(UNDETERMINED, 0.0)] * len(texts)
        totals = np.zeros((len(texts), self.table.shape[1]))
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, t in enumerate(texts):
            runs = letter_runs(t or "")
            for at in range(0, len(runs), CHUNK):  # a very long text goes in several parts
                held.append((i, runs[at:at + CHUNK]))
                size += len(held[-1][1])
                if size >= CHUNK:
                    self._add(totals, held)
                    held, size = [], 0
        self._add(totals, held)
        return [self._decide(t) for t in totals]

    def _add(self, totals: np.ndarray, held: list[tuple[int, list[str]]]) -> None:
        self._learn([r for _, runs in held for r in runs])
        for i, runs in held:
            totals[i] += self.table[list(map(self.rows.__getitem__, runs))].sum(axis=0)

    def _decide(self, total: np.ndarray) -> tuple[str, float]:
        if not total[-1]:
            return UNDETERMINED, 0.0
        score = total[:-1] + self.model.priors
        best = int(np.argmax(score))
        return self.model.langs[best], float(1.0 / np.exp(np.minimum(score - score[best], 0.0)).sum())


_LAST: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """The worker process's scorer of a model: tasks that follow in it find the words of earlier ones."""
    if model.uid not in _LAST:
        _LAST.clear()
        _LAST[model.uid] = Scorer(model)
    return _LAST[model.uid]


def prediction(text: Column, model: Model) -> Column:
    """Struct (lang_pred, score) of a text column."""
    def run(texts: pa.Array) -> pa.Array:
        own, out = scorer(model), []
        for at in range(0, len(texts), 512):  # few texts at a time become Python strings
            out += own.predict(texts.slice(at, 512).to_pylist())
        return pa.StructArray.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["lang_pred", "score"])

    # not to be copied into filters above it
    return F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()(text)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = model or train(docs)
    return docs.select(docs["doc_id"].alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"),
                       prediction(docs["text"], model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
