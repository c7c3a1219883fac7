"""Language identification with piece probabilities summed over all segmentations.

The pieces are those of a fixed public vocabulary. A language gives each piece a probability, a word
the sum, over all ways to cut it into pieces, of the products of their probabilities (a forward pass),
and a text the product over its words. Probabilities are fitted by expectation maximisation over the
same segmentations: word counts by language stay distributed, only expected piece counts (languages
times vocabulary) reach the driver. Words are runs of letters in lower case.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from millrace.llm.storage import staged
from millrace.llm.words import rows_of, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FIT_ROWS = 20_000  # documents the model is fitted on, about; chosen by hash
ROUNDS = 2
PRIOR = 2_000.0  # pieces' worth of all languages' distribution in each language's
UNKNOWN = 1e-7  # a character outside the vocabulary, in any language
LEAST_SCORE = 0.5
UNDECIDED = "und"
PLAIN = 40  # letters of a word that is scored together with others
TOGETHER = 4096  # words scored together
CACHE = 1 << 17  # words of a generation that a worker keeps scored; it keeps two
LONG = 48  # longer words are fitted in parts, for sums within the range of floats
_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"


class Model(NamedTuple):
    languages: list[str]
    pieces: dict[str, tuple[float, ...]]  # probabilities by language
    longest: int


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """Pieces of lower-case letters, with the mark of a word's start, and that mark itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    found = {model.id_to_piece(i) for i in plain}
    return sorted(p for p in found if p == _START or ((w := p.removeprefix(_START)).isalpha() and w == w.lower()))


def letters(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def expected_pieces(word: str, chance: dict[str, float], longest: int) -> dict[str, float]:
    """Expected number of each piece in a word, over all its segmentations."""
    marked = _START + word
    n = len(marked)
    forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    arcs = []
    for i in range(1, n + 1):
        for j in range(max(0, i - longest), i):
            p = chance.get(marked[j:i])
            if p is None and j == i - 1:
                p = UNKNOWN
            if p:
                arcs.append((j, i, p))
                forward[i] += forward[j] * p
    for j, i, p in reversed(arcs):
        backward[j] += backward[i] * p
    found: dict[str, float] = {}
    if forward[n] > 0:
        for j, i, p in arcs:
            if (piece := marked[j:i]) in chance:
                found[piece] = found.get(piece, 0.0) + forward[j] * p * backward[i] / forward[n]
    return found


def starts(pieces: dict[str, tuple[float, ...]]) -> dict[str, tuple[float, ...] | None]:
    """Every beginning of a piece: its probabilities, or None if it is no piece itself."""
    found: dict[str, tuple[float, ...] | None] = {p[:i]: None for p in pieces for i in range(1, len(p))}
    return found | pieces


def log_likelihoods(word: str, model: Model, begun: dict[str, tuple[float, ...] | None]) -> list[float]:
    """Log probability of a word in each language: the forward pass, scaled where it gets small.

    From each place the pieces that start there are followed until no piece begins so (``begun``).
    """
    marked, get = _START + word, begun.get
    n, languages = len(marked), len(model.languages)
    sums: list[list[float] | None] = [None] * (n + 1)
    sums[0], scale = [1.0] * languages, [0.0] * languages
    for j in range(n):
        here = sums[j]
        if j % 24 == 23:  # shift what is still to be read, language by language
            up = [1.0 / x if x > 0 else 1.0 for x in here]
            scale = [s - math.log(u) for s, u in zip(scale, up)]
            for i in range(j, min(n, j + model.longest) + 1):
                if sums[i]:
                    sums[i] = [x * u for x, u in zip(sums[i], up)]
            here = sums[j]
        i, known = j + 1, False
        while i <= n and (p := get(marked[j:i], 0)) != 0:
            if p:
                known = known or i == j + 1
                now = sums[i]
                sums[i] = [x + a * q for x, a, q in zip(now, here, p)] if now else [a * q for a, q in zip(here, p)]
            i += 1
        if not known:
            now = sums[j + 1]
            sums[j + 1] = [x + a * UNKNOWN for x, a in zip(now, here)] if now else [a * UNKNOWN for a in here]
    return [s + (math.log(x) if x > 0 else -745.0) for s, x in zip(scale, sums[n])]


def block_likelihoods(words: list[str], model: Model, ids: dict[str, int], chances: np.ndarray) -> np.ndarray:
    """The same for words of at most ``PLAIN`` letters together, a row each; their sums are within the range of floats.

    ``ids`` numbers the pieces, 0 for mere beginnings; row i of ``chances`` is piece i, the last one a character outside
    the vocabulary. Pieces are looked up word by word; the sums of all words then grow from place to place together.
    """
    get, unknown = ids.get, len(chances) - 1
    arcs: list[list[int]] = [[] for _ in range(PLAIN + 1)]  # by start: word, end, piece
    for row, word in enumerate(words):
        marked = _START + word
        n = len(marked)
        for j in range(n):
            found, i, known = arcs[j], j + 1, False
            while i <= n and (piece := get(marked[j:i], -1)) >= 0:
                if piece:
                    found += (row, i, piece)
                    known = known or i == j + 1
                i += 1
            if not known:
                found += (row, j + 1, unknown)
    sums = np.zeros((len(words), PLAIN + 2, len(model.languages)))
    sums[:, 0] = 1.0
    for j, found in enumerate(arcs):
        if found:
            row, end, piece = np.array(found).reshape(-1, 3).T
            np.add.at(sums, (row, end), sums[row, j] * chances[piece])
    last = sums[np.arange(len(words)), [len(w) + 1 for w in words]]
    return np.where(last > 0, np.log(np.maximum(last, 5e-324)), -745.0)


class _Scores(dict):
    """Row of a word in a growing table of log probabilities.

    Words are kept in two generations: when one is full the other is given up, but for the words met again in between.
    """

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.begun = starts(model.pieces)
        self.ids = dict.fromkeys(self.begun, 0) | {p: i + 1 for i, p in enumerate(model.pieces)}
        none = [0.0] * len(model.languages)
        rows = [none, *model.pieces.values(), [UNKNOWN] * len(none)]
        self.chances = np.array(rows, float).reshape(len(rows), len(none))
        self.table = np.zeros((1024, len(model.languages)))
        self.before: dict[str, int] = {}
        self.table_before = self.table

    def meet(self, words: set[str]) -> None:
        """Score words that are new, and not too long, together."""
        new = [w for w in words if w not in self and w not in self.before and len(w) <= PLAIN]
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            self._grow(len(self) + len(part))
            self.table[len(self) : len(self) + len(part)] = block_likelihoods(part, self.model, self.ids, self.chances)
            self.update(zip(part, range(len(self), len(self) + len(part))))

    def _grow(self, rows: int) -> None:
        while rows > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])

    def __missing__(self, word: str) -> int:
        row = len(self)
        self._grow(row + 1)
        known = self.before.get(word)
        self.table[row] = log_likelihoods(word, self.model, self.begun) if known is None else self.table_before[known]
        self[word] = row
        return row

    def turn(self) -> None:
        """Between texts: begin a generation if this one is full."""
        if len(self) > CACHE:
            self.before, self.table_before = dict(self), self.table
            self.clear()
            self.table = np.zeros((1024, len(self.model.languages)))


class _Shared:
    """A broadcast model and the words that a worker process has scored for it, over all its tasks.

    The worker gives up a broadcast as soon as it runs a task of a stage without it, and the scores with it: they
    would else take the memory of all later stages.
    """

    def __init__(self, model: Model) -> None:
        self.model = model

    @cached_property
    def scores(self) -> _Scores:
        return _Scores(self.model)


def classify(text: str | None, scores: _Scores) -> tuple[str, float]:
    return _decide(letters(text), scores)


def _decide(words: list[str], scores: _Scores) -> tuple[str, float]:
    if not scores.model.languages or not _has_letter(words):
        return UNDECIDED, 0.0
    rows = np.fromiter(map(scores.__getitem__, words), np.int64, len(words))
    total = scores.table[rows].sum(axis=0)
    best = int(total.argmax())
    return scores.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def _sums(found: dict[tuple[str, str], float], name: str, kind: pa.DataType) -> pa.RecordBatch:
    """Rows (lang, ``name``, n) of sums by language and word or piece."""
    languages, names = ([key[i] for key in found] for i in (0, 1))
    columns = [pa.array(languages, pa.string()), pa.array(names, pa.string()), pa.array(list(found.values()), kind)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", name, "n"])


def fit(docs: DataFrame, path: str = VOCABULARY, rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Fit on the ``text`` and ``lang`` of ``docs``; of more than ``rows`` labelled ones, on about so many by hash.

    Rows without text or language are left out. Without any the model has no language. The model holds one number
    for each piece and language; ``lang`` is expected to name languages, so a few hundred at most.
    """
    spark = docs.sparkSession
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    share = min(1.0, rows / max(1, labelled.count()))
    chosen = labelled.where((F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in rows_of(batch, "lang", "text"):
                found.update((lang, w) for w in letters(text))
            yield _sums(found, "word", pa.int64())

    words = chosen.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = staged(words, "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    pieces = vocabulary(path)
    longest = max(map(len, pieces))
    chances = {lang: dict.fromkeys(pieces, 1.0 / len(pieces)) for lang in languages}
    probabilities = np.empty((0, 0))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chances)

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, str], float] = {}
            for batch in batches:
                for lang, word, n in rows_of(batch, "lang", "word", "n"):
                    for at in range(0, len(word), LONG):
                        for piece, x in expected_pieces(word[at : at + LONG], shared.value[lang], longest).items():
                            sums[lang, piece] = sums.get((lang, piece), 0.0) + n * x
            yield _sums(sums, "piece", pa.float64())

        counts = words.mapInArrow(expected, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        found = {(r[0], r[1]): r[2] for r in counts.collect()}
        table = np.array([[found.get((lang, p), 0.0) for lang in languages] for p in pieces])
        everywhere = (table.sum(axis=1, keepdims=True) + 0.01) / (table.sum() + 0.01 * len(pieces))
        probabilities = (table + PRIOR * everywhere) / (table.sum(axis=0) + PRIOR)
        chances = {lang: dict(zip(pieces, probabilities[:, i].tolist())) for i, lang in enumerate(languages)}
    return Model(languages, {p: tuple(row) for p, row in zip(pieces, probabilities.tolist())}, longest)


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may be learnt from: crc32 of the id as text leaves no 2 when divided by 4. None without id."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1), computed from ``text`` alone, to all columns of ``docs``.

    NULL, and text without a letter, is ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_Shared(model))
    docs = docs.drop("lang_pred", "score")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value.scores
        for batch in slices(batches, 256):
            names, values = [], []
            texts = [letters(text) for (text,) in rows_of(batch, "text")]
            if scores.model.languages:
                scores.meet({w for words in texts for w in words})
            for words in texts:
                name, value = _decide(words, scores)
                names.append(name)
                values.append(value)
            scores.turn()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(values, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    out = StructType([*schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, out)


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE, **options) -> DataFrame:
    """Documents whose language is decided with a score of at least ``least``; the model is fitted on ``docs``."""
    model = fit(training_rows(docs), **options)
    scored = predict(docs, model).where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= least))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns])
