"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The n-gram of three characters
is bound by permuting its letters' vectors by their place and multiplying them;
a text bundles (adds) the vectors of all its n-grams, a language those of its
training texts. A text is of the language whose prototype has the largest
cosine with it, after what all prototypes have in common is taken off both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, labelled_sample, materialize, receive, send

DIMENSIONS = 1024
#: At most so many labelled rows make the prototypes.
TRAINING_ROWS = 8000
UNDETERMINED = "und"
_PART = 128
#: Letters that are bundled at a time, and kinds of n-grams whose vectors exist at a time.
LETTERS = 1 << 18
KINDS = 2048
_letters: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    """The letter's vector, the same in every process; 0 is the gap between words."""
    found = _letters.get(code)
    if found is None:
        draw = np.random.Generator(np.random.PCG64([2718, code]))
        found = _letters[code] = (draw.integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)
    return found


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, every run of other characters one 0; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return codes
    kinds, place = np.unique(codes, return_inverse=True)
    is_letter = np.array([chr(c).isalpha() for c in kinds.tolist()])
    if not is_letter.any():
        return codes[:0]
    codes = np.where(is_letter[place], codes, 0)
    codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
    return codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]


def bundle(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of the texts, a row each, and which of them have letters.

    Texts are taken some ``LETTERS`` at a time, a longer one in pieces, so
    memory doesn't grow with them. All sums are whole numbers in double
    precision, exact whatever is summed first.
    """
    vectors = np.zeros((len(texts), DIMENSIONS))
    some = np.zeros(len(texts), bool)
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for letters in pieces_of(text):
            some[i] = True
            rows.append(i)
            parts.append(letters)
            size += len(letters)
            if size >= LETTERS:
                _add(vectors, rows, parts)
                rows, parts, size = [], [], 0
    if parts:
        _add(vectors, rows, parts)
    return vectors, some


def pieces_of(text: str | None) -> Iterator[np.ndarray]:
    """The text's letters in pieces of at most ``LETTERS``, each but the first starting with the two letters before it; nothing without letters."""
    letters = letters_of(text)
    for start in range(0, max(0, len(letters) - 2), LETTERS):
        yield letters[start : start + LETTERS + 2]


def _add(vectors: np.ndarray, rows: list[int], parts: list[np.ndarray]) -> None:
    """Add the n-gram vectors of each part to its row."""
    alphabet, codes = np.unique(np.concatenate(parts), return_inverse=True)
    base = len(alphabet)
    owner = np.repeat(rows, [len(p) for p in parts])
    piece = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    whole = piece[2:] == piece[:-2]
    grams = ((codes[:-2] * base + codes[1:-1]) * base + codes[2:])[whole]
    kinds, column = np.unique(grams, return_inverse=True)
    places, place = np.unique(owner[2:][whole], return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, place = column[order], place[order]
    plain = np.stack([letter_vector(int(c)) for c in alphabet])
    once, twice = np.roll(plain, 1, 1), np.roll(plain, 2, 1)
    for start in range(0, len(kinds), KINDS):
        low, high = np.searchsorted(column, (start, start + KINDS))
        k = kinds[start : start + KINDS]
        counts = np.bincount(place[low:high] * len(k) + column[low:high] - start, minlength=len(places) * len(k)).reshape(len(places), len(k))
        bound = twice[k // (base * base)] * once[k // base % base] * plain[k % base]
        vectors[places] += counts.astype(np.float32) @ bound.astype(np.float32)


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray
    common: np.ndarray

    @classmethod
    def of(cls, sums: dict[str, np.ndarray]) -> Profiles:
        names = sorted(sums)
        if not names:
            return cls([], np.zeros((0, DIMENSIONS)), np.zeros(DIMENSIONS))
        units = np.stack([sums[n] / (np.linalg.norm(sums[n]) or 1.0) for n in names])
        common = units.mean(0) if len(names) > 1 else np.zeros(DIMENSIONS)
        apart = units - common
        return cls(names, apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12), common)

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        vectors, some = bundle(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12) - self.common
        units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)
        # One language at a time, so that a row's sum doesn't depend on the rows beside it.
        cosines = np.stack([(units * p).sum(1) for p in self.prototypes], 1)
        best = cosines.argmax(1)
        score = np.clip((1 + cosines[np.arange(len(texts)), best]) / 2, 0, 1)
        return [self.languages[b] if s else UNDETERMINED for b, s in zip(best, some)], np.where(some, score, 0.0)


def train_on(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int, remainder: int) -> Profiles:
    """Prototypes from a bounded sample of rows with a language; each text counts the same."""
    sample = labelled_sample(docs, docs.select(id_col, lang_col), lang_col, TRAINING_ROWS, id_col=id_col, text_col=text_col, modulus=modulus, remainder=remainder)
    sample = materialize(sample.select("label", "text").repartition(16), "languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, _PART):
                part = batch.slice(start, _PART)
                vectors, some = bundle(part.column(1).to_pylist())
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                for name, vector, has in zip(part.column(0).to_pylist(), vectors, some):
                    if has:
                        sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "sums"])

    sums: dict[str, np.ndarray] = {}
    for row in sorted(sample.mapInArrow(run, "lang string, sums array<double>").collect()):
        sums[row["lang"]] = sums.get(row["lang"], 0) + np.asarray(row["sums"])
    return Profiles.of(sums)


def identify(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score``.

    ``lang_pred`` is ``und`` and the score 0 for a null text or one without
    letters, and for every text if nothing was learned. The score is the cosine,
    moved to 0..1; equal cosines go to the first language in alphabetical order.
    Very long texts are bundled whole, piece by piece; repeated rows are judged
    each, null ids and ids of any type pass through; other columns play no part;
    an empty table gives no rows.
    """
    sent = send(docs, profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = receive(sent)
        for batch in batches:
            for start in range(0, batch.num_rows, _PART):
                part = batch.slice(start, _PART)
                names, scores = own.identify(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, lang_pred string, score double")
