"""Toxicity from subword-bag embeddings and a linear softmax.

Words are cut into hashed character n-grams. The vectors of all n-grams in a
window of a few words are averaged and a two-class softmax sits on the average;
vectors and softmax are trained together by Adam, in numpy, in one task. A
misspelt word that training never saw shares most of its n-gram vectors with
the word it bends.

A document says one thing and its label covers all of it, so an average over
the whole of a long text drowns the words that matter. The score is that of the
most toxic window, and training follows: a first fit on whole texts, then
rounds that refit on the windows which the model finds most toxic, those of
non-toxic texts gathering over the rounds. A logistic fit on rows kept out of
training turns the top window's logit into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, labelled_sample, receive, send

BUCKETS = 1 << 17
DIMENSIONS = 8
NGRAMS = (3, 4, 5, 6)
#: At most so many labelled rows are used for training ...
TRAINING_ROWS = 4500
#: ... none of them with a text of more characters than this; such rows give their place to others.
TRAINING_LENGTH = 20_000
#: N-grams of fewer training texts than this say nothing: their vectors stay zero.
LEAST_TEXTS = 4
WINDOW = 3
REPEAT = 8
ROUNDS = 5
FIRST_EPOCHS = 4
#: Weight of texts without known n-grams in each batch.
UNKNOWN = 0.3
THRESHOLD = 0.7
#: In the calibration a toxic row weighs as much as so many calm ones: missing one is the greater harm.
TOXIC_WEIGHT = 3.0
#: Characters that are scored at a time, whether of many texts or of a piece of one.
PIECE = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_WORDS_KEPT = 200_000
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams and of the words themselves, with marks at both ends: a flat array, and where each word's part ends.

    All words are hashed at once: an n-gram's hash is that of the n-gram one
    shorter, times a prime, plus the next letter; longest n-grams go on to the whole word.
    """
    text = "".join([f"<{w}>" for w in words])
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(letters))
    found, owners = [], []
    rolling = letters + np.uint64(1)
    for n in range(2, int(sizes.max(initial=0)) + 1):
        # Beyond the longest n-grams only whole words go on.
        at = np.flatnonzero(left >= n) if n <= max(NGRAMS) else (ends - sizes)[sizes >= n]
        rolling[at] = rolling[at] * _PRIME + letters[at + n - 1] + np.uint64(1)
        if n in NGRAMS:
            some = at[(sizes[owner[at]] != n)]
            found.append(rolling[some] ^ np.uint64(n))
            owners.append(owner[some])
        whole = (ends - sizes)[sizes == n]
        found.append(rolling[whole] ^ np.uint64(77))
        owners.append(owner[whole])
    if not found:
        return np.empty(0, np.int32), np.zeros(len(words), np.int64)
    hashes, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    hashes = hashes[order] * _MIX
    hashes ^= hashes >> np.uint64(32)
    return (hashes % np.uint64(buckets)).astype(np.int32), np.cumsum(np.bincount(owners, minlength=len(words)))


class _Lexicon:
    """Numbers for the words of training texts, and the buckets of each word in one flat array.

    Texts are kept as numbers, and n-grams are spread out for a few texts or words at a time only.
    """

    def __init__(self, texts: Iterable[str | None], buckets: int = BUCKETS):
        self.buckets, self.number = buckets, {}
        self.texts = [self._numbers(t) for t in texts]
        words = list(self.number)
        made = [subwords(words[i : i + 4096], buckets) for i in range(0, len(words), 4096)]
        self.flat = np.concatenate([flat for flat, _ in made] or [np.empty(0, np.int32)])
        self.starts = np.r_[0, np.cumsum(np.concatenate([np.diff(ends, prepend=0) for _, ends in made] or [np.zeros(0, np.int64)]))].astype(np.int32)
        held = np.zeros(buckets, np.int32)
        for words in self.texts:
            held[np.unique(self.spread(np.unique(words))[0])] += 1
        self.known = held >= LEAST_TEXTS

    def _numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        for word in words:
            self.number.setdefault(word, len(self.number))
        return without_repeats(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))

    def spread(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words, one after the other, and how many each has."""
        first, sizes = self.starts[words], self.starts[words + 1] - self.starts[words]
        ends = np.cumsum(sizes, dtype=np.int32)
        return self.flat[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(first - ends + sizes, sizes)], sizes

    def gains(self, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By word number, the summed gain of its buckets and how many they are."""
        if not self.number:
            return np.zeros(0), np.zeros(0)
        return np.add.reduceat(gain[self.flat].astype(np.float64), self.starts[:-1]), np.diff(self.starts).astype(np.float64)


def without_repeats(numbers: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """Without the numbers that stood within the last ``REPEAT`` places of the same owner, so that repetition adds nothing.

    With owners, the places that stay are returned instead of the numbers.
    """
    again = np.zeros(len(numbers), bool)
    for k in range(1, min(REPEAT + 1, len(numbers))):
        same = numbers[k:] == numbers[:-k]
        again[k:] |= same if owner is None else same & (owner[k:] == owner[:-k])
    return numbers[~again] if owner is None else np.flatnonzero(~again)


def window_means(numbers: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean gain of every window of ``WINDOW`` words; one window if there are fewer."""
    if not len(numbers):
        return np.zeros(1)
    sums, counts = sums[numbers], counts[numbers]
    width = min(WINDOW, len(numbers))
    count = len(numbers) - width + 1
    return sum(sums[k : k + count] for k in range(width)) / sum(counts[k : k + count] for k in range(width))


class _Gains(dict):
    """Number of a word, with what its n-grams add to a window and how many they are in arrays by number."""

    def __init__(self, gain: np.ndarray):
        super().__init__()
        self.gain = gain
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def numbers(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self)
        if len(self) + len(new) > _WORDS_KEPT:
            self.clear()
            new = set(words)
            self.sums, self.counts = np.zeros(0), np.zeros(0)
        if new:
            added = sorted(new)
            self.update(zip(added, range(len(self), len(self) + len(added))))
            flat, ends = subwords(added, len(self.gain))
            starts = np.r_[0, ends[:-1]]
            self.sums = np.r_[self.sums, np.add.reduceat(self.gain[flat].astype(np.float64), starts)]
            self.counts = np.r_[self.counts, (ends - starts).astype(np.float64)]
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def pieces_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text in pieces of about ``PIECE`` characters; a piece repeats the last words of the one before, so that no window is lost."""
    text = text or ""
    start, last = 0, []
    while True:
        end = start + PIECE
        while end < len(text) and (text[end].isalnum() or text[end - 1].isalnum()) and end < start + 2 * PIECE:
            end += 1
        words = last + words_of(text[start:end])
        yield words
        if end >= len(text):
            return
        start, last = end, words[-(WINDOW + REPEAT) :]


@dataclass
class SubwordSoftmax:
    """``gain[b]`` is what bucket ``b`` adds to the logit of an average, ``bias`` what every text has; ``slope`` and ``shift`` calibrate."""

    gain: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def word_gains(self) -> _Gains:
        return _Gains(self.gain)

    def loudest(self, pieces: list[list[str]], gains: _Gains) -> np.ndarray:
        """Logit of the top window of each piece; one without words has that of no evidence."""
        found = np.full(len(pieces), self.bias)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        numbers = gains.numbers([w for p in pieces for w in p])
        owner = np.repeat(np.arange(len(pieces)), sizes)
        stay = without_repeats(numbers, owner)
        numbers, owner = numbers[stay], owner[stay]
        if not len(numbers):
            return found
        sums, counts = np.cumsum(np.r_[0, gains.sums[numbers]]), np.cumsum(np.r_[0, gains.counts[numbers]])
        held = np.bincount(owner, minlength=len(pieces))
        ends = np.cumsum(held)
        at = np.arange(len(numbers))
        # A window starts at every word that has enough behind it, and at the first word of a shorter piece.
        width = np.minimum(WINDOW, held)[owner]
        at = at[at + width <= ends[owner]]
        width, owner = width[at], owner[at]
        means = (sums[at + width] - sums[at]) / (counts[at + width] - counts[at])
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        found[owner[starts]] += np.maximum.reduceat(means, starts)
        return found

    def scores(self, texts: list[str | None], gains: _Gains) -> np.ndarray:
        """Probability of each text; texts are scored some ``PIECE`` characters at a time."""
        top = np.full(len(texts), -np.inf)
        held, owner, size = [], [], 0

        def flush() -> None:
            if held:
                np.maximum.at(top, owner, self.loudest(held, gains))
            held.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for piece in pieces_of(text):
                held.append(piece)
                owner.append(i)
                size += min(PIECE, len(text or ""))
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -40, 40)))


def fit(rows: list[np.ndarray], labels: np.ndarray, lexicon: _Lexicon, *, dimensions: int = DIMENSIONS, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 7) -> SubwordSoftmax:
    """Train n-gram vectors and the softmax jointly on rows of word numbers.

    N-grams never seen add nothing, and every batch has a share of texts without
    known n-grams, not toxic, so that a text of unknown words isn't judged toxic
    for the lack of calm ones. With labels of one class only, every text gets that class's share, smoothed.
    """
    buckets = lexicon.buckets
    labels = np.asarray(labels, np.int64)
    kept = [i for i, r in enumerate(rows) if len(r)]
    positive = labels.sum() if len(labels) else 0
    if positive in (0, len(labels)) or not kept:
        share = (positive + 1) / (len(labels) + 2)
        return SubwordSoftmax(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))))
    draw = np.random.default_rng(seed)
    vectors = draw.normal(0, 0.1, (buckets, dimensions)).astype(np.float32)
    weights = draw.normal(0, 0.5, (dimensions, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen, slot = np.zeros(buckets, bool), np.zeros(buckets, np.int32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, weights, bias)]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(kept)
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            step += 1
            words = np.concatenate([rows[i] for i in chosen])
            of = np.repeat(np.arange(len(chosen), dtype=np.int32), [len(rows[i]) for i in chosen])
            index, sizes = lexicon.spread(words)
            owner = np.repeat(of, sizes)
            share = (1 / np.bincount(owner, minlength=len(chosen)))[owner].astype(np.float32)
            known = lexicon.known[index]
            index, owner, share = index[known], owner[known], share[known]
            unique = np.flatnonzero(np.bincount(index, minlength=buckets))
            slot[unique] = np.arange(len(unique))
            inverse = slot[index]
            held = vectors[unique]
            mean = np.stack([np.bincount(owner, held[inverse, d] * share, len(chosen)) for d in range(dimensions)], 1).astype(np.float32)
            logits = mean * 20 @ weights + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            delta = p.copy()
            delta[np.arange(len(chosen)), labels[chosen]] -= 1
            delta /= len(chosen)
            unknown = UNKNOWN * (np.exp(bias) / np.exp(bias).sum() - np.array([1, 0]))
            d_mean = 20 * delta @ weights.T
            seen[unique] = True
            d_vectors = np.stack([np.bincount(inverse, d_mean[owner, d] * share, len(unique)) for d in range(dimensions)], 1).astype(np.float32)
            for (first, second), value, gradient, at in ((state[0], vectors, d_vectors, unique), (state[1], weights, 20 * mean.T @ delta, ...), (state[2], bias, delta.sum(0) + unknown, ...)):
                first[at] = 0.9 * first[at] + 0.1 * gradient
                second[at] = 0.99 * second[at] + 0.01 * gradient**2
                value[at] -= rate * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.99**step)) + 1e-8)
    difference = weights[:, 1] - weights[:, 0]
    return SubwordSoftmax(np.where(seen, 20 * vectors @ difference, 0).astype(np.float32), float(bias[1] - bias[0]))


def train(texts: Iterable[str | None] | _Lexicon, labels: np.ndarray, *, rounds: int = ROUNDS) -> SubwordSoftmax:
    """Fit on whole texts, refit on top windows, calibrate on every fifth row."""
    labels, lexicon = np.asarray(labels, np.int64), texts if isinstance(texts, _Lexicon) else _Lexicon(texts)
    words = lexicon.texts
    fitted = np.arange(len(words)) % 5 != 4
    rows = np.flatnonzero(fitted)
    model = fit([words[i] for i in rows], labels[rows], lexicon, epochs=FIRST_EPOCHS, batch=16)
    if labels[rows].sum() in (0, len(rows)):
        return model
    calm = []
    for _ in range(rounds):
        gains, loud = lexicon.gains(model.gain), []
        for i in rows:
            means = window_means(words[i], *gains)
            for _ in range(1 if labels[i] else 2):
                at = int(means.argmax())
                (loud if labels[i] else calm).append(words[i][at : at + WINDOW])
                means[max(0, at - WINDOW + 1) : at + WINDOW] = -np.inf
                if np.isneginf(means).all():
                    break
        model = fit(loud + calm, np.r_[np.ones(len(loud)), np.zeros(len(calm))], lexicon, batch=256, rate=0.03)
    gains, kept = lexicon.gains(model.gain), np.flatnonzero(~fitted)
    top = np.array([model.bias + window_means(words[i], *gains).max() for i in kept])
    model.slope, model.shift = calibrate(top, labels[kept], model.bias)
    return model


def calibrate(logits: np.ndarray, labels: np.ndarray, quiet: float, steps: int = 3000) -> tuple[float, float]:
    """Slope and shift of a logistic fit, with half a count of each class so that it stays finite.

    ``quiet``, the logit without any evidence, joins the calm side with a tenth
    of all weight: a text of no known words is calm wherever the classes part.
    """
    if not len(labels):
        return 1.0, 0.0
    spread = max(1.0, float(logits.std()))
    x = np.r_[logits, logits.mean(), logits.mean(), quiet] / spread
    y, weight = np.r_[labels, 0, 1, 0], np.r_[np.where(labels == 1, TOXIC_WEIGHT, 1.0), 0.5, 0.5, max(1.0, 0.1 * len(labels))]
    slope, shift = spread, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -40, 40)))
        gap = (p - y) * weight / weight.sum()
        slope, shift = slope - 0.5 * (gap * x).sum(), shift - 0.5 * gap.sum()
    return max(1e-3, slope) / spread, shift


def train_on(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", modulus: int, remainder: int) -> SubwordSoftmax:
    """A model from at most ``TRAINING_ROWS`` labelled rows that aren't held out, with texts of at most ``TRAINING_LENGTH`` characters.

    Training runs in one task, to which those rows are sent: a lost executor
    costs another try with the same rows in the same order, and the driver
    holds the model only. A sample without rows gives the model of no rows.
    """
    short = docs.where(F.coalesce(F.length(text_col), F.lit(0)) <= TRAINING_LENGTH)
    sample = labelled_sample(short, labels, label, TRAINING_ROWS, id_col=id_col, text_col=text_col, modulus=modulus, remainder=remainder)
    rows = sample.select(F.xxhash64("doc_id").alias("draw"), "doc_id", "text", F.col("label").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[int] = []

        def texts() -> Iterator[str | None]:
            for batch in batches:
                labels.extend(batch.column(3).to_pylist())
                yield from (t.as_py() for t in batch.column(2))

        lexicon = _Lexicon(texts())
        model = train(lexicon, np.array(labels, np.int64))
        yield pa.RecordBatch.from_pydict({"gain": pa.array([model.gain.tobytes()], pa.binary()), "bias": [model.bias], "slope": [float(model.slope)], "shift": [float(model.shift)]})

    made = rows.repartition(1).sortWithinPartitions("draw", "doc_id").mapInArrow(run, "gain binary, bias double, slope double, shift double").collect()
    if not made:
        return train((), np.zeros(0))
    return SubwordSoftmax(np.frombuffer(made[0].gain, np.float32), made[0].bias, made[0].slope, made[0].shift)


def toxicity(docs: DataFrame, model: SubwordSoftmax, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``.

    Defined cases: a null, empty or wordless text has the score of no evidence,
    the model's bias alone; a very long text is scored piece by piece, its score
    is that of its loudest window; repeated rows are scored each, null ids and
    ids of any type pass through; other columns play no part; an empty table gives no
    rows. The model is broadcast: its size is ``BUCKETS``, whatever the input.
    """
    sent = send(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = receive(sent)
        gains = own.word_gains()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                scores = own.scores(part.column(1).to_pylist(), gains)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: SubwordSoftmax, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores under the threshold; whole rows pass through, so no join follows.

    Ids play no part: null and repeated ids, repeated rows and any other
    columns stay as they are. Null and wordless texts have the score of no
    evidence. An empty table stays empty.
    """
    sent, names = send(docs, model), docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = receive(sent)
        gains = own.word_gains()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield part.filter(pa.array(own.scores(part.column(place).to_pylist(), gains) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
