"""Token counts of a byte-pair tokenizer, compiled to a finite-state transducer.

The merges of a word are followed from left to right. Behind every letter stand
the token that ends there and the number of tokens so far: a token t may end
there exactly if no merge crosses the boundary between t and the token that ends
where t begins, and exactly one t fits. That is a deterministic transducer whose
transitions say how the token count changes. It is compiled as words come: its
states are the prefixes of words seen, and a word that has no transition yet
adds states from its longest known prefix on. Words over ``DEEP`` letters run
through the same rule without being kept; all it looks back at is a window as
long as the longest token. The end of a word has an output of its own.

White space puts the transducer back into its start state whatever came before.
So the map of a chunk of text, from entry state to exit state and count, is
known from three things: what stands before its first white space, the count
between, and what stands after its last. Such maps compose associatively:
a text is cut into chunks whose maps meet in a balanced scan. The chunks of a
text over ``LONG`` characters are mapped by as many tasks as there are; their small maps
then meet in one.

What is a letter, a number or white space, how letters become lower-case and
which marks are reordered depends on the Unicode version that a library was
built with. So ``Tokenizer.load`` asks the library about every code point, once,
on the driver; tasks get its answers as ranges.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, receive, send

LIMIT = 2048
CHUNK = 65_536
#: Texts of more characters are mapped in chunks of this size by several tasks.
LONG = 1 << 20
#: Longest prefix that becomes a state.
DEEP = 64
_STATES_KEPT = 400_000
_PAIRS_KEPT = 300_000
_WORDS_KEPT = 250_000
_END = "</w>"
#: Planes 0 to 3 and the assigned part of 14; no version of Unicode has letters, numbers, spaces or marks elsewhere.
POINTS = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 stays, others follow from U+0100 on."""
    stays = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in stays else chr(next(others)) for b in range(256)]


@cache
def character_ranges(kind: str, below: int = 0x110000) -> str:
    """What ``kind`` matches under the code point ``below``, by the library's own engine, as the inside of a character class."""
    from tokenizers import Regex, pre_tokenizers

    points = POINTS
    every = "".join(map(chr, points))
    found = pre_tokenizers.Split(Regex(f"[{kind}]+"), "removed", invert=True).pre_tokenize_str(every)
    runs = []
    for _, (start, end) in found:
        first, last = points[start], points[end - 1]
        # Runs that go over a gap between the points must not hold it.
        gaps = [(0xD7FF, 0xE000), (0x3FFFF, 0xE0000)]
        for before, after in gaps:
            if first <= before and after <= last:
                runs.append((first, before))
                first = after
        runs.append((first, last))
    return "".join(f"{re.escape(chr(x))}-{re.escape(chr(min(y, below - 1)))}" for x, y in runs if x < below)


@cache
def lower_case_exceptions() -> dict[int, str]:
    """Code points whose lower case the library sees otherwise than ``str.lower``."""
    from tokenizers import normalizers

    points = [c for c in POINTS if c != 10]
    lowered = normalizers.Lowercase().normalize_str("\n".join(map(chr, points))).split("\n")
    return {c: x for c, x in zip(points, lowered) if chr(c).lower() != x}


@cache
def unordered_marks() -> str:
    """Marks that newer versions of Unicode reorder or compose and the library doesn't: to it nothing moves over them."""
    from tokenizers import normalizers

    composed, probe = normalizers.NFC(), "\u0327\u0301"
    points = [c for c in POINTS if unicodedata.category(chr(c))[0] == "M" or unicodedata.combining(chr(c))]
    return "".join(chr(c) for c in points if unicodedata.normalize("NFC", f"a{chr(c)}{probe}") != composed.normalize_str(f"a{chr(c)}{probe}"))


@dataclass
class Tokenizer:
    """What of a tokenizer file, and of the library that reads it, decides the counts."""

    merges: list[tuple[str, str]]
    pattern: str
    #: The same pattern as far as it concerns Latin-1, for which the engine has a faster way.
    latin: str
    specials: list[str]
    space: str = " \\t-\\r"
    lower: dict[int, str] = field(default_factory=dict)
    unordered: str = ""

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        """A ``tokenizers`` file with NFC, white-space and lower-case normalisers, a split pattern and word-end merges."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in data["model"]["merges"]]
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or data["model"]["end_of_word_suffix"] != _END or data["model"]["ignore_merges"]:
            raise ValueError(f"{path} is not a tokenizer of this kind")
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        latin = pattern
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            pattern, latin = pattern.replace(kind, character_ranges(kind)), latin.replace(kind, character_ranges(kind, 256))
        if "\\p" in pattern:
            raise ValueError(f"{path} has a pattern of another kind")
        return cls(merges, pattern, latin, [t["content"] for t in data["added_tokens"]], character_ranges(r"\s"), lower_case_exceptions(), unordered_marks())


class WordTransducer:
    """Counts the tokens of a word given as byte letters."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.parts = {a + b: (r, a, b) for r, (a, b) in enumerate(merges)}
        self.reach = max((len(t.removesuffix(_END)) for t in self.parts), default=1)
        self.fits: dict[tuple[str, str], bool] = {}
        #: Of each merged token, whether its letters alone become it; None until asked.
        self.whole: dict[str, bool | None] = dict.fromkeys(self.parts)
        self.clear()

    def clear(self) -> None:
        #: By prefix: tokens so far, and the length of the last.
        self.states: dict[str, tuple[int, int]] = {"": (0, 0)}

    def _merge_between(self, left: str, right: str, until_left: int, until_right: int, own: int) -> bool:
        """Whether a merge other than ``own`` crosses the boundary of two tokens that meet.

        Goes back through the merges that made the two: at each moment the last
        part of ``left`` touches the first part of ``right``. Their merge happens
        if it comes before the one that takes either of them away. Of equal
        merges the one further left comes first.
        """
        rank, parts = self.rank, self.parts
        while True:
            r = rank.get((left, right))
            if r is not None and r < until_left and r <= until_right and r != own:
                return True
            made_left, made_right = parts.get(left), parts.get(right)
            if made_right is None:
                if made_left is None:
                    return False
                until_left, _, left = made_left
            elif made_left is not None and made_left[0] > made_right[0]:
                until_left, _, left = made_left
            else:
                until_right, right, _ = made_right

    def apart(self, left: str, right: str) -> bool:
        """Whether two tokens stay apart when they meet."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= _PAIRS_KEPT:
                self.fits.clear()
            never = len(self.rank)
            known = self.fits[left, right] = not self._merge_between(left, right, never, never, -1)
        return known

    def token(self, text: str) -> bool:
        """Whether the letters of ``text``, on their own, become one token."""
        known = self.whole.get(text)
        if known is None:
            made = self.parts.get(text)
            if made is None:
                return len(text.removesuffix(_END)) == 1
            r, a, b = made
            known = self.whole[text] = self.token(a) and self.token(b) and not self._merge_between(a, b, r + 1, r + 1, r)
        return known

    def _last(self, word: str, at: int, end: str, state) -> tuple[int, int]:
        """Tokens so far and length of the last token of the first ``at`` letters; ``state(j)`` says so of fewer."""
        whole = self.whole
        for start in range(max(0, at - self.reach), at):
            t = word[start:at] + end
            fits = whole.get(t, False)
            if fits is None or start == at - 1:
                fits = self.token(t)
            if fits:
                n, length = state(start)
                if not start or self.apart(word[start - length : start], t):
                    return n + 1, at - start
        raise AssertionError(f"no token ends {word[:at]!r}")

    def count(self, word: str) -> int:
        last = len(word) - 1
        if last > DEEP:
            path = [(0, 0)]
            for at in range(1, last + 1):
                path.append(self._last(word, at, "", path.__getitem__))
            return self._last(word, last + 1, _END, path.__getitem__)[0]
        states = self.states
        if len(states) > _STATES_KEPT:
            self.clear()
            states = self.states
        known = last
        while word[:known] not in states:
            known -= 1
        look = lambda j: states[word[:j]]
        for at in range(known + 1, last + 1):
            states[word[:at]] = self._last(word, at, "", look)
        return self._last(word, last + 1, _END, look)[0]


class _Known(dict):
    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = self.count(word)
        return value


class Counter:
    """Counts tokens of texts; what it compiled stays for later texts."""

    def __init__(self, tokenizer: Tokenizer):
        self.words = WordTransducer(tokenizer.merges)
        self.pattern, self.latin, self.wide = re.compile(tokenizer.pattern), re.compile(tokenizer.latin), re.compile(r"[^\x00-\xff]")
        self.simple = not any(c < 256 for c in tokenizer.lower) and not any(c < "\u0100" for c in tokenizer.unordered)
        self.specials = tokenizer.specials
        self.special = re.compile("|".join(map(re.escape, tokenizer.specials)))
        self.space = re.compile(f"[{tokenizer.space}]")
        self.lower = tokenizer.lower
        self.odd = re.compile(f"[Σ{''.join(re.escape(chr(c)) for c in tokenizer.lower)}]")
        self.unordered = re.compile(f"([{re.escape(tokenizer.unordered)}])") if tokenizer.unordered else None
        self.letters = byte_letters()
        self.known = _Known(self._word)

    def _word(self, word: str) -> int:
        if not (word.isascii() and word.isprintable()):
            word = "".join([self.letters[b] for b in word.encode("utf-8", "replace")])
        return self.words.count(word)

    def _piece(self, text: str) -> int:
        """Tokens of text without special strings."""
        if self.simple and not self.wide.search(text):
            return sum(map(self.known.__getitem__, self.latin.findall(text.lower())))
        if not unicodedata.is_normalized("NFC", text) or self.unordered and self.unordered.search(text):
            parts = self.unordered.split(text) if self.unordered else [text]
            text = "".join([unicodedata.normalize("NFC", part) for part in parts])
        # A sigma at the end of a word is like any other to the library.
        text = "".join([self.lower.get(ord(c)) or c.lower() for c in text]) if self.odd.search(text) else text.lower()
        return sum(map(self.known.__getitem__, self.pattern.findall(text)))

    def run(self, text: str) -> int:
        """Tokens of text whose ends cut no word."""
        if not any(s in text for s in self.specials):
            return self._piece(text)
        pieces = self.special.split(text)
        return sum(map(self._piece, pieces)) + len(pieces) - 1

    def chunk_map(self, text: str) -> tuple[str, int, str] | str:
        """The chunk's map: head, count, tail; or the chunk itself if it has no white space."""
        first = self.space.search(text)
        if first is None:
            return text
        last = len(text)
        while not self.space.match(text, last - 1):
            last -= 1
        return text[: first.start()], self.run(text[first.start() : last]), text[last:]

    def compose(self, a, b):
        """The map of two chunks one after the other."""
        if isinstance(a, str):
            return a + b if isinstance(b, str) else (a + b[0], b[1], b[2])
        if isinstance(b, str):
            return a[0], a[1], a[2] + b
        return a[0], a[1] + b[1] + self.run(a[2] + b[0]), b[2]

    def scan(self, maps: list) -> tuple[str, int, str] | str:
        """The map of chunks that follow each other, composed in pairs."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, found: tuple[str, int, str] | str) -> int:
        """Tokens of a whole text, by its map."""
        if isinstance(found, str):
            return self.run(found)
        return self.run(found[0]) + found[1] + self.run(found[2])

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if len(text) <= chunk:
            return self.run(text)
        return self.total(self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]))


def token_counts(docs: DataFrame, tokenizer: Tokenizer, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, long: int = LONG) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Defined cases: null counts as the empty text, which has no tokens; whole
    texts are counted, without begin or end tokens, those of more than ``long``
    characters chunk by chunk in several tasks; special strings in a text are
    one token each, as the library reads them; repeated rows are counted each,
    null ids and ids of any type pass through; other columns play no part; an empty table gives no rows.
    """
    sent, kind = send(docs, tokenizer), id_type(docs, id_col)
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(receive(sent))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(1).to_pylist()
                tokens = np.array([counter.count(t) for t in texts], np.int64)
                sizes = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                row += 1
                for nth, start in enumerate(range(0, len(text), long)):
                    values = batch.column(0).slice(i, 1), pa.array([row], pa.int64()), pa.array([nth], pa.int64()), pa.array([text[start : start + long]])
                    yield pa.RecordBatch.from_arrays(list(values), ["doc_id", "row", "nth", "chunk"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(receive(sent))
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = batch.column(3)[i].as_py()
                maps = [counter.chunk_map(chunk[k : k + CHUNK]) for k in range(0, len(chunk), CHUNK)]
                found = counter.scan(maps)
                head, count, tail = (found, -1, "") if isinstance(found, str) else found
                values = pa.array([len(chunk.encode("utf-8", "surrogatepass"))], pa.int64()), pa.array([head]), pa.array([count], pa.int64()), pa.array([tail])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), *values], ["doc_id", "row", "nth", "n_bytes", "head", "n", "tail"])

    def joined(group: pa.Table) -> pa.Table:
        counter = Counter(receive(sent))
        rows = group.sort_by("nth").to_pylist()
        tokens = counter.total(counter.scan([r["head"] if r["n"] < 0 else (r["head"], r["n"], r["tail"]) for r in rows]))
        return pa.table([group.column("doc_id").slice(0, 1), pa.array([sum(r["n_bytes"] for r in rows)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([tokens > limit])], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    result = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    is_long = F.coalesce(F.length("text"), F.lit(0)) > long
    chunks = rows.where(is_long).mapInArrow(cut, f"doc_id {kind}, row long, nth long, chunk string").repartition("row", "nth")
    maps = chunks.mapInArrow(mapped, f"doc_id {kind}, row long, nth long, n_bytes long, head string, n long, tail string")
    return rows.where(~is_long).mapInArrow(run, result).unionByName(maps.groupBy("row").applyInArrow(joined, result))
