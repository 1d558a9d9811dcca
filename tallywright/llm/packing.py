"""Packing token sequences into fixed windows by a histogram of lengths and non-negative least squares.

A document longer than the window is cut into whole windows and a rest. Rests fall into length classes (steps of
WINDOW/CLASSES tokens). Shallow combinations of classes that fill a window are listed; non-negative least squares
finds how often to repeat each so that the histogram of classes is used up; the counts are rounded down, and what
is left is packed greedily, largest class first. The solver sees the histogram alone, CLASSES numbers at any size
of input. The pieces themselves are numbered within their class by Spark and looked up in the list of repeats.

Null texts count as empty: one piece with the end-of-document id alone. Repeated rows are documents of their own.
Empty tables give empty results.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, numbered, saved

WINDOW_TOKENS = 2048
#: The id put after every document.
END_ID = 1
CLASSES = 128
#: Rests in one combination at most; the greedy rest may take more.
DEPTH = 3
#: Distinct space-led words that a worker remembers when it begins a chunk; if there are more, it keeps the half of this number that was used most.
MEMORY = 400_000
#: Distinct pieces without a blank (line ends, marks, words after them) that a worker remembers.
TAILS = 200_000
#: Characters that are encoded at once: the more, the fewer times a word is looked up.
CHUNK = 4_000_000

# White space at which the tokenizer's own splitting is not a plain "new piece before a lone blank".
_ODD = ("  ", "\n ", " \n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_ODD_WIDE = tuple("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# The pre-tokenizer's pieces of words without blanks, of ASCII and Latin letters, that start with no apostrophe.
_LATIN = "À-ÖØ-öø-ſ"
_PLAIN = re.compile(f"(?!')[\\x00-\\x7f{_LATIN}]+")
_PIECES = re.compile(f"'(?:[sdmt]|ll|ve|re)|[A-Za-z{_LATIN}]+|[0-9]+|[^\\sA-Za-z0-9{_LATIN}]+|\\s+(?!\\S)|\\s+")


def _odd(text: str) -> bool:
    return text[0] == " " or text[-1] == " " or any(x in text for x in _ODD) or not text.isascii() and any(x in text for x in _ODD_WIDE)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Words:
    """Remembered words and their ids, packed in arrays: some 75 bytes a word, where a dict of strings takes 220."""

    def __init__(self):
        self.names = pa.array([], type=pa.large_string())
        self.ids = np.empty(0, dtype="<u4")
        self.ends = np.zeros(1, dtype=np.int64)
        #: In how many chunks each was found, older ones counting less.
        self.uses = np.empty(0, dtype=np.int32)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the words are, -1 for those that are not remembered."""
        return pc.index_in(words, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def recalled(self, words: list[str]) -> dict[str, bytes]:
        """Those of the words that are remembered."""
        places = self.places(pa.array(words, type=pa.large_string()))
        first, last = self.ends[places].tolist(), self.ends[places + 1].tolist()
        return {w: self.ids[a:z].tobytes() for w, p, a, z in zip(words, places.tolist(), first, last, strict=True) if p >= 0}

    def add(self, words: list[str], coded: dict[str, bytes]) -> np.ndarray:
        """Remembers all that ``coded`` has, and returns the places of ``words``, which are new."""
        names = list(dict.fromkeys([*words, *coded]))
        raw = list(map(coded.__getitem__, names))
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
        begin = len(self.uses)
        self.names = pa.concat_arrays([self.names, pa.array(names, type=pa.large_string())])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), dtype="<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(names), dtype=np.int32)])
        return np.arange(begin, begin + len(words))

    def taken(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` each begins, and how many it has; they count as used once more."""
        self.uses[places] += 1
        return self.ends[places], self.ends[places + 1] - self.ends[places]

    def forget(self, most: int) -> None:
        """Where there are more than ``most``, keeps the half of ``most`` that was used most."""
        if len(self.uses) <= most:
            return
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: most // 2])
        first, sizes = self.ends[keep], self.ends[keep + 1] - self.ends[keep]
        after = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(first - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)]
        self.ends = np.append(0, after)
        self.names = self.names.take(pa.array(keep))
        self.uses = self.uses[keep] // 2


class Tokenizer:
    """Ids of whole texts by a byte-level BPE file whose pre-tokenizer starts a piece at every lone blank.

    Because of that, a text is its first word and its blank-led words one after another, and the ids of each
    blank-led word are worked out once. A new word is put together from its pieces (letters, digits, marks), of which
    far fewer are new. Texts with other white space are encoded whole. All ids come from the ``tokenizers`` library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of an executor share its cores already
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.encode_special_tokens = True
        self.words = Words()
        self.tails: dict[str, bytes] = {}
        n = self.library.get_vocab_size()
        self.leads = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(n)])
        self.line = np.arange(n) == self.library.token_to_id("Ċ")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def coded(self, some: list[str], mark: str, marks: np.ndarray) -> dict[str, bytes]:
        """Ids of many pieces, encoded in a few texts with ``mark`` before each; they begin at the tokens that ``marks`` tells."""
        known: dict[str, bytes] = {}
        parts = [some[k : k + 2000] for k in range(0, len(some), 2000)]
        skip = 0 if mark == " " else 4  # a blank is part of the piece's first token, a line end is a token of its own
        for part in parts:
            coded = self.library.encode_batch_fast([mark + mark.join(part)], add_special_tokens=False)[0]
            ids = np.array(coded.ids, dtype="<u4")
            cuts = np.append(np.flatnonzero(marks[ids]), len(ids)) * 4
            if len(cuts) != len(part) + 1 or cuts[0]:  # a piece that does not split so: one by one
                known.update((w, self.whole(" " + w if mark == " " else w)) for w in part)
                continue
            raw, ends = ids.tobytes(), cuts.tolist()
            known.update(zip(part, map(raw.__getitem__, map(slice, (e + skip for e in ends), ends[1:])), strict=False))
        return known

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered, and of first pieces that were not either: whole where a word is one piece or no plain ones, else put together from pieces."""
        several = [w for w in words if not w.isalpha() and _PLAIN.fullmatch(w)]
        pieces = list(map(_PIECES.findall, several))
        heads = set(words).difference(several)
        known = self.words.recalled(list({p[0] for p in pieces}.difference(heads)))
        heads.update([p[0] for p in pieces])
        learned = self.coded(list(heads.difference(known)), " ", self.leads)
        known.update(learned)
        if len(self.tails) > TAILS:
            self.tails = {}
        tails = {t for p in pieces for t in p[1:]}.difference(self.tails)
        spaced = [t for t in tails if t.isspace()]
        self.tails.update(zip(spaced, map(self.whole, spaced), strict=True))
        self.tails.update(self.coded(list(tails.difference(spaced)), "\n", self.line))
        tail = self.tails.__getitem__
        learned.update([(w, b"".join((known[p[0]], *map(tail, p[1:])))) for w, p in zip(several, pieces, strict=True) if len(p) > 1])
        return learned

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers."""
        out = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if t and _odd(t):
                out[i] = self.whole(t)
            elif t:
                plain.append(i)
        if not plain:
            return out
        split = pc.split_pattern(pa.array([texts[i] for i in plain], type=pa.large_string()), " ")
        ends = split.offsets.to_numpy()
        words = split.flatten()
        begins = self.library.encode_batch_fast(words.take(pa.array(ends[:-1])).to_pylist(), add_special_tokens=False)
        led = np.ones(len(words), dtype=bool)
        led[ends[:-1]] = False
        found = words.filter(pa.array(led)).dictionary_encode()
        self.words.forget(MEMORY)
        places = self.words.places(found.dictionary)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            some = found.dictionary.take(pa.array(missing)).to_pylist()
            learned = self.learn(some)
            places[missing] = self.words.add(some, learned)
        first, sizes = self.words.taken(places)
        ids = self.words.ids
        which = found.indices.to_numpy()
        after = np.cumsum(sizes[which])
        flat = ids[np.repeat(first[which] - (after - sizes[which]), sizes[which]) + np.arange(after[-1] if len(after) else 0)]
        cuts = np.append(0, after)[ends - np.arange(len(ends))]  # a text's first word is not among the blank-led ones
        for i, begin, a, z in zip(plain, begins, cuts, cuts[1:], strict=False):
            out[i] = np.array(begin.ids, dtype="<u4").tobytes() + flat[a:z].tobytes()
        return out


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def cut(docs: DataFrame, path: Callable[[], str]) -> DataFrame:
    """Pieces of at most a window: PIECES. ``path`` gives the vocabulary file's place where the task runs."""

    def work(part: pa.Table) -> dict[str, list]:
        out: dict[str, list] = {x.split()[0]: [] for x in PIECES.split(", ")}
        end = np.array([END_ID], dtype="<u4").tobytes()
        for i, ids in zip(part["doc_id"].to_pylist(), tokenizer(path()).encode(part["text"].to_pylist()), strict=True):
            ids += end
            n = len(ids) // 4
            for at in range(0, n, WINDOW_TOKENS):
                raw = ids[at * 4 : (at + WINDOW_TOKENS) * 4]
                for name, value in (("doc_id", i), ("start", at), ("length", len(raw) // 4), ("ids_crc32", zlib.crc32(raw)), ("doc_tokens", n)):
                    out[name].append(value)
        return out

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), PIECES, work, chars=CHUNK)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """The x >= 0 with least |a x - b|, by active sets: columns enter by gradient, and leave when a step would make them negative."""
    n = a.shape[1]
    gram, wanted = a.T @ a, a.T @ b
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    small = 1e-9 * max(1.0, float(np.abs(wanted).max(initial=0)))
    for _ in range(rounds):
        gradient = wanted - gram @ x
        gradient[active] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= small:
            break
        active[j] = True
        while True:
            own = np.flatnonzero(active)
            trial = np.zeros(n)
            trial[own] = np.linalg.solve(gram[np.ix_(own, own)] + 1e-10 * np.eye(len(own)), wanted[own])
            bad = active & (trial <= 0)
            if not bad.any():
                x = trial
                break
            step = (x[bad] / np.maximum(x[bad] - trial[bad], 1e-300)).min()
            x = x + step * (trial - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


@cache
def combinations(classes: int = CLASSES, depth: int = DEPTH) -> tuple[tuple[int, ...], ...]:
    """Descending class numbers (1 to classes) that add up to ``classes``: they fill a window."""
    out = []
    for k in range(1, depth + 1):
        for head in combinations_with_replacement(range(classes, 0, -1), k - 1):
            last = classes - sum(head)
            if last > 0 and (not head or last <= head[-1]):
                out.append((*head, last))
    return tuple(out)


def plan(histogram: dict[int, int], classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination of classes, repeats) that use up the histogram exactly; every combination adds up to ``classes`` at most."""
    left = np.zeros(classes + 1, dtype=np.int64)
    for c, n in histogram.items():
        left[c] = n
    every = combinations(classes, depth)
    made: list[tuple[tuple[int, ...], int]] = []
    if left.any():
        a = np.zeros((classes, len(every)))
        for j, combo in enumerate(every):
            for c in combo:
                a[c - 1, j] += 1
        x = nnls(a, left[1:].astype(float))
        for j in np.argsort(-x):
            repeats = int(x[j] + 1e-6)
            if not repeats:
                break
            repeats = min([repeats, *(int(left[c]) // every[j].count(c) for c in set(every[j]))])
            if repeats > 0:
                for c in every[j]:
                    left[c] -= repeats
                made.append((every[j], repeats))
    while left.any():  # largest first; each turn uses up a class or what a combination can repeat
        room, combo, spare = classes, [], left.copy()
        while (fit := np.flatnonzero(spare[1 : room + 1])).size:
            c = int(fit[-1]) + 1
            combo.append(c)
            spare[c] -= 1
            room -= c
            if not room:
                break
        repeats = min(int(left[c]) // combo.count(c) for c in set(combo))
        for c in combo:
            left[c] -= repeats
        made.append((tuple(combo), repeats))
    return made


def pack(docs: DataFrame, path: Callable[[], str]) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded: every piece and its place.

    ``padded`` is the length of the sequence with its padding: 2048, or the tokens themselves where they are a
    power of two.
    """
    step = WINDOW_TOKENS // CLASSES
    pieces = saved(cut(docs, path).withColumn("_class", F.ceil(F.col("length") / step).cast("int")))
    histogram = {r["_class"]: r["n"] for r in pieces.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CLASSES rows
    rows = sum(histogram.values())
    placed = numbered(pieces, ["_class"], F.xxhash64("doc_id", "start", "ids_crc32"), ["doc_id", "start", "ids_crc32"], rows, "_rank")

    # For each class, runs of its ranks: (first rank, uses a sequence, first sequence id, slot in the combination).
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for combo, repeats in plan(histogram):
        for c in dict.fromkeys(combo):
            runs.setdefault(c, []).append((taken.get(c, 0), combo.count(c), sequence, combo.index(c)))
            taken[c] = taken.get(c, 0) + repeats * combo.count(c)
        sequence += repeats
    tables = {c: np.array(r, dtype=np.int64) for c, r in runs.items()}
    schema = f"{PIECES}, sequence_id long, _slot long"

    def assign(batches):
        for batch in batches:
            classes, ranks = batch.column("_class").to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            ids, slots = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
            for c in np.unique(classes):
                own = classes == c
                table = tables[int(c)]
                run = table[np.searchsorted(table[:, 0], ranks[own], side="right") - 1]
                place = ranks[own] - run[:, 0]
                ids[own], slots[own] = run[:, 2] + place // run[:, 1], run[:, 3] + place % run[:, 1]
            keep = [batch.column(x.split()[0]) for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(ids), pa.array(slots)], names=[x.split()[0] for x in schema.split(", ")])

    sequenced = placed.mapInArrow(assign, schema)
    inside = Window.partitionBy("sequence_id").orderBy("_slot")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    power = total.bitwiseAND(total - 1) == 0
    return sequenced.select(*[x.split()[0] for x in PIECES.split(", ")], "sequence_id", offset.alias("offset"), F.when(power, total).otherwise(WINDOW_TOKENS).cast("long").alias("padded"))
