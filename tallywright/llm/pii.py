"""Personal data: patterns as a base, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments: their shape, size, digits and checks such as Luhn's, the words before
them, and the kind of the segment before. A segmentation's probability is its score's share among those of all
segmentations, summed by a forward recursion over segments of bounded length; training maximises the likelihood of
the true segmentations, with a quadratic penalty, and decoding takes the best one by the same recursion with maxima.

Entities are bounded: at most MAX_TOKENS tokens and MAX_CHARS characters, with a digit, an @ or a word that names
secrets or numbers just before. Base spans have no such bound. The field reads neighbourhoods of such tokens (REACH
tokens on either side, whatever their length); elsewhere no segment can be one.

It learns from neighbourhoods of a bounded sample of the documents, in which the base matches and the values of
named secrets are the truth, and from cases written out of the forms in this module (numbers and secrets in contexts
that no pattern has, and look-alikes that are none), put among words of the sample.

Base spans always stay; the field's spans are added where they overlap no base span, and where their score exceeds
that of no entity by MARGIN. Null and empty texts have no spans. Repeated rows give repeated results. Without
documents the field has the written cases alone. Reruns give equal weights.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

KINDS = ("email", "ip", "card", "phone", "secret", "id")
MAX_TOKENS = 6
MAX_CHARS = 256
#: Tokens on either side of a token of interest that are decoded with it.
REACH = 3
#: Documents whose neighbourhoods may be trained on: those with the smallest hashes of their ids.
SAMPLE = 4000
#: Of their neighbourhoods, at most this many of at most CASE_CHARS characters, those with the smallest hashes.
CASES = 1200
CASE_CHARS = 2000
#: Written cases.
WRITTEN = 900
PENALTY = 0.3
STEPS = 40
MARGIN = 1.0

# The base patterns. Where a run of characters fails at its first character it fails at all others,
# so the email scan starts from each @ and the address scan at the first digit of a run; matches are the same.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NAMES = r"passw|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key|credential|ssn|social.security|passport|tax.id|national.id"
_INTEREST = re.compile(rf"[0-9@]|(?i:{_NAMES})")
_NAME = re.compile(rf"(?i){_NAMES}|\b(?:key|id|pin)\b")
_CALLS = re.compile(r"(?i)\b(?:call|phone|tel|mobile|cell|fax|dial|ring|text|reach)")
_NAMED = re.compile(r"(?i:password|passwd|token|secret|api_?key)\s*[=:]\s*[\"']?([A-Za-z0-9_\-/+]{8,})")
_PREFIX = re.compile(r"[\"'(\[<{]*[A-Za-z_-]+\s*[=:]+\s*[\"']*")
_SHAPES = [(re.compile(p), r) for p, r in (("[A-Z]+", "A"), ("[a-z\u0080-\U0010ffff]+", "a"), ("[0-9]+", "0"))]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 * (d > 4)) if k % 2 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; places are code points."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    return [("secret", m.start(1), m.end(1)) for m in _NAMED.finditer(text)]


def _before(text: str, at: int, n: int) -> list[tuple[int, int]]:
    """The last n tokens that end before ``at``, however long they are."""
    width = 64
    while True:
        left = max(0, at - width)
        found = [(t.start() + left, t.end() + left) for t in _TOKEN.finditer(text[left:at])]
        if found and found[0][0] == left and left:  # may begin further to the left
            found = found[1:]
        if len(found) >= n or not left:
            return found[-n:] if n else []
        width *= 4


def neighbourhoods(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of tokens (start, end) around the tokens of interest; each stretch is decoded on its own."""
    out: list[list[tuple[int, int]]] = []
    done = 0
    for m in _INTEREST.finditer(text):
        if m.start() < done:
            continue
        spot = m.start()
        while spot < m.end() and text[spot] in " \t\n\x0b\f\r":
            spot += 1
        own = _before(text, spot, 1)
        begin = own[0][0] if own and own[0][1] == spot else spot
        after, at = [], begin
        while len(after) <= REACH and (t := _TOKEN.search(text, at)):
            after.append((t.start(), t.end()))
            at = t.end()
        done = max(after[0][1], m.end())
        stretch = _before(text, begin, REACH) + after
        if out and out[-1][-1][1] >= stretch[0][0]:
            last = out[-1][-1][0]
            out[-1].extend(x for x in stretch if x[0] > last)
        else:
            out.append(stretch)
    return out


def shape(s: str) -> str:
    for p, r in _SHAPES:
        s = p.sub(r, s)
    return s


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A segment without punctuation at its edges, and without the name of a secret before = or :."""
    if (m := _PREFIX.match(text, a, b)) and m.end() < b:
        a = m.end()
    while a < b and not (text[a].isalnum() or text[a] == "+" or text[a] == "(" and ")" in text[a:b]):
        a += 1
    while b > a and not (text[b - 1].isalnum() or text[b - 1] in "=_"):
        b -= 1
    return a, b


Segment = tuple[int, int]


def candidates(text: str, tokens: list[tuple[int, int]]) -> dict[Segment, list[str]]:
    """Segments (first token, one past the last) that may be entities, and what they look like as a whole."""
    out: dict[Segment, list[str]] = {}
    words = [text[a:b] for a, b in tokens]
    hot = [any(c in "0123456789@" for c in w) if len(w) <= MAX_CHARS else False for w in words]
    lead = [w[-32:].lower() for w in words]
    for i in range(len(tokens)):
        prior = " ".join(lead[max(0, i - 3) : i])
        named = _NAME.search(prior) is not None
        own = _PREFIX.match(words[i][:MAX_CHARS])
        named_here = own is not None and _NAME.search(own[0]) is not None
        near = shape(lead[i - 1])[-6:] if i else ""
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            a, b = tokens[i][0], tokens[j - 1][1]
            if b - a > MAX_CHARS:
                break
            if not (named or named_here or any(hot[i:j])) or j - i > 1 and not (hot[j - 1] and (hot[i] or named_here)):
                continue
            c, d = trimmed(text, a, b)
            if c >= d:
                continue
            s = text[c:d]
            digits = "".join(x for x in s if x in "0123456789")
            plain = not digits and "@" not in s
            n, letters = len(digits), sum(x.isalpha() for x in s)
            told = named or named_here
            mixed = n > 0 and letters > 0 and s.isascii() and j - i == 1
            out[i, j] = [
                "shape=" + shape(s),
                f"tokens={j - i},digits={min(n, 24)}",
                f"size={min(len(s), 64) // 4},told={told},mixed={mixed}",
                f"at={min(s.count('@'), 2)},dots={min(s.count('.'), 4)},told={told}",
                f"plus={s[:1] == '+'},digits={min(n, 24)},letters={letters > 0}",
                f"luhn={13 <= n <= 19 and luhn(digits)},only={letters == 0},digits={min(n, 24)}",
                f"told={told},plain={plain},long={len(s) >= 8},tokens={j - i}",
                f"hex={re.fullmatch('[0-9a-f]{16,}', s) is not None},upper={re.fullmatch('[A-Z0-9]{12,}', s) is not None},told={told}",
                f"calls={_CALLS.search(prior) is not None},letters={letters > 0},digits={min(n, 24)}",
                f"near={near}",
                f"word={lead[i - 1].strip('.,:;=()') if i else ''}",
                f"own={re.sub('[^a-z_]', '', own[0].lower()) if own else ''}",
                f"marks={''.join(sorted(set(x for x in s if not x.isalnum() and not x.isspace())))[:6]},letters={letters > 0}",
            ]
    return out


@dataclass
class Field:
    """A weight for each feature and kind, and one for each pair of neighbouring labels; label 0 is "no entity"."""

    rows: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def scores(self, features: list[str]) -> np.ndarray:
        found = [r for f in features if (r := self.rows.get(f)) is not None]
        return self.weights[found].sum(axis=0) if found else np.zeros(len(KINDS))


def decode(n: int, scores: dict[Segment, np.ndarray], steps: np.ndarray) -> list[tuple[str, int, int, float]]:
    """The best segmentation of n tokens: (kind, first token, one past the last, score) of its entities.

    best[j, y] is the best score of tokens 0 to j - 1 whose last segment has label y; a token outside scores 0.
    """
    labels = len(KINDS) + 1
    best = np.full((n + 1, labels), -np.inf)
    best[0, 0] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    ends: dict[int, list[int]] = {}
    for i, j in scores:
        ends.setdefault(j, []).append(i)
    for j in range(1, n + 1):
        come = best[j - 1] + steps[:, 0]
        y = int(come.argmax())
        best[j, 0], back[j, 0] = come[y], (j - 1, y)
        for i in ends.get(j, ()):
            come = best[i][:, None] + steps[:, 1:]
            froms = come.argmax(axis=0)
            total = come.max(axis=0) + scores[i, j]
            for k in np.flatnonzero(total > best[j, 1:]).tolist():
                best[j, k + 1], back[j, k + 1] = total[k], (i, int(froms[k]))
    out, j, y = [], n, int(best[n].argmax())
    while j > 0:
        i, before = back[j, y]
        if y:
            out.append((KINDS[y - 1], i, j, float(scores[i, j][y - 1] + steps[before, y] - steps[before, 0])))
        j, y = i, before
    return out[::-1]


Case = tuple[int, dict[Segment, list[str]], dict[Segment, str]]


def _batches(cases: list[Case], rows: dict[str, int]) -> list[tuple]:
    """Cases of like length side by side: for each its segments, their features, and the truth, as arrays."""
    out = []
    order = sorted(range(len(cases)), key=lambda c: cases[c][0])
    for at in range(0, len(order), 256):
        own = [cases[c] for c in order[at : at + 256]]
        n = max(c[0] for c in own)
        width = max((len(f) for c in own for f in c[1].values()), default=1)
        places, features, truth = [], [], []
        pairs = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        for c, (size, segments, true) in enumerate(own):
            for (i, j), names in segments.items():
                places.append((c, i, j))
                found = [rows[f] for f in names if f in rows]
                features.append(found + [len(rows)] * (width - len(found)))
                truth.append(KINDS.index(true[i, j]) if (i, j) in true else -1)
            at_, last = 0, 0
            starts = {i: (j, KINDS.index(k) + 1) for (i, j), k in true.items()}
            while at_ < size:
                j, label = starts.get(at_, (at_ + 1, 0))
                pairs[last, label] += 1
                at_, last = j, label
        out.append((np.array([c[0] for c in own]), n, np.array(places).reshape(-1, 3), np.array(features, dtype=np.int64).reshape(len(places), -1), np.array(truth, dtype=np.int64), pairs))
    return out


def _logsum(x: np.ndarray, axis: int | tuple[int, ...]) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def likelihood(batch: tuple, weights: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the cases of a batch and its gradients, by forward and backward recursions over segments."""
    sizes, n, places, features, truth, pairs = batch
    b, labels, kinds = len(sizes), len(KINDS) + 1, len(KINDS)
    padded = np.vstack([weights, np.zeros(kinds)])
    own = padded[features].sum(axis=1) if len(places) else np.zeros((0, kinds))
    emit = np.full((b, n + 1, MAX_TOKENS + 1, kinds), -np.inf)  # by case, end and length
    c, i, j = places.T
    emit[c, j, j - i] = own
    alpha = np.full((b, n + 1, labels), -np.inf)
    alpha[:, 0, 0] = 0.0
    for t in range(1, n + 1):
        alpha[:, t, 0] = _logsum(alpha[:, t - 1] + steps[:, 0], 1)
        reach = min(MAX_TOKENS, t)
        past = np.stack([alpha[:, t - k] for k in range(1, reach + 1)], axis=1)
        come = _logsum(past[:, :, :, None] + steps[None, None, :, 1:], 2)
        alpha[:, t, 1:] = _logsum(come + emit[:, t, 1 : reach + 1], 1)
    total = _logsum(alpha[np.arange(b), sizes], 1)
    beta = np.full((b, n + 1, labels), -np.inf)
    beta[np.arange(b), sizes] = 0.0
    for t in range(n - 1, -1, -1):
        parts = [steps[None, :, :1] + beta[:, t + 1, None, :1]]
        for k in range(1, min(MAX_TOKENS, n - t) + 1):
            parts.append(steps[None, :, 1:] + (emit[:, t + k, k] + beta[:, t + k, 1:])[:, None, :])
        fresh = _logsum(np.concatenate(parts, axis=2), 2)
        beta[:, t] = np.where((t < sizes)[:, None], fresh, beta[:, t])
    # Expected segments and label pairs.
    into = alpha[c, i][:, :, None] + steps[None, :, 1:] + (own + beta[c, j, 1:])[:, None, :] - total[c][:, None, None]
    chance = np.exp(into)
    plain = np.exp(alpha[:, :-1] + steps[:, 0] + beta[:, 1:, :1] - total[:, None, None])
    steps_up = pairs.copy()
    steps_up[:, 0] -= plain.sum(axis=(0, 1))
    steps_up[:, 1:] -= chance.sum(axis=0)
    miss = -chance.sum(axis=1)
    hit = truth >= 0
    miss[np.flatnonzero(hit), truth[hit]] += 1
    rise = np.zeros((len(weights) + 1, kinds))
    for k in range(kinds):
        rise[:, k] = np.bincount(features.ravel(), np.repeat(miss[:, k], features.shape[1]), len(weights) + 1) if len(places) else 0.0
    value = own[np.flatnonzero(hit), truth[hit]].sum() + (pairs * steps).sum() - total.sum()
    return float(value), rise[:-1], steps_up


def train(cases: list[Case]) -> Field:
    """Weights of the greatest penalised likelihood, by gradient steps with a memory of curvature."""
    rows: dict[str, int] = {}
    seen: dict[str, int] = {}
    for _, segments, _ in cases:
        for names in segments.values():
            for f in names:
                seen[f] = seen.get(f, 0) + 1
    for f in sorted(seen):
        if seen[f] > 1:
            rows[f] = len(rows)
    shape_, labels = (len(rows), len(KINDS)), len(KINDS) + 1
    size = shape_[0] * shape_[1]
    batches = _batches(cases, rows)

    def cost(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, steps = x[:size].reshape(shape_), x[size:].reshape(labels, labels)
        value, slope = PENALTY / 2 * float(x @ x), PENALTY * x
        for batch in batches:
            v, up, across = likelihood(batch, weights, steps)
            value -= v
            slope = slope - np.concatenate([up.ravel(), across.ravel()])
        return value, slope

    x = np.zeros(size + labels * labels)
    value, slope = cost(x)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS if cases else 0):
        way, marks = slope.copy(), []
        for s, y in reversed(memory):
            r = s @ way / (s @ y)
            marks.append(r)
            way = way - r * y
        if memory:
            s, y = memory[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), r in zip(memory, reversed(marks), strict=True):
            way = way + s * (r - y @ way / (s @ y))
        size_ = 1.0 if memory else 1.0 / max(1.0, float(np.abs(slope).max()))
        while size_ > 1e-6:
            there = x - size_ * way
            new, fresh = cost(there)
            if new <= value - 1e-4 * size_ * float(slope @ way):
                break
            size_ /= 2
        else:
            break
        s, y = there - x, fresh - slope
        if s @ y > 1e-10:
            memory = [*memory[-7:], (s, y)]
        done = value - new < 1e-4 * abs(value)
        x, value, slope = there, new, fresh
        if done:
            break
    weights = x[:size].reshape(shape_)
    kept = np.flatnonzero(np.abs(weights).max(axis=1) > 1e-3) if len(weights) else np.empty(0, np.int64)
    names = list(rows)
    return Field({names[k]: n for n, k in enumerate(kept)}, np.round(weights[kept], 6), np.round(x[size:].reshape(labels, labels), 6))


def case_of(text: str, tokens: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> Case:
    """A stretch with its candidates and the true segments: those whose trimmed ends a span has, else the fewest tokens that hold it."""
    segments = candidates(text, tokens)
    true: dict[Segment, str] = {}
    taken: set[int] = set()
    for kind, a, b in spans:
        inside = [k for k, (x, y) in enumerate(tokens) if x < b and y > a]
        if inside and (inside[0], inside[-1] + 1) in segments and not taken & set(inside):
            true[inside[0], inside[-1] + 1] = kind
            taken |= set(inside)
    return len(tokens), segments, true


#: Forms of the written cases: what stands before a value, and how values are made (# a digit, @ a letter, ^ a capital, * any of them, ~ a hexadecimal digit).
CONTEXTS = {
    "secret": (
        ("password is", "my password is", "password:", "the passwd", "passphrase:", "pwd", "pwd:", "secret:", "secret key", "the token is", "token", "api key", "api_key:", "access key", "access key id", "credential", "login password", "key:", "client secret is"),
        ("********", "@@@@@##", "@@@@@@#@@@@@@@##", "^@@@@@@###", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "AKIA^^^^#^^#^^^^#^^^", "************************", "@@@@-****-****-****", "sk-************************"),
    ),
    "id": (("SSN", "ssn:", "my SSN is", "social security number", "social security no.", "passport", "passport no.", "passport number:", "tax id", "tax id:", "national id", "national id number"), ("###-##-####", "### ## ####", "#########", "^########", "^^#######", "##-#######")),
    "phone": (("call", "call me at", "phone", "phone:", "tel", "tel.", "mobile:", "cell", "fax:", "dial", "reach me on", "ring", "text"), ("###-###-####", "(###) ###-####", "###.###.####", "### ### ####", "0## #### ####", "0#### ######", "1-###-###-####")),
}
LOOKALIKES = (
    ("in", "####"), ("year", "####"), ("page", "##"), ("chapter", "#"), ("costs", "$#,###.##"), ("about", "##%"), ("version", "#.##.#"), ("v", "#.#.#"), ("on", "####-##-##"), ("at", "##:##"), ("order", "######"), ("order no.", "########"), ("commit", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"),
    ("ISBN", "978-#-##-######-#"), ("room", "###"), ("score", "##-##"), ("with", "#,###,###"), ("the", "#st"), ("token", "ring"), ("secret", "garden"), ("password", "reset"), ("tokens", "of"), ("number", "################"), ("id", "##"), ("key", "point"), ("phone", "#"), ("call", "##"), ("section", "#.#.#.#.#"), ("from", "####-####"), ("size", "####x####"), ("the secret of", "success"), ("a password", "manager"), ("route", "##"), ("text", "##"), ("", "@@##"), ("model", "^^-####"), ("file", "@@@@@_##.@@@"),
)


def _filled(form: str, rng: random.Random) -> str:
    kinds = {"#": "0123456789", "@": "abcdefghijklmnopqrstuvwxyz", "^": "ABCDEFGHJKLMNPQRSTUVWXYZ", "~": "0123456789abcdef", "*": "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"}
    made = "".join(rng.choice(kinds[c]) if c in kinds else c for c in form)
    return made if "*" not in form or any(c.isdigit() for c in made) else made[:-1] + rng.choice("0123456789")


def written(words: list[str], n: int = WRITTEN, seed: int = 11) -> list[Case]:
    """Cases out of the forms above among the given words: two entities for each look-alike."""
    rng, out = random.Random(seed), []
    words = words or ["and", "the", "of", "was"]
    kinds = list(CONTEXTS)
    for k in range(n):
        left, right = rng.choices(words, k=rng.randrange(5)), rng.choices(words, k=rng.randrange(1, 5))
        if k % 3 == 2:
            context, form = rng.choice(LOOKALIKES)
            kind = None
        else:
            kind = kinds[k % 3] if rng.random() < 0.5 else rng.choice(kinds)
            context, form = rng.choice(CONTEXTS[kind][0]), rng.choice(CONTEXTS[kind][1])
        if rng.random() < 0.3:
            context = rng.choice((context.upper(), context.capitalize()))
        value = _filled(form, rng)
        glue, close = rng.choice(((" ", ""), (" ", ""), (" ", "."), (" ", ","), (' "', '"'), (": ", ""), (" = ", ""), ("=", ""), (" is ", ""), (" (", ")")) if kind else ((" ", ""), (" ", "."), (" ", ",")))
        if kind == "phone" and "=" in glue:
            glue, close = " ", ""
        begin = " ".join([*left, context]) + glue
        text = " ".join([begin + value + close, *right])
        spans = base_spans(text)
        if kind and not any(a < len(begin) + len(value) and b > len(begin) for _, a, b in spans):
            spans = [*spans, (kind, len(begin), len(begin) + len(value))]
        out += [case_of(text, tokens, spans) for tokens in neighbourhoods(text)]
    return out


def all_spans(text: str, field: Field | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by kind and start."""
    base = base_spans(text)
    added = []
    if field is not None:
        taken: list[list[int]] = []  # base spans, overlapping ones as one
        for a, b in sorted((a, b) for _, a, b in base):
            if taken and a <= taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], b)
            else:
                taken.append([a, b])
        begins = [a for a, _ in taken]
        for tokens in neighbourhoods(text):
            before = [bisect_left(begins, y) for _, y in tokens]
            held = [k > 0 and taken[k - 1][1] > x for k, (x, _) in zip(before, tokens, strict=True)]
            if all(held):
                continue
            segments = {(i, j): field.scores(f) for (i, j), f in candidates(text, tokens).items() if not any(held[i:j])}
            for kind, i, j, score in decode(len(tokens), segments, field.steps) if segments else ():
                a, b = trimmed(text, tokens[i][0], tokens[j - 1][1])
                if score > MARGIN and b > a:
                    added.append((kind, a, b))
    order = {k: n for n, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (order[s[0]], s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by the name of its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def fitted(docs: DataFrame, sample: int = SAMPLE, cases: int = CASES) -> Field:
    """The field of a bounded sample: ids are drawn first (no text is read), then the neighbourhoods of those documents are cut out where they lie.

    All rows of a drawn id count; null ids are an id of their own. What comes to the driver is bounded by ``sample``
    ids and ``cases`` neighbourhoods of at most CASE_CHARS characters.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = docs.select(key.alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = docs.select(key.alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "_id", "left_semi")  # at most ``sample`` ids

    def work(part: pa.Table) -> dict[str, list]:
        found = []
        for t in part["text"].to_pylist():
            for tokens in neighbourhoods(t or ""):
                a, b = tokens[0][0], tokens[-1][1]
                if b - a <= CASE_CHARS:
                    found.append(t[a:b])
        return {"stretch": found}

    stretches = map_texts(chosen, "stretch string", work).distinct().orderBy(F.xxhash64("stretch"), "stretch").limit(cases)
    texts = sorted(r["stretch"] for r in stretches.collect())
    truth = [case_of(t, tokens, base_spans(t) + secret_spans(t)) for t in texts for tokens in neighbourhoods(t)]
    words = [w for t in texts for w in _TOKEN.findall(t) if w.isalpha()][:2000]
    return train(truth + written(words))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts and a digest of the base spans, and all spans as kind:start:end, for every document."""
    known = fitted(docs) if field is None else field  # some thousand weights: they go with the task

    def work(part: pa.Table) -> dict[str, list]:
        out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
        for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
            base, every = all_spans(t or "", known)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
            for name, value in zip(out, (i, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)), strict=True):
                out[name].append(value)
        return out

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), SCHEMA, work)


def masked_column(field: Field, text: str = "text") -> Column:
    """The text column with all spans masked; nulls stay."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, all_spans(t, field)[1]) for t in texts], dtype=object)

    return mask(F.col(text).cast("string"))
