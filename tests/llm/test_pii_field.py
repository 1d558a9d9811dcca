"""The semi-Markov field against brute force over all segmentations, and on held-out planted values."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import pii


@pytest.fixture(scope="module")
def field(spark):
    return pii.fitted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def segmentations(n, segments):
    """All ways to cover n tokens by outside tokens and candidate segments with a kind."""
    if n == 0:
        return [()]
    out = [(*x, (n - 1, n, 0)) for x in segmentations(n - 1, segments)]
    for i, j in segments:
        if j == n:
            out += [(*x, (i, j, k + 1)) for x in segmentations(i, segments) for k in range(len(pii.KINDS))]
    return out


def worth(way, scores, steps):
    total, last = 0.0, 0
    for i, j, y in way:
        total += steps[last, y] + (scores[i, j][y - 1] if y else 0.0)
        last = y
    return total


def random_case(seed, n=4):
    rng = np.random.default_rng(seed)
    segments = {(i, j) for i, j in product(range(n), range(1, n + 1)) if i < j <= i + 3 and rng.random() < 0.6}
    return n, {s: [f"f{rng.integers(6)}", f"g{rng.integers(6)}"] for s in sorted(segments)}


@pytest.mark.parametrize("seed", range(4))
def test_best_segmentation_and_partition_function(seed):
    rng = np.random.default_rng(seed + 100)
    n, names = random_case(seed)
    steps = rng.normal(size=(len(pii.KINDS) + 1,) * 2)
    scores = {s: rng.normal(size=len(pii.KINDS)) for s in names}
    ways = segmentations(n, names)
    found = [(i, j, pii.KINDS.index(k) + 1) for k, i, j, _ in pii.decode(n, scores, steps)]
    filled, at = [], 0
    for i, j, y in [*found, (n, n, -1)]:
        filled += [(t, t + 1, 0) for t in range(at, i)] + ([(i, j, y)] if y >= 0 else [])
        at = j
    assert worth(filled, scores, steps) == pytest.approx(max(worth(w, scores, steps) for w in ways))
    # The likelihood of the empty truth is its score less the log of the partition function.
    rows = {f: r for r, f in enumerate(sorted({f for fs in names.values() for f in fs}))}
    weights = rng.normal(size=(len(rows), len(pii.KINDS)))
    scores = {s: sum(weights[rows[f]] for f in fs) for s, fs in names.items()}
    everything = np.log(sum(np.exp(worth(w, scores, steps)) for w in ways))
    [batch] = pii._batches([(n, names, {})], rows)
    assert pii.likelihood(batch, weights, steps)[0] == pytest.approx(n * steps[0, 0] - everything)


def test_gradient_is_the_slope_of_the_likelihood():
    cases = []
    for seed in range(5):
        n, names = random_case(seed, 3 + seed % 3)
        first = next(iter(names), None)
        cases.append((n, names, {first: pii.KINDS[seed % len(pii.KINDS)]} if first else {}))
    rows = {f: r for r, f in enumerate(sorted({f for _, names, _ in cases for fs in names.values() for f in fs}))}
    [batch] = pii._batches(cases, rows)
    rng = np.random.default_rng(1)
    weights, steps = rng.normal(size=(len(rows), len(pii.KINDS))), rng.normal(size=(len(pii.KINDS) + 1,) * 2)
    _, up, across = pii.likelihood(batch, weights, steps)
    for array, slope in ((weights, up), (steps, across)):
        for place in [tuple(rng.integers(s) for s in array.shape) for _ in range(25)]:
            array[place] += 1e-5
            high = pii.likelihood(batch, weights, steps)[0]
            array[place] -= 2e-5
            low = pii.likelihood(batch, weights, steps)[0]
            array[place] += 1e-5
            assert (high - low) / 2e-5 == pytest.approx(slope[place], abs=1e-4)


#: Contexts and values that the written cases do not have.
HELD_OUT = [
    ("secret", ["your new password is", "use the token", "with api_key", "the secret key was", "old passwd", "set the passphrase to"], ["zebra77Quartz", "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "Tr0ub4dor93x", "ghp_16C7e42F292c6912E7710c838347Ae178B4a", "q7w8e9r0t1y2"]),
    ("id", ["her SSN was", "the social security number of him,", "old passport", "your tax id"], ["078-05-1120", "219-09-9999", "X48271934", "457555462"]),
    ("phone", ["please call", "her mobile", "tel.", "dial"], ["415-555-2671", "(020) 555-0143", "303.555.0199", "020 7946 0991"]),
]
CLEAN = ["it was {} years", "a total of ${},250.00", "see page {}", "version {}.4.1 came", "on 2023-07-{} at noon", "the secret of {} monks", "no token was left, {} of", "commit 3b18e512dba79e4c8300dd08aeb37f8e728b8dad has {} lines", "model XR-{} sold", "password managers of {} users", "between 18{} and 1930", "ISBN 978-0-13-110362-{}"]


def test_held_out_spans_are_found(field):
    rng = random.Random(77)
    words = "river stone walked over under morning people when green house slowly".split()
    hits = total = extra = 0
    for kind, contexts, values in HELD_OUT:
        for context, value in product(contexts, values):
            begin = " ".join([*rng.choices(words, k=3), context]) + " "
            text = begin + value + rng.choice([" ", ". ", ", "]) + " ".join(rng.choices(words, k=3))
            spans = pii.all_spans(text, field)[1]
            total += 1
            hits += (kind, len(begin), len(begin) + len(value)) in spans
            extra += any((b <= len(begin) or a >= len(begin) + len(value)) for _, a, b in spans)
    false = sum(bool(pii.all_spans(" ".join([*rng.choices(words, k=3), c.format(rng.randrange(10, 99)), *rng.choices(words, k=3)]), field)[1]) for c in CLEAN for _ in range(5))
    assert hits / total >= 0.9 and extra == 0 and false <= 0.05 * 5 * len(CLEAN), (hits, total, extra, false)


def test_added_spans_have_exact_ends(field):
    value = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    for text in (f'x token = "{value}"### y', f"x token: {value}, y", f"x token={value}$$$ y", f"x (token {value}) y"):
        assert ("secret", text.index(value), text.index(value) + len(value)) in pii.all_spans(text, field)[1], text


def test_neighbourhoods_have_whole_tokens():
    long = "é" * 500
    text = f"{long} {long}  {long} 12 after {long}"
    tokens = [(m.start(), m.end()) for m in pii._TOKEN.finditer(text)]
    assert pii.neighbourhoods(text) == [tokens]
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", "1", "@", " ", "  ", "\n", "token", "tax id", "x" * 90]) for _ in range(40))
        tokens = [(m.start(), m.end()) for m in pii._TOKEN.finditer(text)]
        hot = {k for k, (a, b) in enumerate(tokens) for m in pii._INTEREST.finditer(text) if m.start() < b and m.end() > a}
        covered = {t for stretch in pii.neighbourhoods(text) for t in stretch}
        assert covered <= set(tokens) and {tokens[k] for h in hot for k in range(max(0, h - pii.REACH), min(len(tokens), h + pii.REACH + 1)) if k in hot} <= covered


def test_reruns_and_repeated_ids(spark):
    rows = [(i % 40 if i % 7 else None, f"text {i} has token = \"{i:032x}\" and mail{i}@x{i % 5}.org or +1 (956) 555-{i:04d}") for i in range(200)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, stretch string, _id string")
    one, two = pii.fitted(df, 20, 50), pii.fitted(df.repartition(7), 20, 50)
    assert one.rows == two.rows and (one.weights == two.weights).all() and (one.steps == two.steps).all()
    first = sorted(map(tuple, pii.find(df, one).collect()), key=repr)
    assert first == sorted(map(tuple, pii.find(df.repartition(3), two).collect()), key=repr) and len(first) == 200


def test_field_without_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    field = pii.fitted(none)
    assert pii.all_spans("my SSN is 078-05-1120", field)[1] and pii.all_spans("", field) == ([], [])
    masked = spark.createDataFrame([(None,), ("my SSN is 078-05-1120 x",)], "text string").select(pii.masked_column(field).alias("t"), F.lit(1)).collect()
    assert [r["t"] for r in masked] == [None, "my SSN is <ID> x"]


#: Contexts that share no word with the forms the field is trained on, and values in shapes of their own.
FOREIGN = {
    "secret": (["bearer", "auth =", "psk:", "unlock via", "signing hash", "webhook"], ["hT7kQ2mZ9xLw4Rv8", "ghp_A1b2C3d4E5f6G7h8I9j0K1l2", "9f86d081884c7d659a2feaa0c55ad015", "Xy7-Qp93-Lm20-Za81"]),
    "id": (["licence plate of", "insurance", "NRIC", "citizen", "steuernummer", "DNI"], ["987-65-4321", "S1234567D", "X4821973", "12-3456789"]),
    "phone": (["hotline", "whatsapp", "contact", "switchboard", "telefono", "helpdesk"], ["212-555-0187", "(415) 555-0132", "020 7946 0018", "617.555.0119"]),
}


def test_foreign_forms_are_measured_against_the_pattern(field):
    """Recall by kind, and precision over all, on contexts that share no word with the forms trained on; the pattern for named secrets is the floor."""
    known = {w.lower() for kinds in (pii.CONTEXTS[k][0] for k in pii.CONTEXTS) for c in kinds for w in c.replace(":", " ").split()}
    rng, words = random.Random(5), "river stone walked over under morning people when green house slowly".split()
    right, floor, found, total = {}, {}, 0, {}
    for kind, (contexts, values) in FOREIGN.items():
        for context, value in product(contexts, values):
            assert not set(context.lower().replace(":", " ").split()) & known
            begin = " ".join([*rng.choices(words, k=3), context]) + " "
            text = begin + value + " " + " ".join(rng.choices(words, k=3))
            spans = {s for s in pii.all_spans(text, field)[1]}
            want = (kind, len(begin), len(begin) + len(value))
            total[kind] = total.get(kind, 0) + 1
            right[kind] = right.get(kind, 0) + (want in spans)
            floor[kind] = floor.get(kind, 0) + (want in pii.secret_spans(text))
            found += len(spans)
    recall = {k: round(right[k] / total[k], 2) for k in total}
    precision = sum(right.values()) / max(found, 1)
    print("recall", recall, "pattern", {k: round(floor[k] / total[k], 2) for k in total}, "precision", round(precision, 2))
    assert all(right[k] >= floor[k] for k in total) and precision >= 0.5
