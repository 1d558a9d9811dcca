"""Words put together from pieces have the ids that the library gives the whole text, and the library sees pieces once."""

import gc
import random
import tracemalloc

import pyarrow as pa

from tallywright.llm import packing
from tallywright.llm.queries import vocabulary


class Counted:
    """The library, and how many characters it was given."""

    def __init__(self, library):
        self.library, self.n = library, 0

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode_batch_fast(self, texts, **kw):
        self.n += sum(map(len, texts))
        return self.library.encode_batch_fast(texts, **kw)

    def encode(self, text, **kw):
        self.n += len(text)
        return self.library.encode(text, **kw)


def test_new_words_of_known_pieces_are_not_encoded_again():
    tok = packing.Tokenizer(vocabulary())
    tok.library = Counted(tok.library)
    rng = random.Random(1)
    stems = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(100)]
    ends = [f"{a}{b}" for a in (",", ".\nThen", "!?", "12", "'s", ".\n\nSo") for b in ("", "&", "#x", "%%9", "(é)")]
    text = "start " + " ".join(s + e for s in stems for e in ends)
    assert tok.encode([text]) == [tok.whole(text)]
    tok.library.n = 0
    tok.encode([text + " " + " ".join(s + e + "~" + f for s in stems for e, f in zip(ends, ends[1:], strict=False))])
    assert tok.library.n < len(text) // 5


def test_words_of_all_kinds(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 50)
    monkeypatch.setattr(packing, "TAILS", 20)
    tok = packing.Tokenizer(vocabulary())
    parts = ["a", "Z", "é", "ß", "ª", "²", "½", "٣", "中", "é", "‍", "🙂", "7", "42", "'", "'s", "'LL", "'ve", "don't", "_", "-", "...", "\n", "\n\n", "<|endoftext|>", "Ġ", "Ċ", "\x00", "\x7f", "ŉ", "µ", "×"]
    rng = random.Random(3)
    texts = [None, "", "\n", "'s 's", "one", "x\n", "two words", " led", "a  b", "a \n b", "a\tb", "a\x1cb"]
    texts += [" ".join("".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(30)) for _ in range(60)]
    want = [tok.whole(t) if t else b"" for t in texts]
    for _ in range(2):
        assert tok.encode(texts) == want
        assert [tok.encode([t])[0] for t in texts] == want


def test_remembered_words_take_little_memory():
    tok = packing.Tokenizer(vocabulary())
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) + "," * (i % 2) for i in range(6000)) for _ in range(10)]
    gc.collect()
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    for t in texts:
        tok.encode([t])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 100 * sum(len(set(t.split())) for t in texts)


def test_words_in_use_outlast_new_ones(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 2000)
    tok = packing.Tokenizer(vocabulary())
    tok.library = Counted(tok.library)
    rng = random.Random(6)
    often = " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(500))
    for _ in range(20):
        text = "start " + often + " " + " ".join("".join(rng.choices("klmnopqrst", k=8)) for _ in range(800))
        assert tok.encode([text]) == [tok.whole(text)]
    tok.library.n = 0
    tok.encode(["start " + often])
    assert tok.library.n == len("start")
