import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from partlens.llm import tokens

LIBRARY = Tokenizer.from_file(tokens.tokenizer_path())


def _library_agrees(texts, coder=None):
    flat, starts = (coder or tokens.ids()).encode(pa.array(texts, pa.string()))
    for i, x in enumerate(texts):
        assert flat[starts[i] : starts[i + 1]].tolist() == LIBRARY.encode(x, add_special_tokens=False).ids, repr(x)


def test_ids_equal_the_librarys():
    rng = random.Random(5)
    alphabet = [chr(c) for c in range(0x260)] + [" "] * 300 + ["'"] * 60 + list("estlmdrv") * 15 + ["1", "\n"] * 20
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(4000)]
    plain = [c for c in alphabet if ord(c) < 0xB0 and ord(c) > 31 or c == "\n"] + ["'"] * 30 + [" "] * 30
    texts += ["".join(rng.choices(plain, k=rng.randint(0, 30))) for _ in range(4000)]
    _library_agrees([*texts, "", "ΑΒ 日本", "hello <|endoftext|> a", "don't we'll they've 's's ''s x 's", "y" * 17 + " " + "z" * 40, "\x00a b", "  \n\n x  y"])
    _library_agrees(["", "", ""])
    _library_agrees([])


def test_table_turns_over_and_collides(monkeypatch):
    monkeypatch.setattr(tokens, "BITS", 4)
    monkeypatch.setattr(tokens, "PROBES", 2)
    coder = tokens.Ids()
    for _ in range(3):
        _library_agrees(["the cat and the dog and a bird sat on the old mat again"] * 2 + ["one two three four five six seven eight nine ten"], coder)


def test_end_id_follows_each_text():
    flat, starts = tokens.ids().encode(pa.array(["a b", "", "c"]), end=2)
    assert (np.diff(starts) == [3, 1, 2]).all() and all(flat[e - 1] == 2 for e in starts[1:].tolist())
