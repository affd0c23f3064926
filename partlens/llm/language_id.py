"""Language identification by hyperdimensional n-gram profiles.

Every letter has a fixed random vector of -1 and 1 (from its symbol number, so all executors draw the same ones).
An n-gram is bound by multiplying its letters' vectors, each permuted (rotated) by its place in the n-gram; a
text is the bundle (sum) of its n-gram vectors; a language's prototype is the bundle of all its training texts. A
text gets the language whose prototype has the largest cosine with it; score is that cosine, held to 0..1.

Prototypes bundle the n-gram counts of all training rows (text and label not null, in the training fold); there
is no sample. Letters are lower-cased; the SYMBOLS most usual letters of Latin scripts are told apart, others share
slots by code point, so other scripts work with the same tables. Words are padded by one blank.

Defined cases: text null or without a letter: lang_pred ``und``, score 0; ties go to the smaller label; without any
training row everything is ``und``; repeated rows are predicted alike; texts of any length are bundled whole; extra columns, of any name, are
ignored by ``identify`` and kept by ``recognised``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm.common import filled, row_slices, tidy

DIM, N, SYMBOLS = 512, 3, 48
UNKNOWN = "und"
#: A text of so many letters is held against so many texts of random letters.
ENOUGH, NOISE = 64, 32


def _symbol_table() -> np.ndarray:
    """Code point -> symbol: 0 for blanks and all that is no letter, a-z 1..26, other letters 27..SYMBOLS-1."""
    out = np.zeros(0x110000, np.uint8)
    for first in range(0, 0x110000, 0x1000):  # a part of the code points at a time
        letters = [c for c in range(first, first + 0x1000) if chr(c).isalpha()]
        low = np.array([ord(chr(c).lower()[0]) for c in letters], np.int64)
        out[letters] = np.where((low >= 97) & (low <= 122), low - 96, 27 + low % (SYMBOLS - 27))
    return out


_cache: dict[str, np.ndarray] = {}


def symbols() -> np.ndarray:
    if "s" not in _cache:
        _cache["s"] = _symbol_table()
    return _cache["s"]


def letter_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the symbols, and those of all runs of N - 1 symbols, bound and permuted once more: int8, a row for each."""
    if "v" not in _cache:
        letters = np.random.default_rng(7919).integers(0, 2, (SYMBOLS, DIM), dtype=np.int8) * np.int8(2) - np.int8(1)
        bound = letters
        for _ in range(2, N):
            bound = (np.roll(bound, 1, axis=1)[:, None, :] * letters[None, :, :]).reshape(-1, DIM)
        _cache["v"], _cache["w"] = letters, np.roll(bound, 1, axis=1)
    return _cache["v"], _cache["w"]


def bundle(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of the bound vectors of n-grams, each as often as it occurs."""
    letters, before = letter_vectors()
    out = np.zeros(DIM)
    for k in range(0, len(grams), 2048):
        g = grams[k : k + 2048]
        out += n[k : k + 2048].astype(np.float32) @ (before[g // SYMBOLS] * letters[g % SYMBOLS]).astype(np.float32)
    return out


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams with a letter in the middle, of all texts, and where each text's codes begin."""
    joined = "  ".join(texts) + "  "
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols()[cps].astype(np.int32)
    starts = np.cumsum([0] + [len(t) + 2 for t in texts])[:-1]
    s = np.concatenate([[0], s])  # now s[i + 1] is the symbol of code point i
    code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    at = np.flatnonzero(s[1:-1] > 0)
    return code[at], np.searchsorted(at, np.append(starts, len(s)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> for each language the counts of its n-grams in this task."""
    size = SYMBOLS**N
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for lo, hi in row_slices(texts):
            codes, first = gram_codes(texts.slice(lo, hi - lo).to_pylist())
            names = langs[lo:hi]
            ends = first[1:]
            for lang in set(names):
                parts = [codes[a:b] for a, b, x in zip(first[:-1], ends, names, strict=True) if x == lang]
                sums[lang] = sums.get(lang, 0) + np.bincount(np.concatenate(parts), minlength=size)
    _cache.clear()
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "gram", "n"])


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes from rows (lang, text): the labels and one unit vector for each.

    What reaches the driver is a table of at most labels x SYMBOLS**N counts, whatever the number of rows.
    """
    counts = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(tidy(_count), "lang string, gram int, n long")
    got = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(set(got["lang"])) if len(got) else []
    out = np.zeros((len(labels), DIM))
    for i, lang in enumerate(labels):
        own = got[got["lang"] == lang]
        out[i] = bundle(own["gram"].to_numpy(), own["n"].to_numpy())
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return labels, out / np.where(norm == 0, 1, norm)


def predict(docs: DataFrame, labels: list[str], prototypes: np.ndarray, id_cols: list[str], text_col: str, names: tuple[str, str, str] = ("lang_pred", "score", "n_letters")) -> DataFrame:
    """docs' id columns with the predicted language, its score and the number of letters, under ``names``."""
    proto = prototypes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(text_col))
            lang, score, letters = [], [], []
            for lo, hi in row_slices(texts):
                codes, first = gram_codes(texts.slice(lo, hi - lo).to_pylist())
                letters += np.diff(first).tolist()
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if a == b or not labels:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    doc = bundle(*np.unique(codes[a:b], return_counts=True))
                    cos = proto @ doc / max(float(np.linalg.norm(doc)), 1e-30)
                    best = int(np.argmax(cos))
                    lang.append(labels[best])
                    score.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in id_cols), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.int64())], [*id_cols, *names])
        _cache.clear()  # a worker that Spark keeps must not keep the vectors

    src = docs.select(*dict.fromkeys([*id_cols, text_col]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in id_cols)
    return src.mapInArrow(tidy(run), f"{kinds}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` long")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def noise_score(prototypes: np.ndarray) -> float:
    """The highest cosine with any prototype that NOISE texts of letters drawn at random reach."""
    rng = np.random.default_rng(2203)
    best = 0.0
    for _ in range(NOISE):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(1, 11, 100)]
        doc = bundle(*np.unique(gram_codes([" ".join(words)])[0], return_counts=True))
        best = max(best, float((prototypes @ doc).max(initial=0.0) / np.linalg.norm(doc)))
    return best


def recognised(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows of which no language can be told: null texts, texts without letters, and texts of ENOUGH letters at
    least that are no nearer to any language's prototype than letters drawn at random.

    Shorter texts stay, as they have too few n-grams to tell; without any labelled row all texts with letters stay.
    """
    labels, prototypes = train(docs)
    least = noise_score(prototypes) if labels else 0.0
    if not labels:
        labels, prototypes = ["any"], np.zeros((1, DIM))
    names, own = docs.columns, tuple(f"{x}_{'_'.join(docs.columns)}" for x in ("lang", "score", "letters"))  # names that docs can't have
    told = predict(docs, labels, prototypes, names, "text", own)
    return told.where((F.col(own[0]) != UNKNOWN) & ((F.col(own[2]) < ENOUGH) | (F.col(own[1]) >= least))).select(*names)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang)."""
    labels, prototypes = train(docs.where(~held_out()))
    src = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(src, labels, prototypes, ["doc_id", "held_out"], "text").drop("n_letters")
