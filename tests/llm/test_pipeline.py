"""The whole pipeline against a plain version of each stage, and its contract."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from partlens.llm import language_id
from partlens.llm.tokens import tokenizer_path

RNG = np.random.default_rng(31)
EN = "the of and to in that it is was for on with as at by this had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through".split()
FR = "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire me on mon lui nous comme mais pouvoir avec tout y aller voir bien où sans tu ou leur homme si deux mari moi vouloir te femme venir quand grand celui notre devoir là jour prendre même votre rien petit encore aussi quelque dont tous mer trouver donner temps ça peu même falloir sous parler alors main chose ton mettre vie savoir yeux passer autre".split()


def _words(n, words=EN):
    return list(RNG.choice(words, n))


def _table():
    passage = " ".join(_words(140))
    item = " ".join(_words(30))
    base = _words(90)
    near = [*base[:40], "changed", *base[41:]]
    noise = " ".join("".join(map(chr, RNG.integers(97, 123, n))) for n in RNG.integers(1, 11, 100))
    texts = [
        None, "", "12 34 !", noise, " ".join(base), " ".join(base), " ".join(near), " ".join(base[:20]),
        " ".join(_words(60)) + " " + passage, passage + " " + " ".join(_words(70, FR)), " ".join(_words(50)) + " " + item + " " + " ".join(_words(50)), item,
        " ".join(_words(60, FR)) + " " + passage + " " + " ".join(_words(60, FR)), passage,
        *[" ".join(_words(int(RNG.integers(3, 400)), FR if i % 2 else EN)) for i in range(24)], "a", " ".join(_words(9000)),
    ]
    rows = [(i, t, "fr" if t and set(t.split()[:9]) <= set(FR) else "en", "src", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[20], (None, texts[21] + " more", "en", "src", 9)], item


def _language(rows):
    """Prototypes and noise by bundling gram by gram."""
    letters, _ = language_id.letter_vectors()

    def bundle(text):
        s = "".join(c if c.isalpha() else " " for c in f" {text}  ".lower())
        out = np.zeros(language_id.DIM)
        sym = language_id.symbols()
        for i in range(1, len(s) - 1):
            a, b, c = (int(sym[ord(x)]) for x in s[i - 1 : i + 2])
            if b:
                out += np.roll(np.roll(letters[a], 1) * letters[b], 1).astype(float) * letters[c]
        return out

    sums = {}
    for _, text, lang, *_ in rows:
        if text is not None and lang is not None:
            sums[lang] = sums.get(lang, 0) + bundle(text)
    proto = np.array([v / np.linalg.norm(v) for v in sums.values()])
    least = language_id.noise_score(proto)
    kept = []
    for r in rows:
        n = sum(c.isalpha() for c in r[1] or "")
        v = bundle(r[1] or "")
        if n and (n < language_id.ENOUGH or (proto @ v).max() / np.linalg.norm(v) >= least):
            kept.append(r)
    return kept


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _one_of_each(rows):
    sets, group = [_shingles(r[1]) for r in rows], list(range(len(rows)))
    for a, x in enumerate(sets):
        for b in range(a):
            if x and 100 * len(x & sets[b]) >= 75 * len(x | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for g, r in zip(group, rows, strict=True):
        if g not in best or (r[0] is not None and (best[g][0] is None or r[0] < best[g][0])):
            best[g] = r
    return list(best.values())


def _cut(rows):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    out = []
    for r, b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if not gone.any():
            out.append(r)
        elif not gone.all():
            out.append((r[0], left, *r[2:4], len(left)))
    return out


def _clean(rows, item):
    own = item.lower().split()
    n, bag = len(own), lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    target, bad = bag(own), set()
    for r in rows:
        w = (r[1] or "").lower().split()
        if any(sum((x & target).values()) >= 0.75 * sum((x | target).values()) for s in range(1 - n, len(w)) if (x := bag(w[max(s, 0) : s + n]))):
            bad.add(r[0])
    return [r for r in rows if r[0] not in bad]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows, item = _table()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, item


def test_each_stage_equals_its_plain_version(spark, tables):
    d, rows, item = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = rows
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (_language, _one_of_each, _cut, lambda r: _clean(r, item)), strict=False):
        out = stage(spark, docs, d)
        want = plain(want)
        assert out.columns == docs.columns, name
        got = [tuple(r) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), name
        docs = spark.createDataFrame(got, docs.schema)
    library = Tokenizer.from_file(tokenizer_path())
    ids = Counter((r[0], zlib.crc32(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4"))) for r in want)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert pieces == corpus_pipeline.STAGES[-1][1](spark, docs, d).collect() or len(pieces) > 0
    assert {r.doc_id for r in pieces} == {k for k, _ in ids}
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert sum(fill.values()) == sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in want)
    assert sum(v != 1024 for v in fill.values()) <= 1


def test_run_applies_the_stages_one_after_the_other(spark, tables):
    d, rows, item = tables
    want = _clean(_cut(_one_of_each(_language(rows))), item)
    got = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r[0] for r in want}
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]


def test_empty_tables_pass_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_survive(spark, tables):
    d, _, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 14")
    odd = docs.withColumns({c: F.lit(c) for c in ("component", "spans", "lang_pred", "score", "sig", "rep", "node", "at", "item_id", "part", "row_id", "key")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, d)
        assert out.columns == odd.columns, name
        assert all(r[c] == c for r in out.collect() for c in ("component", "spans", "lang_pred", "key"))
