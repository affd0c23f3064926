"""Small fixtures for the operators: nulls, empty and long texts, copies, empty tables, clashing extra columns, and
brute-force versions where SQL can't express an operator."""

import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from partlens.llm import decontaminate, embedding_join, html_extract, jaccard_join, language_id, packing, suffix_dedup, token_file, toxicity, warc
from partlens.llm.tokens import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, rep long"
WORDS = [f"w{i}" for i in range(400)]


def _text(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = _text(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
LONG = _text(7, 6000)
TEXTS = [None, "", "  \n ", "one two", "One TWO", BASE, BASE, NEAR, _text(2, 90) + " " + BASE, LONG, "élan vital naïf ça là", _text(3, 5)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", len(t or ""), "x", 0) for i, t in enumerate(TEXTS)], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def _sets():
    for t in TEXTS:
        w = (t or "").encode().lower().split()
        yield {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join_equals_brute_force(spark, docs, nothing):
    sets, root = list(_sets()), list(range(len(TEXTS)))
    for _ in TEXTS:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, docs).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert jaccard_join.jaccard_components(spark, nothing).count() == 0


def _cut_by_hand(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
    return out


def test_suffix_dedup_equals_brute_force(spark, docs, nothing):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark, docs).collect()}
    assert got == dict(enumerate(_cut_by_hand(TEXTS)))
    assert suffix_dedup.remove_repeats(spark, nothing).count() == 0


def test_suffix_dedup_of_frequent_grams(spark, monkeypatch):
    rng = np.random.default_rng(41)
    line, passage = _text(51, 25), _text(52, 160)
    texts = [*TEXTS]
    for i in range(40):
        words = list(rng.choice(WORDS, 60))
        middle = line if i % 2 else passage[int(rng.integers(0, 90)) : len(passage) - int(rng.integers(0, 90))]
        if i % 5 == 0:
            middle = middle[:200] + "#" + middle[201:]
        texts.append(" ".join(words[:30]) + middle + " ".join(words[30:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(_cut_by_hand(texts)))
    for hot in (1, 8):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark, docs).collect()} == want


def test_suffix_dedup_of_repeated_and_missing_ids(spark):
    one, two = _text(21, 300), _text(22, 300)
    passage = _text(23, 130)
    texts = [one, one, two, passage + " x " + one[:100], "y " + passage + " z", None, passage[:410]]
    ids = [1, 1, 1, None, None, None, 7]
    rows = [(i, t, "a", "b") for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __kept string, spans string")
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(spark, docs).collect()), key=repr)
    want = _cut_by_hand(texts)
    assert got == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=repr)
    left = suffix_dedup.without_repeats(spark, docs)
    assert left.columns == docs.columns
    kept = [(i, w[4] if w[1] else t) for i, w, t in zip(ids, want, texts, strict=True) if w[1] == 0 or w[1] < w[0]]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(kept, key=repr)
    assert all(r["__kept"] == "a" and r.spans == "b" for r in left.collect())


def test_language_id(spark, docs, nothing):
    rows = [(i, "the house and the garden " * 3 if i % 2 else "la maison et le jardin " * 3, "en" if i % 2 else "fr") for i in range(60)]
    got = language_id.identify(spark, spark.createDataFrame(rows + [(100, None, "en"), (101, "123 !", None)], "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") and 0 <= r.score <= 1 for r in got if r.doc_id < 60)
    assert {r.lang_pred for r in got if r.doc_id >= 100} == {"und"}
    assert language_id.identify(spark, nothing).count() == 0


def test_toxicity(spark, nothing):
    rows = [(i, _text(i, 40) + (" idiot" if i % 4 == 0 else "")) for i in range(200)] + [(500, None), (501, "")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(900, 1, 1), (None, 0, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.severity(spark, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.toxic_pred == (r.doc_id % 4 == 0) for r in got if r.doc_id < 200) and len(got) == 202
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.severity for r in toxicity.severity(spark, d, empty).collect()} == {0.0}
    assert toxicity.severity(spark, nothing, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_severity_grows_with_the_grade_on_held_out_rows(spark):
    insults = ["idiot", "scum", "moron", "pathetic"]
    rows = [(i, " ".join([_text(i, 40), *insults[: (0, 1, 4)[i % 3]]]), "x") for i in range(600)] + [(0, "again", "x"), (700, None, "x"), (701, "", "x"), (702, _text(9, 8000) + " scum idiot moron pathetic", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    for labels in ([(i, int(i % 3 > 0)) for i in range(400)], [(i, i % 3) for i in range(400)]):
        kind = "toxic" if max(x for _, x in labels) == 1 else "severity"
        got = toxicity.severity(spark, d, spark.createDataFrame([*labels, (3, 0)], f"doc_id long, {kind} int")).collect()
        assert len(got) == len(rows) and all(0 <= r.severity <= 2 for r in got)
        held = [r for r in got if 400 <= r.doc_id < 600]
        assert sum(r.grade_pred == r.doc_id % 3 for r in held) >= 0.95 * len(held)
        by = [np.mean([r.severity for r in held if r.doc_id % 3 == k]) for k in range(3)]
        assert by[0] < 0.3 < by[1] < 1.5 < by[2]
        assert next(r for r in got if r.doc_id == 702).toxic_pred and len({r.severity for r in got if r.doc_id in (700, 701)}) == 1


def test_decontamination(spark, docs, nothing):
    item = " ".join(BASE.split()[20:60])
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, _text(99, 30))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(spark, docs, bench).collect()}
    assert got == {(5, 1): 1.0, (6, 1): 1.0, (7, 1): got.get((7, 1)), (8, 1): 1.0} and got[(7, 1)] >= 0.75
    assert decontaminate.contaminated(spark, nothing, bench).count() == 0
    assert decontaminate.contaminated(spark, docs, bench.where("false")).count() == 0


def test_warc_round_trip_and_loser_tree(spark):
    page = "<p>" + "x" * 200 + "\r\n\r\n</p>"
    rows = [(3, "http://a.example/1", page), (1, "http://a.example/2", page), (2, None, None), (4, "http://b.example/", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.capture_history(spark, pages).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    n = len(page)
    assert got == {1: (n, "response", None, sha(page)), 3: (n, "revisit", 1, sha(page)), 2: (0, "response", None, sha("")), 4: (2, "response", None, sha("é"))}
    assert warc.capture_history(spark, pages.where("false")).count() == 0
    runs = [sorted(np.random.default_rng(i).integers(0, 50, i).tolist()) for i in range(6)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))


def test_html_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two<p>three<b> bold</b></article><div class=comments>c</div><footer>f</footer>"
    assert "\n".join(t for t, _ in html_extract.blocks(page)) == "A & B\none two\nthree bold"
    rows = [(i, f"http://a.example/{i}", f"<div>Shared top</div><div>Own line {i} with more text than the template</div><div>Shared end</div>") for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark, spark.createDataFrame(rows + [(9, None, None)], "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own line {i} with more text than the template" for i in range(4)} | {9: ""}


def test_packing_and_token_file(spark, docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    pieces = packing.pack(spark, docs).collect()
    for r in pieces:
        whole = np.append(ids[r.doc_id], 0).astype("<u4")
        assert (r.doc_tokens, r.ids_crc32) == (len(whole), zlib.crc32(whole[r.start : r.start + r.length]))
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert sum(fill.values()) == sum(len(x) + 1 for x in ids.values()) and sum(v != 1024 for v in fill.values()) <= 1
    start = 0
    for r in sorted(token_file.round_trip(spark, docs).collect(), key=lambda r: r.doc_id):
        whole = np.append(ids[r.doc_id], 2).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(whole), zlib.crc32(whole))
        start += len(whole)
    assert packing.pack(spark, nothing).count() == 0 and token_file.round_trip(spark, nothing).count() == 0


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 60, 2048).astype(np.uint16), np.repeat(np.uint16(7), 2048), rng.integers(0, 65536, 2048).astype(np.uint16), rng.integers(0, 65536, 100).astype(np.uint16)]
    order0 = token_file.order0_table(np.concatenate(blocks))
    coded = token_file.encode_blocks(blocks, order0)
    back = token_file.decode_blocks(coded, [len(b) for b in blocks], order0)
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True)) and len(coded[1]) < 200
    # a block stands by itself
    assert (token_file.decode_blocks(coded[1:2], [2048], order0)[0] == blocks[1]).all()
    table = token_file.packed_table(order0)
    assert all((a == b).all() for a, b in zip(token_file.unpacked_table(table), order0, strict=True))
    broken = bytes([coded[0][0] ^ 1]) + coded[0][1:]
    with pytest.raises(ValueError):
        token_file.read_frame([2048], [len(broken) // 2], [zlib.crc32(blocks[0])], table, broken)


def test_coded_ids_are_smaller_than_zlib_makes_them():
    rng = np.random.default_rng(11)
    words = [rng.integers(0, 3000, rng.integers(1, 4)) for _ in range(4000)]
    pick = np.minimum(rng.zipf(1.2, 300_000) - 1, 3999)
    flat = np.concatenate([words[i] for i in pick]).astype(np.uint16)
    blocks = [flat[i : i + token_file.BLOCK] for i in range(0, len(flat), token_file.BLOCK)]
    order0 = token_file.order0_table(flat)
    size = sum(map(len, token_file.encode_blocks(blocks, order0))) + len(token_file.packed_table(order0))
    assert size < len(zlib.compress(flat.tobytes(), 9))


def test_embedding_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 16))
    x[30:] = x[:30] + 0.25 * rng.standard_normal((30, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, x[0].tolist()), (61, None), (62, [0.0] * 16), (63, [float("nan")] * 16), (64, [])]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    u = np.concatenate([u, u[:1]])
    link = (u @ u.T >= 0.9) & ~np.eye(61, dtype=bool)
    got = {r.vec_id: (r.n_links, r.kept) for r in embedding_join.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: got[i][0] for i in range(61)} == {i: int(link[i].sum()) for i in range(61)}
    assert all(got[i] == (0, True) for i in range(61, 65)) and not got[60][1]


def test_embeddings_of_other_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 1.0, 0.1]), (6, [5.0]), (7, [2.0]), (8, [-1.0]), (9, [1.0, 0.0, 0.0]), (9, [0.0, 0.0, 1.0]), (None, [0.0, 0.1, 1.0])]
    got = sorted(map(tuple, embedding_join.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 0, 8, True), (9, 1, 3, False), (9, 1, 9, True), (None, 1, 9, True)], key=repr)
    assert embedding_join.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_archives_of_several_members_and_pages_without_ids(spark):
    import gzip

    assert warc.inflate(gzip.compress(b"one") + gzip.compress(b"") + gzip.compress(b"two")) == b"onetwo"
    page = "x" * 150
    rows = [(None, "http://a.example/1", page), (5, "http://a.example/1", page), (None, None, "short"), (5, "http://a.example/1", page)]
    got = sorted((tuple(r) for r in warc.capture_history(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr)
    assert got == sorted([(None, 150, "revisit", 5), (5, 150, "response", None), (5, 150, "response", None), (None, 5, "response", None)], key=repr)


def test_language_stage_rejects_what_is_like_no_language(spark):
    rng = np.random.default_rng(8)
    noise = " ".join("".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 11, 120))
    words = {"en": "the house and the garden of this old town are open".split(), "fr": "la maison et le jardin de cette vieille ville sont ouverts".split()}
    rows = [(i, " ".join(rng.choice(words[k], 60)), k, "mine", 0.5) for i, k in enumerate(["en", "fr"] * 20)] + [(90, noise, None, "mine", 0.5), (91, "zq xv", None, "mine", 0.5), (92, None, "en", "mine", 0.5), (93, "12 !", None, "mine", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    left = language_id.recognised(spark, docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect())) == sorted(r for r in rows if r[0] not in (90, 92, 93))
    assert language_id.recognised(spark, docs.limit(0)).count() == 0


def test_near_copies_around_the_limit_equal_brute_force(spark):
    rng = np.random.default_rng(17)
    texts = []
    for base in range(6):
        words = list(rng.choice(WORDS, int(rng.integers(30, 160))))
        for _ in range(25):
            w = list(words)
            for at in rng.integers(0, len(w), int(rng.integers(0, len(w) // 12 + 2))):
                w[at] = f"n{int(rng.integers(0, 10**6))}"
            texts.append(" ".join(w[int(rng.integers(0, 4)) : len(w) - int(rng.integers(0, 4))]))
    texts += [texts[0], "a b c", "A b C", "a b"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            if 100 * len(x & sets[b]) >= 75 * len(x | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    # rows that repeat one stay one row each, and one of each group is left
    twice = docs.where("doc_id < 40").unionByName(docs.where("doc_id < 3"))
    assert jaccard_join.jaccard_components(spark, twice).count() == 43
    left = sorted(r.doc_id for r in jaccard_join.one_of_each(spark, twice).collect())
    assert left == sorted({find(i) for i in range(25)} | {r.component_id for r in jaccard_join.jaccard_components(spark, docs.where("doc_id BETWEEN 25 AND 39")).collect()})


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(23)
    items = [" ".join(rng.choice(WORDS, int(n))) for n in (3, 5, 9, 14, 30, 30, 59)] + ["w1 w2 w1 w2 w1 w2 w1 w2 w1 w2 w1 w2", "", None]
    texts = []
    for i in range(60):
        words = list(rng.choice(WORDS, 80))
        passage = items[i % 8].split()
        for at in rng.integers(0, len(passage), int(rng.integers(0, 3))):
            if i % 3:
                passage[at] = "other"
        if i % 5 == 1:
            passage.insert(len(passage) // 2, "more")
        if i % 7 == 2:
            passage = passage[1:]
        where = int(rng.choice([0, 40, 80]))
        texts.append(" ".join(words[:where] + passage + words[where:]).upper() if i % 2 else " ".join(words[:where] + passage + words[where:]))

    def bag(words, k):
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))

    want = {}
    for j, item in enumerate(items):
        own = (item or "").lower().split()
        k, n = min(5, len(own)), len(own)
        if not n:
            continue
        target = bag(own, k)
        for d, text in enumerate(texts):
            w = text.lower().split()
            best = max((sum((x & target).values()) / sum((x | target).values()) for s in range(1 - n, len(w)) if (x := bag(w[max(s, 0) : s + n], k))), default=0)
            if best >= 0.75:
                want[d, j] = pytest.approx(best)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(spark, docs, bench).collect()}
    assert got == want and len(want) > 20


def test_repeated_rows_missing_ids_and_long_texts_are_packed_and_filed(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (None, "four"), (2, None), (3, _text(40, 5000))]
    docs = spark.createDataFrame([(*r, "x", 9, b"z") for r in rows], "doc_id long, text string, part string, key int, ids binary")
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    pieces = packing.pack(spark, docs).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == want
    assert sum(r.length for r in pieces) == sum(n * k for (_, n), k in want.items())
    filed = token_file.round_trip(spark, docs).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in filed) == want
    order = sorted(filed, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, 1, 1, 1, 2, 3]
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order[:-1])]).tolist()


def test_decontamination_of_long_texts_and_clashing_names(spark):
    item = _text(71, 40)
    rows = [(1, _text(72, 12000) + " " + item + " " + _text(73, 3000)), (2, _text(74, 12000)), (3, item), (3, "other text"), (None, item)]
    docs = spark.createDataFrame([(*r, 1, "h", 2) for r in rows], "doc_id long, text string, n int, sh string, item_id int")
    got = decontaminate.clean(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert [r.doc_id for r in got.collect() if r.doc_id is not None] == [2]


def test_warc_frequent_payloads(spark, monkeypatch):
    """Copies of a payload that fill more than an archive are dealt by page, and still revisit the first."""
    from partlens.llm import warc

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    body = "<p>" + "same page " * 20 + "</p>"
    rows = [(i, f"http://a.example/{i}", body) for i in range(9, 400)] + [(i, f"http://b.example/{i}", None if i % 2 else "short") for i in range(400, 500)] + [(i, f"http://c.example/{i}", f"<p>{'pair ' * 30}{i // 2}</p>") for i in range(500, 540)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.capture_history(spark, pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        first = 9 if html == body else i // 2 * 2 if i >= 500 else i
        assert got[i] == (("response", None) if first == i else ("revisit", first))


def test_toxicity_keeps_features_out_of_the_driver(spark):
    """Features are counted by the tasks: tables over all slots and samples' whole features took hundreds of MB of the driver."""
    rows = [(i, _text(i, 40) + (" idiot" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    tracemalloc.start()
    try:
        scored = toxicity.severity(spark, d, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 16 << 20
    assert all(r.toxic_pred == (r.doc_id % 4 == 0) for r in scored.collect())
