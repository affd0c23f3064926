import random

from partlens.llm import html_extract

MENU = "<p>Subscribe to our letter and never miss a story again</p>"


def _texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_shared_lines_of_marked_articles_are_deleted(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><p>Own {w} text</p>{MENU}</article>") for i, w in enumerate(("red", "green", "blue"))]
    assert _texts(spark, rows) == {0: "Own red text", 1: "Own green text", 2: "Own blue text"}


def test_short_page_under_a_large_template(spark):
    big = "".join(f"<div>Template line number {i} of the house</div>" for i in range(20))
    rows = [(i, f"http://a.example/{i}", f"{big}<div>{w}</div>") for i, w in enumerate(("apples fell", "it rained again", "seven long " + "days went by " * 90))]
    assert _texts(spark, rows) == {0: "apples fell", 1: "it rained again", 2: ("seven long " + "days went by " * 90).strip()}


def test_copies_look_past_each_other(spark):
    copy = "<div>Top of all pages</div><div>The one story that is told three times over</div>"
    rows = [(i, f"http://a.example/a/{i}", copy) for i in range(3)] + [(3, "http://a.example/b", "<div>Top of all pages</div><div>Other things</div>"), (4, "http://b.example/", copy)]
    story = "The one story that is told three times over"
    assert _texts(spark, rows) == {0: story, 1: story, 2: story, 3: "Other things", 4: "Top of all pages\n" + story}


def test_near_copies_keep_their_text(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><p>The first paragraph is the same in both, and longer than the other one</p><p>The second one has a single word {w} that is not</p></article>") for i, w in enumerate(("here", "there"))]
    assert all(len(t.split("\n")) == 2 for t in _texts(spark, rows).values())


def _by_hand(rows):
    """Texts by the order of pages alone."""
    pages = sorted((u.split("/")[2], "/" + u.split("/", 3)[3], i, [t for t, _ in html_extract.blocks(h)]) for i, u, h in rows)
    runs = []
    for host, _, i, lines in pages:
        if runs and runs[-1][0] == host and html_extract.copies(runs[-1][1][-1][1], lines):
            runs[-1][1].append((i, lines))
        else:
            runs.append((host, [(i, lines)]))
    out = {}
    for k, (host, run) in enumerate(runs):
        before = runs[k - 1][1][-1][1] if k and runs[k - 1][0] == host else None
        after = runs[k + 1][1][0][1] if k + 1 < len(runs) and runs[k + 1][0] == host else None
        for i, lines in run:
            out[i] = "\n".join(html_extract.own_lines(lines, [o for o in (before, after) if o is not None and not html_extract.copies(lines, o)]))
    return out


def test_texts_depend_on_the_order_alone(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for host in range(4):
        top, end = f"<div>Top of host {host}</div>", f"<div>All that host {host} has to say at the end</div>"
        story = ""
        for i in range(rng.choice([1, 20, 60])):
            if rng.random() < 0.4 or host != 2 or not story:
                story = "".join(f"<div>{' '.join(rng.choices('one two three four five six seven'.split(), k=9))}</div>" for _ in range(rng.randint(1, 4)))
            rows.append((len(rows), f"http://h{host}.example/p/{i:03d}", top * rng.randint(0, 1) + story + end))
    rng.shuffle(rows)
    want = _by_hand(rows)
    assert _texts(spark, rows) == want
    monkeypatch.setattr(html_extract, "RANGE_ROWS", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert _texts(spark, rows) == want
        monkeypatch.setattr(html_extract, "FULL_RANGE", 2)
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        assert _texts(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_pages(spark):
    assert _texts(spark, []) == {}
