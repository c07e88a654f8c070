"""The host suffix array against a plain search, and what landmarks make of repeats."""

import random

import pyarrow as pa

from graphloom.llm import maintext


def brute_repeats(streams, run, least):
    """Every place of every run of ``run`` words, and of every shorter whole block, in ``least`` distinct pages of its host."""
    where, sizes = {}, {}
    for host, stream, pages, texts in streams:
        words, blocks = ["\n"], []
        for t in texts:
            blocks.append((len(words) - 1, len(t.split()) + 2))
            words += [*t.split(), "\n"]
        spans = [(i, run) for i in range(len(words) - run + 1)] + [(a, n) for a, n in blocks if n - 2 < run]
        kinds = [False] * (len(spans) - sum(n - 2 < run for _, n in blocks)) + [True] * sum(n - 2 < run for _, n in blocks)
        for (a, n), whole in zip(spans, kinds, strict=True):
            key = (host, whole, tuple(words[a : a + n]))
            where.setdefault(key, []).append((host, stream, a, n))
            sizes.setdefault(key, {})[stream] = pages
    return sorted((*p, sum(sizes[k].values())) for k, places in where.items() if sum(sizes[k].values()) >= least for p in places)


def test_suffix_array_equals_plain_search(spark):
    rng = random.Random(6)
    base = [rng.choice("abcde") for _ in range(80)]
    streams = []
    for i in range(40):
        texts = []
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(60)
            own = base[at : at + rng.randint(1, 20)] if rng.random() < 0.6 else [rng.choice("ab")] * rng.randint(1, 30)
            texts.append(" ".join(own))
        streams.append((f"h{i % 3}", bytes([i]), rng.randint(1, 2), texts))
    df = spark.createDataFrame(streams, "host string, stream binary, pages long, texts array<string>").repartition(3)
    for run in (8, 13, 20):
        got = sorted((r["host"], bytes(r["stream"]), r["at"], r["n"], r["found"]) for r in maintext.repeats(df, run, 3).collect())
        assert got == brute_repeats(streams, run, 3) and got


def page(i, article, before="<nav>home</nav>"):
    return (i, f"http://h.example/{i}", f"<body>{before}{article}<footer>imprint {i}</footer></body>")


def texts(spark, pages):
    rows = maintext.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()
    return {r["page_id"]: (r["text"], r["n_repeated"]) for r in rows}


def test_menu_inside_the_article_goes_only_if_it_repeats(spark):
    menu = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("alpha", "beta", "gamma")) + "</ul>"
    prose = "the same passage of the terms stands in every article of this host and it has more than twenty words so that it is a run of its own"
    pages = [page(i, f'<article>{menu}<p>own words {i} of page {i}</p><p>{prose}</p><p><a href="x">only link {i}</a></p></article>') for i in range(6)]
    got = texts(spark, pages)
    assert got == {i: (f"own words {i} of page {i}\n{prose}\nonly link {i}", 3) for i in range(6)}
    alone = texts(spark, [page(1, f"<article>{menu}<p>x</p></article>")])
    assert alone == {1: ("alpha\nbeta\ngamma\nx", 0)}  # nothing repeats
    copies = texts(spark, [page(1, f"<article>{menu}<p>x</p></article>") for _ in range(5)])
    assert copies == {1: ("alpha\nbeta\ngamma\nx", 0)}  # copies of one page are one page


def test_streams_hold_kept_blocks(spark):
    line = "follow the news of this host"
    pages = [page(i, f"<article><p>{line}</p><p>own {i}</p></article>") for i in range(1, 6)] + [page(0, f'<article><p>own 0</p><div class="social-history">{line}</div></article>')]
    got = texts(spark, pages)
    # what others keep is a repeat for a block that may be chrome, and stays whole where it is kept
    assert got == {0: ("own 0", 6)} | {i: (f"{line}\nown {i}", 0) for i in range(1, 6)}


def test_bitmap_loses_no_repeat(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") for _ in range(300)]
    rows = []
    for i in range(120):
        at = rng.randrange(250)
        own = [" ".join(base[at : at + rng.randint(1, 50)]), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60)))]
        rows += [(f"h{i % 3}" if i < 115 else "few", bytes([i]), 1, own)] * (1 if i % 4 else 3)
    df = spark.createDataFrame(rows, "host string, stream binary, pages long, texts array<string>").repartition(5).cache()
    sizes = df.groupBy("host", "stream").count().groupBy("host").agg({"*": "count", "count": "sum"}).toDF("host", "size", "copies")
    size = {r["host"]: r["size"] for r in sizes.collect()}
    monkeypatch.setattr(maintext, "GROUP_WORDS", 700)
    for share in (0.05, 0.1, 0.3):
        bits = maintext.may_repeat(df, sizes, 2, 8, share)
        got = sorted((r["host"], bytes(r["stream"]), r["at"], r["n"], r["found"]) for r in maintext.repeats(df, 8, 3, bits).collect() if r["found"] >= share * size[r["host"]])
        want = [p for p in brute_repeats({r[1]: r for r in rows}.values(), 8, 3) if p[4] >= share * size[p[0]]]
        assert got == want and (got or share == 0.3)
    assert 0 < bits.sum()


def test_only_suffixes_of_runs_that_repeat_are_sorted(spark):
    rng = random.Random(4)
    prose = lambda n: [rng.choice(["é", "ü", "word", "日本"]) + str(rng.randrange(10_000)) for _ in range(n)]
    phrase, near, passage = prose(9), prose(40), prose(30)
    rows = []
    for i in range(100):
        own = [*prose(rng.randint(20, 60)), *phrase, *prose(rng.randint(20, 60))]  # nine words that all pages have
        more = near if 20 <= i < 24 else passage if i % 8 == 0 else []  # 40 words in four pages of one task, 30 words in 13 of 100
        rows.append(("h", bytes([i]), 1, [" ".join(own), f"short {i % 50}", " ".join([*more, f"end{i}"])]))
    rows.append(("h", bytes([100]), 1, []))
    df = spark.createDataFrame(rows, "host string, stream binary, pages long, texts array<string>").repartitionByRange(5, "stream").cache()
    sizes = spark.createDataFrame([("h", 101, 101)], "host string, size long, copies long")
    bits = maintext.may_repeat(df, sizes, 5, 20, 0.1)
    got = sorted((r["host"], bytes(r["stream"]), r["at"], r["n"], r["found"]) for r in maintext.repeats(df, 20, 3, bits).collect())
    assert got == [p for p in brute_repeats(rows, 20, 3) if p[4] >= 10.1] and len(got) == 13 * 12  # the edge before is part of one
    # of each passage, those at which one of its runs has a part of five words
    assert maintext.suffixes(df, 5, 20, bits).count() == 13 * 27


def test_digests_of_a_long_page_in_slices():
    words = [f"w{i % 7919}" for i in range(200_000)]
    one = pa.RecordBatch.from_arrays([pa.array(["h"]), pa.array([[" ".join(words)]], pa.list_(pa.string()))], ["host", "texts"])
    page, at, runs, *_ = maintext.digests(one, 20)
    assert one.column("texts").nbytes > 2 * maintext.SLICE and at.tolist() == list(range(len(words) + 2 - 19))
    assert (runs[1 : 1 + 7919] == runs[1 + 20 * 7919 : 1 + 21 * 7919]).all() and len(set(runs[1 : 1 + 7919].tolist())) == 7919


def test_class_words_weigh(spark):
    article = '<article><div class="related-work">related work {0}</div><section class="social-history"><p>social history {0}</p></section><div class="share-buttons">share</div><div class="siteNav">home</div><div class="promo-history">buy now</div></article>'
    got = texts(spark, [page(i, article.format(f"n{i}")) for i in range(4)])
    # "promo-history" may be chrome, and repeats; the first two may be, and do not
    assert got == {i: (f"related work n{i}\nsocial history n{i}", 2) for i in range(4)}
    assert [maintext.class_weight(c) for c in ("ad", "ad-slot-1", "cookieBanner", "c-nav__item", "page has-sidebar", "related-work", "adaptive", "comment-list x", "")] == [2, 2, 2, 2, 1, 1, 0, 2, 0]


def test_defined_cases(spark):
    long = "<article>" + "<p>" + "word " * 20_000 + "</p>" + "<p>end</p></article>"
    rows = [(1, "http://h/a", long, 9, "t"), (1, "http://h/a", long, 9, "t"), (None, None, "<p>open text</p>", 9, "t"), (2, "::", None, 9, "t"), (3, "http://[", "", 9, "t"), (4, "http://h/b", "<p>a</p><p", 9, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, page long, texts string")
    got = sorted((str(r["page_id"]), r["text"][-9:], r["n_chars"], r["n_repeated"]) for r in maintext.extract(df).collect())
    assert [g[0] for g in got] == ["1", "1", "2", "3", "4", "None"]
    assert {g[0]: g[2:] for g in got} == {"1": (100_003, 0), "None": (9, 0), "2": (0, 0), "3": (0, 0), "4": (1, 0)}
    assert maintext.extract(df.limit(0)).count() == 0
