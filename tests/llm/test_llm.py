"""Small tables with nulls, empty and long texts, ties, repeated rows and columns of clashing names, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import _ctw, chat, ctw, decontaminate, maintext, mixing, multihash, nearcopies, queries, recompress, simhash, simple8b, textcnn

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 3000 + "end"
TEXTS = [
    (0, "The cat sat on the mat."), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "The cat sat on the mat."), (6, LONG), (7, "a b\nc d\n\ne"), (8, "é ü 日本語 İ"), (8, "é ü 日本語 İ"),
    (9, "x" * 5000), (10, "one two"), (11, "ONE two"),
]
WIDE = "doc_id long, text string, lang string, source string, n_chars long, score double, epoch int, block int, bucket int, key string, row int, hit boolean, place int, guest boolean, fp long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i != 4 else None, len(t or ""), 0.5, 1, 2, 3, "k", 4, True, 5, False, 6) for i, t in TEXTS]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, None, None, None, None, None, None, None, None, None, None)], WIDE).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], WIDE)


def all_rows():
    return [*TEXTS, (None, "no id")]


def words(t):
    return (t or "").encode().split()


def test_mixing(spark, docs, empty):
    got = mixing.schedule(docs, entropy=1.0, max_repeats=100.0).collect()
    read, have = {}, {}
    for r in got:
        read[r["source"]] = read.get(r["source"], 0) + r["n_tokens"]
    for i, t in all_rows():
        s = "" if i is None or i == 4 else f"s{i % 3}"
        have[s] = have.get(s, 0) + len(words(t))
    total, live = sum(have.values()), [s for s in have if have[s]]
    for s in live:  # uniform weights: a budget is met but for one document
        assert read.get(s, 0) <= total / len(live) + 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[(r["doc_id"], r["text"])] = times.get((r["doc_id"], r["text"]), 0) + 1
    assert set(times) == set(all_rows())  # every document stays
    assert mixing.schedule(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_partial_pass_is_a_prefix(spark):
    rows = [(i, " ".join(["w"] * (i % 5 + 1)), "a" if i < 910 else "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.schedule(df, entropy=1.0, max_repeats=100.0).collect()
    tokens = {i: len(t.split()) for i, t, _ in rows}
    budget = sum(tokens.values()) / 2
    for s, ids in (("a", range(910)), ("b", range(910, 1000))):
        whole = sum(tokens[i] for i in ids)
        passes, rest = divmod(int(budget), whole)
        order = sorted(ids, key=lambda i: hashlib.md5(f"1:{passes}:{i}".encode()).hexdigest())
        want, run = [], 0
        for i in order:
            run += tokens[i]
            if run > rest:
                break
            want.append(i)
        assert sorted(r["doc_id"] for r in got if r["source"] == s and r["epoch"] == passes) == sorted(want)
        assert all(sum(r["epoch"] == e for r in got if r["source"] == s) == len(ids) for e in range(passes))


def test_multiset_hash(spark, docs, empty):
    rows = multihash.edited(docs, per_part=1).collect()
    assert len(rows) == len(all_rows()) and multihash.edited(empty).count() == 0
    order = sorted(all_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in order]
    want = []
    for k, (i, _) in enumerate(order):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256")) for r in rows), key=str) == sorted(want, key=str)
    prints = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[r["doc_id"]] = r["fingerprint"]
    assert prints[0] == prints[5] and prints[1] == prints[2] and len(set(prints.values())) == len(prints) - 2
    lines = spark.createDataFrame([(1, "a b\nc d"), (2, "c d\na b"), (3, "a b")], "doc_id long, text string")
    found = {r["doc_id"]: r["fingerprint"] for r in multihash.fingerprints(lines).collect()}
    assert found[1] == found[2] != found[3]


def test_multiset_hash_adds_up(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a b\nc d e"), (2, "a b"), (3, "c d e")], "k long, text string")
    v = {r["k"]: (r["exact"], r["signed"]) for r in multihash.lanes(rows, ["k"], "text").collect()}
    a, b = spark.createDataFrame([(v[2], v[3])], "x struct<exact: array<long>, signed: array<long>>, y struct<exact: array<long>, signed: array<long>>"), v[1]
    got = a.select(*[c.alias(n) for n, c in zip(("e", "s"), multihash.combine(F.col("x"), F.col("y")), strict=True)]).first()
    assert (got["e"], got["s"]) == (b[0], b[1])


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "cat sat on the"), (2, None), (3, ""), (4, "cat sat in the"), (4, "cat sat in the"), (5, "not there at all")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, items).collect())
    assert got == sorted([(i, j, d) for i in (0, 5) for j, d in ((1, 0), (4, 1), (4, 1))])
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in all_rows()} - {0, 5}
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0


def test_decontamination_equals_full_search():
    rng = random.Random(5)

    def best(item, t):
        row = list(range(len(item) + 1))
        least = row[-1]
        for c in t:
            new = [0]
            for i, p in enumerate(item):
                new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
            row = new
            least = min(least, row[-1])
        return least

    for _ in range(150):
        items = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(3, 30)))) for i in range(3)]
        finder = decontaminate.Finder(items, 0.25)
        t = "".join(rng.choice("abc ") for _ in range(30))
        for _, x in items:
            t += "".join(c if rng.random() > 0.12 else rng.choice(["", "a", c + "b"]) for c in x) + "zzz"
        found = {m[0]: m[1] for m in finder.find(t)}
        for i, item, k in finder.items:
            d = best(item, decontaminate.normal(t))
            assert found.get(i) == (d if d <= k else None)


def test_context_tree_equals_recursion():
    rng = np.random.default_rng(1)
    data = bytes(rng.choice(list(b"ab c\n"), 300).tolist())
    depth = _ctw.DEPTH
    padded = b"\n" * depth + data
    grams = np.array([int.from_bytes(padded[i : i + depth + 1], "big") for i in range(len(data))], np.uint64)
    keys, counts = np.unique(grams[:250], return_counts=True)
    every = np.unique(grams)
    n = np.zeros(len(every))
    n[np.searchsorted(every, keys)] = counts
    got = dict(zip(every.tolist(), _ctw.Tree(every, n, 0).predict().tolist(), strict=True))
    tally, known = {}, {}
    for g, c in zip(every.tolist(), n.tolist(), strict=True):
        b = g.to_bytes(depth + 1, "big")
        ctx, x = b[:depth][::-1], b[depth]
        for j in range(8):
            for d in range(depth + 1):
                node = (1 << j | x >> (8 - j), ctx[:d])
                tally.setdefault(node, [0.0, 0.0])[x >> (7 - j) & 1] += c
                if d < depth:
                    known.setdefault(node, set()).add(ctx[d])
    from math import exp, lgamma, log, log10, pi

    memo = {}

    def own(node):
        a, b = tally[node]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)

    def weighted(node):  # (ln P_w, weight of the own estimate)
        if node not in memo:
            if len(node[1]) == depth:
                memo[node] = (own(node), 1.0)
            else:
                below, e = sum(weighted((node[0], node[1] + bytes([c])))[0] for c in known[node]), own(node)
                m = max(e, below)
                both = m + log(exp(e - m) + exp(below - m))
                memo[node] = (both - log(2), exp(e - both))
        return memo[node]

    def chance(p, ctx, d, bit):
        node = (p, ctx[:d])
        a, b = tally[node]
        est = ((a, b)[bit] + 0.5) / (a + b + 1)
        if d == depth or sum(tally[(p, ctx[: d + 1])]) == 0:
            return est
        w = weighted(node)[1]
        return w * est + (1 - w) * chance(p, ctx, d + 1, bit)

    for g in every.tolist():
        b = g.to_bytes(depth + 1, "big")
        ctx, x = b[:depth][::-1], b[depth]
        want = sum(log10(chance(1 << j | x >> (8 - j), ctx, 0, x >> (7 - j) & 1)) for j in range(8))
        assert abs(want - got[g]) < 1e-8


def test_language_model(spark, docs, empty):
    rows = ctw.score(docs, block_bytes=1 << 12).collect()
    assert len(rows) == len(all_rows()) and ctw.score(empty).count() == 0
    low = lambda t: [w.decode().translate({i: i + 32 for i in range(65, 91)}) for w in words(t)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts, ends = {}, 0
    for i, t in all_rows():
        if not held(i):
            ends += 1
            for w in low(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = {}
    for i, t in all_rows():
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in low(t)) + np.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        want.setdefault(i, (held(i), len(low(t)) + 1, sum(counts.get(w, 0) > 0 for w in low(t)) + 1, n, base))
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and abs(r["base_score"] - w[4]) < 1e-6 and r["score"] < 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        ws = [rng.choice("lorem ipsum dolor sit amet tempor magna".split()) for _ in range(rng.randint(3, 60))]
        bad = rng.random() < 0.3
        if bad:
            ws.insert(rng.randrange(len(ws)), rng.choice(["scumbag", "idiots"]))
        rows.append((i, " ".join(ws), rng.choice(["en", "de"]), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = df.select("doc_id", "toxic")
    got = {r["doc_id"]: r for r in textcnn.toxicity(df.drop("toxic"), labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, _, y in rows if got[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    plain = textcnn.toxicity(docs.select("doc_id", "text", "lang"), labels.limit(0)).collect()
    assert len(plain) == len(all_rows()) and all(r["score"] == 0 for r in plain)
    assert textcnn.toxicity(empty, labels).count() == 0
    kept = textcnn.clean(docs, labels)
    assert kept.columns == docs.columns


def test_thresholds_keep_the_shares_of_labels_beyond_the_cap(spark):
    rng = random.Random(8)
    rows = []
    for i in range(6000):  # a tenth is toxic; "dubious" stands in 40 % of that, but in 15 % of the rest
        ws = [rng.choice("lorem ipsum dolor sit amet tempor magna".split()) for _ in range(20)]
        bad, odd = i % 10 == 0, rng.random()
        if bad or odd < 0.15:
            ws.insert(rng.randrange(len(ws)), "scumbag" if bad and odd < 0.6 else "dubious")
        rows.append((i, " ".join(ws), "en", int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = textcnn.fit(df.drop("toxic"), df.select("doc_id", "toxic"), most_rows=300)
    model = model[0] if isinstance(model, tuple) else model
    score = model.score(pa.array([t for _, t, _, _ in rows], pa.large_string()))
    flagged = score >= model.thresholds["en"]
    label = np.array([y for _, _, _, y in rows])
    # at the true shares flagging "dubious" costs more than it finds; at equal shares, as in the capped sample, it would pay
    assert flagged[label == 0].mean() < 0.01 and flagged[label == 1].mean() > 0.5


def test_chat(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "a\n\\<\\|x<|", "", None, "<\\\\|im_start|>"]
    rows = [(c, t, r, said[(c or 0) % 5] if t else said[t + 1], 9) for c in (0, 1, 2, 3, 4, None) for t, r in ((0, "user"), (1, "assistant"), (1, "assistant"), (2, None), (3, "to\\ol\nx"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node long")
    got = {r["conv_id"]: r for r in chat.read_back(chat.conversations(chat.from_turns(df))).collect()}
    for c in (0, 1, 2, 3, 4, None):
        own = [(r or "", t or "") for k, _, r, t, _ in rows if k == c]
        turns = "".join(f"{r}\n{t}\n" for r, t in own)
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (5, hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.conversations(chat.from_turns(df.limit(0)))).count() == 0


def test_reply_tree_branches(spark):
    tree = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "thanks", 0.5), ("t", 5, 9, "user", "orphan", 0.0), ("t", 6, 7, "user", "c", 9.0), ("t", 7, 6, "user", "c", 9.0)]
    df = spark.createDataFrame(tree, "tree string, node long, parent long, role string, text string, score double")
    got = [(r["rank"], r["leaf"], r["depth"], r["node"]) for r in chat.paths(df, 2).collect()]
    assert sorted(got) == [(1, 4, 1, 1), (1, 4, 2, 3), (1, 4, 3, 4), (2, 2, 1, 1), (2, 2, 2, 2)]


def brute_windows(rows, size):
    first, texts = {}, [(i, words(t)) for i, t in rows]
    for i, ws in texts:
        for k in range(len(ws) - size + 1):
            if i is not None:
                w = tuple(ws[k : k + size])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in texts:
        gone = [False] * len(ws)
        for k in range(len(ws) - size + 1):
            if i is not None and first[tuple(ws[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = [w for w, g in zip(ws, gone, strict=True) if not g]
        out.append((i, len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [2, 5])
def test_recompression(spark, docs, empty, size):
    assert sorted(map(tuple, recompress.digests(docs, size).collect()), key=str) == brute_windows(all_rows(), size)
    assert recompress.digests(empty, size).count() == 0


def test_recompression_random(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdef") for _ in range(60)) for _ in range(5)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            b, at = rng.choice(base).split(), rng.randrange(50)
            parts += b[at : at + rng.randint(1, 40)] if rng.random() < 0.6 else [rng.choice("ab")] * rng.randint(1, 25)
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, recompress.digests(df, 7).collect()), key=str) == brute_windows(rows, 7)


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [int(r["fingerprint"], 16) for r in got]
    groups = list(range(len(got)))

    def find(k):
        while groups[k] != k:
            k = groups[k]
        return k

    for a in range(len(got)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                groups[find(a)] = find(b)
    for k, r in enumerate(got):
        ids = [x["doc_id"] for j, x in enumerate(got) if find(j) == find(k) and x["doc_id"] is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert simhash.near_duplicates(empty).count() == 0


def shingle_sets(rows):
    return {i: set(simhash.shingle_hashes(t, 5, 42)) for i, t in rows}


@pytest.mark.parametrize("node_rows", [2, 50_000])
def test_near_copies_against_all_pairs(spark, node_rows):
    rng = random.Random(11)
    rows, vocabulary = [], [f"w{k}" for k in range(4000)]
    passage = rng.choices(vocabulary, k=60)
    for _ in range(25):
        text = rng.choices(vocabulary, k=rng.randint(120, 500))
        at = rng.randrange(len(text))
        text[at:at] = passage  # shared by unrelated documents, which all stay
        for _ in range(rng.randint(1, 6)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 80))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    sets = shingle_sets(rows)
    root = {i: i for i, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    similarity = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for a in root:
        for b in range(a):
            if similarity(a, b) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), node_rows=node_rows).collect()}
    assert got.keys() == root.keys()
    for i in root:
        assert got[i] == got[find(i)]  # no pair at 0.8 or more is missed
        assert got[i] == i or max(similarity(i, j) for j in root if j != i and got[j] == got[i]) >= 0.7


def test_near_copies_are_decided_by_exact_similarity(spark):
    # 90 shingles each: 80 shared ones are a similarity of 0.8, 78 are 0.765
    rows = []
    for k in range(120):
        ws = [f"w{k}.{j}" for j in range(94)]
        shared = 84 if k < 60 else 82
        rows += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(ws[:shared] + [w + "x" for w in ws[shared:]]))]
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i - i % 2 if i < 120 else i for i, _ in rows}


def test_near_copies_defined_cases(spark, docs, empty):
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [0, 1, 4, 6, 7, 8, 9, 10, None]))  # 2, 3 as 1; 5 as 0; 11 as 10
    assert nearcopies.keep_one(empty).count() == 0


def test_near_copies_of_a_repeated_id_are_decided_by_row(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(50)) for c in "xyz")
    # 2 stands for two unlike texts, one a copy of 1; 3 for three, one of them twice; 4 is a near copy of 3
    rows = [(1, y), (2, x), (2, y), (3, z), (3, z), (3, x), (3, "other words than all of these here"), (4, z + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, nearcopies.keep_one(df).collect()))
    assert got == sorted([(1, y), (2, x), (3, z), (3, "other words than all of these here")])


@pytest.mark.parametrize("node_rows", [3, 200_000])
def test_gray_index_finds_every_link(spark, node_rows):
    rng = random.Random(7)
    codes = set()
    for _ in range(60):
        c = rng.getrandbits(64)
        codes.add(c)
        for _ in range(rng.randint(0, 12)):
            for _ in range(rng.randint(1, 3)):
                c ^= 1 << rng.randrange(64)
            codes.add(c)
    codes = sorted(codes)
    df = spark.createDataFrame([(k, int(np.uint64(c).view(np.int64))) for k, c in enumerate(codes)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(df, 2, node_rows).collect()}
    want = list(range(len(codes)))
    for _ in codes:
        before = list(want)
        for a in range(len(codes)):
            for b in range(a):
                if (codes[a] ^ codes[b]).bit_count() <= 2:
                    want[a] = want[b] = min(want[a], want[b])
        if before == want:
            break
    assert [got[k] for k in range(len(codes))] == want


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body><header>site</header><nav><ul><li>home</li></ul></nav>
<div class="ad">buy</div><article class="post"><h1>A &amp;  B</h1><p>one<br>two <b>three</b><p>four<aside>side</aside><form>f</form><div class="share-buttons">share</div><section id="comments"><p>c</p></section><p>five&nbsp;six</p></article><footer>foot</footer></body></html>"""


def test_main_text(spark):
    pages = [(1, "http://h/1", PAGE), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", PAGE[:430]), (4, "http://h/4", PAGE[:430])]
    menu = "<body><div>home news sport about us</div><div>{}</div><div>all rights reserved by the owners</div></body>"
    pages += [(10 + k, "http://open/x", menu.format(t)) for k, t in enumerate(["alpha beta gamma delta one", "epsilon zeta eta theta two", "iota kappa lambda mu three", "nu xi omicron pi four"])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in maintext.extract(df).collect()}
    assert got[1] == "A & B\none two three\nfour\nfive six" and got[2] == "" and got[3] == "" and got[4].startswith("A & B")
    assert got[10] == "alpha beta gamma delta one" and got[13] == "nu xi omicron pi four"
    assert maintext.extract(df).count() == len(pages) and maintext.extract(df.limit(0)).count() == 0


def test_main_text_of_a_large_host_keeps_natural_phrases(spark):
    rng = random.Random(3)
    phrases = ["on the other hand it is", "as a matter of fact the", "at the end of the day we"]
    quote, notice = (" ".join(f"{c}{k}" for k in range(30)) for c in "qn")
    pages, want = [], {}
    for i in range(80):
        ws = [f"w{rng.randrange(500)}" for _ in range(40)]
        for p in rng.sample(phrases, 2):  # in two thirds of the pages
            at = rng.randrange(len(ws))
            ws[at:at] = p.split()
        text = " ".join(ws)
        want[i] = [text + " " + quote if i < 4 else text]  # 30 words in four of 80 pages
        pages.append((i, "http://large/x", f"<body><div>home news</div><p>{want[i][0]}</p><div>page {i} {notice}</div></body>"))
        want[i].append(f"page {i}")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in maintext.extract(df).collect()} == {i: "\n".join(t) for i, t in want.items()}


def test_token_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 59, 60, 61, 70_000):
        for most in (1, 2, 300, 50_000, 2**40, 2**63):
            ids = rng.integers(0, most, n, dtype=np.uint64)
            if n > 10:
                ids[::7] = rng.integers(0, 3, len(ids[::7]), dtype=np.uint64)
            doc_ids, nulls, lengths, back = simple8b.read_image(simple8b.write_image(np.array([5]), np.array([False]), np.array([n]), ids))
            assert np.array_equal(ids, back) and doc_ids.tolist() == [5] and lengths.tolist() == [n]


def test_word_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(TOKENIZER), random.Random(1)
    encoder = simple8b.WordEncoder(TOKENIZER, most=500)
    letters = "aAbé.,'’ \n\t0١s<|>テ́ΣİK‍!?-_re"
    texts = [None, "", "<|startoftext|>Hi<|endoftext|>. <|ENDOFTEXT|>,"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for k in range(0, len(texts), 100):
        ids, lengths = encoder.encode(texts[k : k + 100], 1)
        at = 0
        for t, n in zip(texts[k : k + 100], lengths, strict=True):
            assert ids[at : at + n].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 1]
            at += n


def test_token_output(spark, docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    images = simple8b.encode_documents(docs, TOKENIZER, image_ids=50, per_part=100)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in simple8b.read_documents(images).collect())
    at, want = 0, []
    for i, t in sorted(all_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want and simple8b.token_table(empty, TOKENIZER).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    start = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, base)
        if name != "token_output":
            assert docs.columns == start.columns
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    before = spark.read.parquet(f"{tmp_path}/near_dedup")
    held = {r["doc_id"] for r in decontaminate.matches(before, spark.read.parquet(f"{base}/benchmark.parquet")).collect()}
    after = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/decontamination").collect()}
    assert after == {r["doc_id"] for r in before.collect()} - held
    assert {r["doc_id"] for r in docs.collect()} == after


@pytest.mark.parametrize(
    "name, table, columns",
    [
        ("op1_temperature_mixing", "documents", ["doc_id", "source", "n_tokens", "epoch", "block"]),
        ("op6_reply_trees", "conversations", ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]),
        ("op7_recompression_dedup", "documents", ["doc_id", "n_words", "n_removed", "kept_sha256"]),
    ],
)
def test_sql(spark, name, table, columns):
    import duckdb

    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{base}/{table}.parquet'")
    want = sorted(con.execute(queries.oracle_sql()[name]).fetchall(), key=str)
    got = queries.queries()[name](spark, base).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_hashes_of_words():
    from graphloom.llm import _bytes

    raw, off = _bytes.strings(pa.array(["ab cd", None, "", " cd\nab ab"]))
    starts, ends, first = _bytes.tokens(raw, off)
    h = _bytes.span_hash(_bytes.prefix_sums(raw), starts, ends).tolist()
    assert first.tolist() == [0, 2, 2, 2, 5] and h[0] == h[3] == h[4] and h[1] == h[2] != h[0]


def thue_morse(n, swap):
    return "".join("ab"[bin(i).count("1") % 2 ^ swap] for i in range(n))


def test_long_regular_words_are_told_apart(spark):
    x, y = (thue_morse(1024, s) for s in (0, 1))
    *_, words_, first = ctw.stream(pa.array([x, y, f"{x} {y} {x}"]))
    a, b, c, d, e = words_.tolist()
    assert first.tolist() == [0, 1, 2, 5] and a == c == e and b == d != a
    head = " ".join(f"w{k}" for k in range(49))
    rows = spark.createDataFrame([(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{head} {x}")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in recompress.digests(rows).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_stages_take_columns_of_any_name(spark):
    names = ["toxic", "_ID", "_held", "_sha", "_least", "_rows", "_kept", "_set", "_set_", "_toxic_score", "_p", "_c"]
    same = "a passage of words that stands in two documents here"
    data = [(1, same), (2, same), (3, "You scumbag"), (4, None), (4, "other text under one id"), (None, "the benchmark item itself"), (None, "plain"), (5, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    df = spark.createDataFrame([(i, t, "en", "s", 1, *[7] * len(names)) for i, t in data], schema).repartition(2)
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 0), (4, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "the benchmark item itself")], "item_id long, text string")
    everything = sorted(map(str, data))
    held = lambda got: sorted(str((r["doc_id"], r["text"])) for r in got.select("doc_id", "text").collect())
    near, clean = nearcopies.keep_one(df), decontaminate.clean(df, items)
    assert near.columns == clean.columns == df.columns
    assert held(near) == [x for x in everything if x not in (str(data[1]), str(data[7]))]  # 5 as the empty row of 4
    assert held(clean) == [x for x in everything if x != str(data[5])]
    assert textcnn.clean(df, labels).columns == df.columns
    assert held(mixing.mix(df)) and set(held(mixing.mix(df))) == set(everything)
    assert len(textcnn.toxicity(df, labels).collect()) == len(data)
    assert len(recompress.digests(df).collect()) == len(simhash.near_duplicates(df).collect()) == len(multihash.edited(df).collect()) == len(data)
