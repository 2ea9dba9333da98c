"""Operators 1, 2, 4, 6, 7, 8, 10 and the word helper against brute force on small tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from netspark.llm import _exchange, _words, decontamination, jaccard, quality_model, quality_rules, queries, substring_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"w{i}" for i in range(60)] + ["Ünï", "É", "x" * 300]


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, empty texts and repeated rows."""
    rng = random.Random(seed)
    words = lambda k: [rng.choice(VOCAB) for _ in range(k)]
    passage, rows = words(30), []
    for i in range(n):
        text = words(rng.choice([0, 1, 4, 5, 12, 13, 40, 200]))
        if i % 5 == 0:
            text = text[:10] + passage + text[10:]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    for i in range(n, n + 20):
        text = rows[i - n][1].split()
        if text and i % 2:
            text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text)))
    return [*rows, rows[6], (None, rows[7][1]), (None, None), (n + 50, None), (n + 51, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 7 == 0 else f"s{(i or 0) % 3}", len(t or "")) for i, t in corpus()], SCHEMA).repartition(5)


def spaced(text):
    return (text or "").encode().split()


def lower(word):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def test_words_split_like_a_regex():
    texts = ["", None, "a", " a\tb\x0bc ", "É x y", "one\ntwo"]
    words = _words.split(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own = [words.data[s:e].tobytes() for s, e in zip(words.start[words.first[i] : words.first[i + 1]], words.end[words.first[i] : words.first[i + 1]], strict=True)]
        assert own == spaced(t)
    again = _words.split(pa.array(["b a", "a"], pa.string()))
    assert again.hash[1] == again.hash[2] != again.hash[0]


def test_packed_keys_round_trip():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (_exchange.unpack_sorted(_exchange.pack_sorted(keys)) == keys).all()
    small = np.array([0, 70000, 3])
    assert (_exchange.unpack_small(_exchange.pack_small(small)) == small).all()
    assert [p for p, _, _ in _exchange.cuts(keys, 7)] == list(range(7))


def test_jaccard_components(docs):
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    sets = {}
    for r in rows:
        w = [lower(x) for x in spaced(r.text)]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    for r in jaccard.components(docs).collect():
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id))
    kept = [r.doc_id for r in jaccard.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({root(k) for k in sets}) and kept.count(None) == 2


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**64, 120, dtype=np.uint64))
    sets = [np.sort(np.unique(np.concatenate([rng.choice(base, 112, replace=False), rng.integers(0, 2**64, int(k), dtype=np.uint64)]))) for k in rng.integers(0, 40, 80)]
    tree = jaccard.SignatureTree(np.array([len(s) for s in sets]), [jaccard.signature(s) for s in sets])
    met = {(min(x, y), max(x, y)) for i, j in tree.pairs() for x, y in zip(i.tolist(), j.tolist(), strict=True)}
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard.linked(sets[i], sets[j])}
    assert links and links <= met
    # thirty groups of near copies: the traversal leaves out most pairs of leaves
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**64, 100, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(100) < 0.95], rng.integers(0, 2**64, 3, dtype=np.uint64)])) for _ in range(10)]
    tree = jaccard.SignatureTree(np.array([len(s) for s in sets]), [jaccard.signature(s) for s in sets])
    tested, every = tree.tested()
    assert tested < every / 2
    met = {(min(x, y), max(x, y)) for i, j in tree.pairs() for x, y in zip(i.tolist(), j.tolist(), strict=True)}
    assert {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard.linked(sets[i], sets[j])} <= met
    print("pairs of sets tested", tested, "of", every)


def test_substring_dedup(docs):
    rows = docs.select("doc_id", "text").collect()
    late = 10**9
    first = {}
    for r in rows:
        w = spaced(r.text)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, late), late if r.doc_id is None else r.doc_id)
    want = []
    for r in rows:
        w = spaced(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < (late if r.doc_id is None else r.doc_id):
                gone[i : i + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((str(r.doc_id), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(docs).collect()]
    assert sorted(got) == sorted(want) and any(g[2] for g in got)
    cleaned = substring_dedup.dedup_substrings(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()


def test_paths_are_compacted_and_verified(spark):
    rng = random.Random(9)
    words = lambda k: [f"y{rng.randrange(10**6)}" for _ in range(k)]
    passage, branch = words(3000), words(40)
    one, two, three = words(20) + passage, passage[:1500] + words(20), passage[100:140] + branch
    rows = [(1, one), (2, words(30) + passage + words(30)), (3, two), (4, three), (5, three), (None, branch)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    paths = sorted((r.doc_id, r.start, r.n_edges, r.source_id, r.source_start) for r in substring_dedup.repeated_paths(table).collect())
    late = int(substring_dedup.LATEST)
    # 4 leaves the passage at its word 140: a branch, so the paths of 2 and 3 end there too and go on after it
    assert [p for p in paths if p[0] == 2] == [(2, 30, 128, 1, 20), (2, 158, 2860, 1, 148)]
    assert [p for p in paths if p[0] == 3] == [(3, 0, 128, 1, 20), (3, 128, 1360, 1, 148)]
    assert [p for p in paths if p[0] == 4] == [(4, 0, 28, 1, 120)]
    assert [p for p in paths if p[0] == late] == [(late, 0, 28, 4, 40)]
    assert [p[3] for p in paths if p[0] == 5] == [1, 4] and sum(p[2] for p in paths if p[0] == 5) == 28 + 40
    # a path that hashes merged by chance is refused: its words are not the source's
    text = " ".join(two)
    right = {"start": 5, "n": 20, "digest": substring_dedup.span_digest([w.encode() for w in two], 5, 20)}
    assert substring_dedup._kept(text, [right])[2] == 20
    assert substring_dedup._kept(text, [right, right | {"start": 6}, right | {"start": 1515}])[2] == 20


def test_texts_that_share_an_id(spark):
    rng = random.Random(5)
    words = lambda k: [f"x{rng.randrange(10**6)}" for _ in range(k)]
    source, own, other, late, later = words(60), words(60), words(60), words(60), words(60)
    lost = lambda text, at: text[:at] + source[10:30] + text[at:]
    texts = [(1, source, 0), (4, own, 0), (4, lost(other, 25), 20), (None, lost(late, 5), 20), (None, later, 0)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t, _ in texts], "doc_id long, text string").repartition(3)
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(table).collect()]
    kept = [own, other, late, later]
    assert sorted(got) == sorted((str(i), len(t), n, hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, t, n), k in zip(texts, [source, *kept], strict=True))
    assert sorted(r.text for r in substring_dedup.dedup_substrings(table).collect()) == sorted(" ".join(k) for k in [source, *kept])

    near = lambda text: [*text[:-1], "changed"]
    one, two, three = words(60), words(60), words(60)
    texts = [(5, one), (5, two), (5, near(two)), (2, near(one)), (7, near(two)), (8, two), (9, three), (9, [*three, "more"]), (9, own), (None, one), (None, two)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").repartition(3)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in jaccard.components(table).collect()) == [("2", "2"), ("5", "2"), ("5", "5"), ("5", "5"), ("7", "5"), ("8", "5"), ("9", "9"), ("9", "9"), ("9", "9"), ("None", "None"), ("None", "None")]
    rows = [(r.doc_id, r.text.split()) for r in jaccard.keep_one(table).collect()]
    assert sorted(str(i) for i, _ in rows) == ["2", "5", "9", "9", "None", "None"]
    assert (2, near(one)) in rows and (9, own) in rows and (5, one) not in rows


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination(spark, docs, block):
    words = corpus()
    items = [(1, " ".join(words[15][1].split()[3:25])), (2, "w1 w2"), (3, None), (None, words[0][1]), (10, ""), (11, "w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if i is not None and w else 0):
            windows[tuple(w[j : j + k])].add(i)
    want = []
    for r in docs.select("doc_id", "text").collect():
        w, hit, found = cut(r.text), set(), set()
        for g, who in windows.items():
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j : j + len(g)]) == g:
                    hit |= set(range(j, j + len(g)))
                    found |= who
        want.append((str(r.doc_id), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    got = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.report(docs, bench, block_bytes=block).collect()]
    assert sorted(got) == sorted(want) and any(g[5] for g in got)
    assert decontamination.decontaminate(docs, bench, block_bytes=block).count() == sum(not w[5] for w in want)


def test_benchmark_items_over_several_blocks(spark):
    """An item on several rows counts once, whatever block they lie in; windows longer than a dozen words; matches by brute force."""
    rng = random.Random(8)
    words = [f"a{i}" for i in range(30)]
    item = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(6)]
    bench = spark.createDataFrame([(i // 3, t) for i, t in enumerate(item)] + [(7, "")], "item_id long, text string")
    texts = [" ".join([*(rng.choice(words) for _ in range(9)), *a.split()[:17], "gap", *b.split()]) for a, b in zip(item, item[1:] + item[:1], strict=True)]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words long, item_id string").repartition(2)
    whole = sorted(map(tuple, decontamination.report(docs, bench).collect()))
    for block in (60, 130, 1 << 20):
        assert sorted(map(tuple, decontamination.report(docs, bench, block_bytes=block).collect())) == whole
    assert {r[0]: r[3] for r in whole} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1, 5: 2}
    assert decontamination.decontaminate(docs, bench, block_bytes=60).columns == docs.columns
    for window in (5, 15, 20):
        want = set()
        for d, text in enumerate(texts):
            w = text.split()
            for i, t in enumerate(item):
                b = t.split()
                for x in range(len(w)):
                    for y in range(len(b)):
                        n = 0
                        while x + n < len(w) and y + n < len(b) and w[x + n] == b[y + n]:
                            n += 1
                        if n >= window and (x == 0 or y == 0 or w[x - 1] != b[y - 1]):
                            want.add((d, i // 3, x, n))
        assert {tuple(r) for r in decontamination.matches(docs, bench, window, block_bytes=100).collect()} == want


def test_token_counts_equal_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary())
    for r in token_counts.token_digest(docs, queries.vocabulary()).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        assert r.n_tokens == len(model.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
    count = token_counts.PrefixCounter(queries.vocabulary())
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab the  \n\t▁é<s>[/INST]漢🙂\u0000") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for _ in range(2):  # worked out, and looked up
        counts, at = count.prefixes(texts)
        for i, text in enumerate(texts):
            assert counts[at[i] : at[i + 1]].tolist() == [len(model.encode(text[:n])) for n in range(len(text) + 1)]
    long = " ".join(rng.choice(["internationalisation", "a", "xyzzy"]) for _ in range(100_000))
    assert count.prefixes([long])[0][-1] == len(model.encode(long))


def test_stored_prefix_counts_answer_budgets(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary())
    texts = ["the quick brown fox jumps over the lazy dog " * 5, "", None, "漢字 ab", "x" * 50]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    stored = token_counts.prefix_table(docs, queries.vocabulary())
    assert stored.columns == [*docs.columns, "token_prefix"]
    for budget in (0, 3, 10, 1000):
        for r in token_counts.truncate(stored, budget).collect():
            text = texts[r.doc_id]
            best = max(i for i in range(len(text or "") + 1) if len(model.encode((text or "")[:i])) <= budget)
            assert r.text == (None if text is None else text[:best]) and len(r.token_prefix) == best + 1
    assert [(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, queries.vocabulary()).orderBy("doc_id").collect()] == [(i, len(model.encode(t or ""))) for i, t in enumerate(texts)]


def test_quality_rules(spark, docs):
    got = {str(r.doc_id): r for r in quality_rules.quality_rules(docs.dropDuplicates(["doc_id"])).collect()}
    for r in docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        w = spaced(r.text)
        seen = defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        g = got[str(r.doc_id)]
        assert (g.n_words, g.n_repeat_words) == (len(w), len(covered))
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (g.kept and g.base_failed)
    odd = spark.createDataFrame([(1, "a a\n \na a\nb"), (2, "x#y $ | é<")], "doc_id long, text string")
    one, two = quality_rules.quality_rules(odd).orderBy("doc_id").collect()
    assert (one.n_dup_lines, two.n_symbols, two.word_chars) == (1, 4, 7)
    assert quality_rules.filter_quality(docs).columns == docs.columns


def test_em_separates_bad_rows(spark):
    """EM in SQL equals the same steps in numpy."""
    rng = np.random.default_rng(5)
    pats = [([0] * 6 + [1, 1], 80.0), ([-1, 0, 0, 0, 0, 0, 0, 1], 9.0), ([0, 0, -1, -1, 0, 0, 0, 0], 7.0), ([0] * 8, float(rng.integers(3, 9)))]
    row = quality_rules.accuracies(spark.createDataFrame(pats, "votes array<int>, n double"), 10).first()
    prior, good, bad = quality_rules.PRIOR, np.tile(quality_rules.ON_GOOD, (8, 1)), np.tile(quality_rules.ON_BAD, (8, 1))
    votes, n = np.array([p[0] for p in pats]) + 1, np.array([p[1] for p in pats])
    for _ in range(10):
        g, b = prior * good[np.arange(8), votes].prod(1), (1 - prior) * bad[np.arange(8), votes].prod(1)
        post = g / (g + b)
        prior = ((n * post).sum() + quality_rules.PSEUDO * quality_rules.PRIOR) / (n.sum() + quality_rules.PSEUDO)
        for side, share, before in ((good, n * post, quality_rules.ON_GOOD), (bad, n * (1 - post), quality_rules.ON_BAD)):
            for v in range(3):
                side[:, v] = ((share[:, None] * (votes == v)).sum(0) + quality_rules.PSEUDO * before[v]) / (share.sum() + quality_rules.PSEUDO)
    assert row.prior == pytest.approx(prior) and np.allclose(row.good, good.ravel()) and np.allclose(row.bad, bad.ravel())


def labelled(spark, bad_word, n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = [rng.choice(VOCAB[:60]) for _ in range(rng.randint(10, 40))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), bad_word(rng))
        rows.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, y int")


def test_toxicity_learns_subwords(spark):
    data = labelled(spark, lambda rng: "scoundrel"[: rng.randint(7, 9)] + rng.choice(["", "s", "x"]))
    got = toxicity.score(data.select("doc_id", "text"), data.selectExpr("doc_id", "y as toxic")).join(data, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and held
    assert np.mean([(r.score >= 0.3) == r.y for r in held]) > 0.9
    empty = toxicity.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), data.selectExpr("doc_id", "y as toxic").limit(0)).collect()
    assert [r.score for r in empty] == [0.5, 0.5]


def test_toxicity_of_misspellings_that_training_never_saw(spark):
    rng = random.Random(12)
    bad, typos = ["scoundrel", "blockhead", "nincompoop"], ["scooundrel", "scoundrrel", "blockheaad", "bl0ckhead", "nincompooop", "nincompopo"]
    rows = [[rng.choice(VOCAB[:60]) for _ in range(rng.randint(20, 60))] for _ in range(600)]
    toxic = [rng.random() < 0.3 for _ in rows]
    for words, t in zip(rows[:500], toxic, strict=False):
        if t:
            words.insert(5, rng.choice(bad))
    model = toxicity.train([" ".join(w) for w in rows[:500]], [int(t) for t in toxic[:500]])
    clean = model.scores(pa.array([" ".join(w) for w in rows[500:]]))
    misspelt = model.scores(pa.array([" ".join([*w[:9], rng.choice(typos), *w[9:]]) for w in rows[500:]]))
    assert (clean < 0.3).mean() > 0.95 and (misspelt >= 0.3).mean() > 0.9
    long = " ".join(rng.choice(VOCAB[:60]) for _ in range(300_000))
    assert model.scores(pa.array([None, "", long], pa.string())).max() < 0.3


def test_quality_model_learns_passages(spark):
    data = labelled(spark, lambda rng: "word%%%")
    got = quality_model.score(data.select("doc_id", "text"), data.selectExpr("doc_id", "1 - y as quality")).join(data, "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == (r.y == 0) for r in got if r.held_out]) > 0.9
    model = quality_model.train([r.text for r in got], [1 - r.y for r in got])
    assert model.attention("a " * 500).sum() == pytest.approx(1.0) and len(model.scores(pa.array([None, ""], pa.string()))) == 2


def test_gradients_of_the_quality_model():
    rng = np.random.default_rng(0)
    model = quality_model.train(["a b# c " * 40, "D e f"], [1, 0])
    bag, y = quality_model.bags(pa.array(["a b# c " * 40, "D e f"])), np.array([1.0, 0.0])
    loss = lambda: -np.mean(y * np.log(model.forward(bag, 2)["s"]) + (1 - y) * np.log(1 - model.forward(bag, 2)["s"]))
    grads = model.gradients(bag, y)
    for name in ("V", "U", "w", "c"):
        at = tuple(rng.integers(0, s) for s in model.p[name].shape)
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        down = loss()
        model.p[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grads[name][at], rel=1e-3, abs=1e-7)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for made in (jaccard.components(none), substring_dedup.report(none), token_counts.token_digest(none, queries.vocabulary()), quality_rules.quality_rules(none), quality_rules.filter_quality(none)):
        assert made.count() == 0
