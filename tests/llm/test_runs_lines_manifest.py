"""Operators 11, 12 and 13 against brute force on small tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netspark.llm import line_dedup, merkle, periodic_runs, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- 11 -------------------------------------------------------------------------


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, q, n) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def odd_texts():
    rng = random.Random(1)
    vocab = ["a", "b", "éé", "longerword1", "longerword2", "x" * 17, "x" * 18, "y\x00", "y"]
    texts = [None, "", "a", " a b ", "a " * 12, "a " * 11, "a b " * 6, "b " + "a b c " * 5 + "a a a a a a a a a a a a"]
    for _ in range(150):
        n, kinds = rng.choice([3, 12, 13, 30, 60, 150]), rng.choice([1, 2, 3, 9])
        w = [rng.choice(vocab[:kinds]) for _ in range(n)]
        if rng.random() < 0.6 and n > 10:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    return texts


def test_runs_equal_brute_force(monkeypatch):
    texts = odd_texts()
    for block in (1 << 20, 100):  # candidates listed at once, or in many blocks
        monkeypatch.setattr(periodic_runs, "BLOCK", block)
        runs, kept = periodic_runs.runs_of(pa.array(texts, pa.string()))
        for text, r, c in zip(texts, runs.to_pylist(), kept.to_pylist(), strict=True):
            w = (text or "").split()
            want = brute_runs(w)
            assert [(x["start"], x["period"], x["length"]) for x in r] == want and c == collapsed(w, want)


def test_names_are_exact():
    words = ["", "a", "a\x00", "b" * 7, "b" * 8, "b" * 9, "c" * 64 + "d", "c" * 64 + "e", "a", "c" * 64 + "d"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    names = periodic_runs.word_names(data, start[1:], end[1:])
    assert [[a == b for b in names] for a in names] == [[a == b for b in words[1:]] for a in words[1:]]


def test_runs_of_long_texts():
    rng = random.Random(3)
    for text, want in (("w " * 200_000, [(0, 1, 200_000)]), (" ".join(str(i % 700) for i in range(100_001)), [(0, 700, 100_001)]), (" ".join(str(rng.randrange(10**9)) for _ in range(200_000)), [])):
        runs, _ = periodic_runs.runs_of(pa.array([text]))
        assert [(r["start"], r["period"], r["length"]) for r in runs[0].as_py()] == want


def test_runs_query(spark, tmp_path):
    """Planted periods, nulls, repeated rows and clashing columns."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([0, 5, 40])))) for i in range(60)] + [(None, "a " * 30), (7, None), (3, "x y " * 9), (3, "x y " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        w, h = (text or "").split(), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        runs = brute_runs(w)
        best = max(((n, -s, -q) for s, q, n in runs), default=None)
        told = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
        first = (None,) * 4 if best is None else (-best[1], best[0], -best[2], 1000 * best[0] // -best[2])
        want.append(tuple(map(str, (i, len(runs), *first, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))))
    got = [tuple(map(str, r)) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    clash = spark.createDataFrame([(1, "z", "a " * 12, "b")], "doc_id long, runs string, text string, collapsed string")
    made = periodic_runs.periodic_runs(clash)
    assert made.columns == ["doc_id", "text", "runs", "collapsed"] and made.first().collapsed == "a"
    assert periodic_runs.periodic_runs(clash.limit(0)).count() == 0


# --- 12 -------------------------------------------------------------------------


def brute_lines(rows, chars=20, documents=3):
    holders = defaultdict(set)
    keys = [[low(line.strip(SPACE)) for line in (t or "").split("\n")] for _, t in rows]
    for (i, _), own in zip(rows, keys, strict=True):
        for k in own:
            if len(k) >= chars and i is not None:
                holders[k].add(i)
    out = []
    for (i, t), own in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, own, strict=True) if len(k) < chars or len(holders[k]) < documents or i == max(holders[k])]
        out.append((str(i), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


def line_rows():
    rng = random.Random(4)
    long = ["Some line of the corpus %d" % i for i in range(12)] + ["ÀÉÎ" * 7, "ÀÉÎ" * 6 + "x", "x" * 19, "x" * 20]
    rows = []
    for i in range(80):
        lines = [rng.choice(["", " ", "\t", "  "]) + rng.choice([str.upper, str.lower, str])(rng.choice(long)) + rng.choice(["", "\r", " \x0b"]) if rng.random() < 0.6 else "".join(rng.choice("abc ") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(12))]
        rows.append((i % 70, "\n".join(lines)))
    return [*rows, rows[5], (None, long[0]), (None, long[0] + "\nmine"), (500, None), (501, ""), (502, "\n"), (-3, "\n".join(long)), (69, long[1] + "\n" * 5), (9, "a" * 1_000_000 + "\n" + long[2]), (10, "a" * 1_000_000), (11, "A" * 1_000_000)]


@pytest.mark.parametrize("chunk", [1 << 17, 20])
def test_line_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(line_dedup, "CHUNK_LINES", chunk)
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, n_lines int, source string").repartition(3)
    made = line_dedup.dedup_lines(docs)
    assert made.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in made.collect())
    assert got == brute_lines(rows) and sum(g[2] for g in got) > 50
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_hashes_of_lines_follow_their_bytes():
    rng = random.Random(6)
    texts = ["".join(rng.choice("aB é\n") for _ in range(rng.randrange(60))) for _ in range(50)] + ["q" * 600_000 + "\nq", "q" * 600_000]
    data, _, first, start, end = line_dedup.line_spans(pa.array(texts))
    want = [low(line.strip(SPACE)) for t in texts for line in t.split("\n")]
    got = [data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]
    assert [low(g) for g in got] == want and first[-1] == len(want)
    for base in (line_dedup._words.BYTE_BASE, line_dedup._words.WORD_BASE):
        h = line_dedup.span_hashes(data, start, end, line_dedup.FOLDED, base)
        assert len({*zip(h.tolist(), want, strict=True)}) == len(set(want)) == len(set(h.tolist()))


def test_perfect_hash_is_minimal_and_survives_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        made = line_dedup.PerfectHash.unpack(line_dedup.PerfectHash.build(keys).pack())
        assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
        assert sum(len(b) for b in made.levels) <= 5 * len(keys) + 64 * len(made.levels)  # bits a key


def test_keys_with_one_hash_are_told_apart():
    """Two different lines with the same 64 bits: the second stands in a list beside the arrays."""
    h1, h2, ids = np.array([5, 5, 5, 5, 9, 9], np.uint64), np.array([1, 1, 2, 2, 7, 7], "<u4"), np.array([3, 8, 4, 6, 1, 1])
    rows = pa.table({"shard": [0], "keys": [line_dedup.ex.pack_sorted(h1)], "prints": [h2.tobytes()], "ids": [ids.astype("<i8").tobytes()]})
    index = line_dedup.read_index(line_dedup._index_shard(rows, 3))
    count, largest = line_dedup.look_up(index, np.array([5, 5, 9, 9, 11], np.uint64), np.array([1, 2, 7, 8, 1], "<u4"))
    assert count.tolist() == [2, 2, 1, 0, 0] and largest[:3].tolist() == [8, 6, 1]


# --- 13 -------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, fold=False):
    i, text, lang, source, n = row
    out = ""
    for v in (i, source, lang, n, low(text) if fold and text is not None else text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(out)


def tree(leaves):
    """Root, and the siblings of every leaf as a list of (left, right) by level."""
    level, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, pos in enumerate(at):
            a = pos // 8 * 8
            proofs[leaf].append(("".join(level[a:pos]), "".join(level[pos + 1 : a + 8])))
            at[leaf] = pos // 8
        level = [digest("".join(level[a : a + 8])) for a in range(0, len(level), 8)]
    return level[0], proofs


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    done = []
    for g in langs:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        done.append((own, *tree([brute_leaf(r) for r in own])))
    root, over = tree([d[1] for d in done])
    out = []
    for (own, sub, proofs), above in zip(done, over, strict=True):
        for r, p in zip(own, proofs, strict=True):
            path, cur = p + above, brute_leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for a, b in path:
                cur = digest(a + cur + b)
            out.append((str(r[0]), brute_leaf(r), sub, root, digest("".join(a + b for a, b in path)), cur, cur == root))
    return sorted(out)


def manifest_rows():
    rng = random.Random(8)
    sizes = {"en": 600, "de": 65, "fr": 64, "É": 9, "z": 8, None: 10, "one": 1, "": 2} | {f"l{i}": 1 for i in range(70)}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += rng.choice([1, 1, 1, 7])
            rows.append((i, rng.choice([None, "", "Text %d" % i, "lower", "ÉÀ x"]), lang, rng.choice([None, "s"]), rng.choice([None, 5])))
    return [*rows, rows[10], rows[10], (None, "Null id", "en", None, 1), (None, "Null id", "en", None, 1), (rows[3][0], "same id", "en", "s", 2), (90_000, "L" * 300_000, "de", None, 300_000)]


def test_manifest(spark, tmp_path):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", root int").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(map(str, r[:1])) + tuple(r[1:]) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    want = brute_manifest(rows)
    assert sorted(got) == want and {g[6] for g in got} == {True, False}
    made = merkle.manifest(docs, path=f"{tmp_path}/store")
    assert made.root() == want[0][3]
    stored = spark.read.parquet(f"{tmp_path}/store/rows")
    assert [r["count"] for r in stored.groupBy("level").count().orderBy("level").collect()][0] == len(rows)
    assert made.proofs().count() == len(rows)


def test_manifest_of_little(spark):
    none = spark.createDataFrame([], SCHEMA)
    empty = merkle.manifest(none)
    assert empty.root() is None and empty.proofs().count() == 0
    row = (1, "T", "en", None, 1)
    one = merkle.manifest(spark.createDataFrame([row], SCHEMA)).proofs().first()
    assert one.leaf == one.subroot == one.root == brute_leaf(row) and one.proof == []


def test_parts_of_levels_do_not_depend_on_batches():
    """Children that streams tear apart come together again: whole parents here, pieces there."""
    rng = np.random.default_rng(2)
    pos, digests = np.arange(100), [digest(str(i)) for i in range(100)]
    want = {p: digest("".join(digests[8 * p : 8 * p + 8])) for p in range(13)}
    for _ in range(20):
        edges = np.sort(rng.choice(np.arange(1, 100), rng.integers(0, 30), replace=False))
        whole, pieces = {}, defaultdict(list)
        for part in np.split(pos, edges):
            batch = pa.RecordBatch.from_arrays([pa.array(["t"] * len(part)), pa.array(part), pa.array([100] * len(part)), pa.array([digests[i] for i in part])], names=["tree", "pos", "width", "digest"])
            for r in next(merkle._parts(iter([batch]), 8)).to_pylist():
                if r["whole"]:
                    whole[r["parent"]] = r["digests"][0]
                else:
                    pieces[r["parent"]] += zip(r["pos"], r["digests"], strict=True)
        assert whole | {p: digest("".join(d for _, d in sorted(x))) for p, x in pieces.items()} == want


def test_folding_is_the_inverse_of_proving(spark):
    leaves = [digest(str(i)) for i in range(20)]
    table = spark.createDataFrame([("t", i, 20, d) for i, d in enumerate(leaves)], "tree string, pos long, width long, digest string")
    made = merkle.build(table, f"{merkle.shared_folder(spark)}/fold-test")
    root, _ = tree(leaves)
    tops = spark.createDataFrame([("t",)], "tree string").select("tree", F.array().cast(merkle.STEP).alias("proof"))
    got = merkle.prove(made, tops).select(merkle.fold(F.col("digest"), F.col("proof")).alias("r")).collect()
    assert made.roots().first().digest == root and {r.r for r in got} == {root} and len(got) == 20
