"""Fill-in-middle, fuzzy hashing of fingerprints and hard negatives against plain versions."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from stratagraph.llm import hardneg, infill, simhash

SCHEMA = "doc_id long, text string, output string, restored string, fp long, key long"
ODD = ["", " ", "\n\n", "a", "  a b ", "日本語 😀😀 x", "a <P> b", "x<S>", "<M>", "< <P a b <S < M> c <", "a\x0bb\x0cc\x1cd", "\x00 \x00", "é   z\n"]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x", "y", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def plain_infill(doc_id, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_plain_version(spark):
    r = random.Random(3)
    texts = ODD + ["".join(r.choice(["a", " ", "\n", "é", "<", "P", ">", "日"]) for _ in range(r.randint(1, 60))) for _ in range(300)] + ["word é " * 30000]
    df = docs(spark, [*texts, None]).unionByName(docs(spark, texts[:5]))
    rows = infill.restored(infill.infilled(df)).collect()
    assert len(rows) == len(texts) + 6
    forms = set()
    for x in rows:
        t = (texts[x.doc_id] if x.doc_id < len(texts) else None) or ""
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plain_infill(x.doc_id, t) and x.restored == t
        forms.add(x.form)
    assert forms == {"plain", "psm", "spm"}
    empty = spark.createDataFrame([], SCHEMA)
    assert infill.restored(infill.infilled(empty)).count() == 0
    nameless = spark.createDataFrame([(None, "a b c", "x", "y", 1, 2)], SCHEMA)
    assert infill.restored(infill.infilled(nameless)).first().restored == "a b c"


def test_rotation_inverts():
    r = random.Random(1)
    for _ in range(200):
        raw = bytes(r.randrange(97, 100) for _ in range(r.randint(0, 40)))
        a, b = sorted(r.randint(0, len(raw)) for _ in range(2))
        buf = bytearray(raw)
        infill.exchange(np.frombuffer(buf, np.uint8), a, b, len(raw))
        assert bytes(buf) == raw[:a] + raw[b:] + raw[a:b]


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_reachable(ids, fps):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def planted_texts():
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = ["", "  ", "Solo", "A b", "a B", "a b c", None]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice((6, 40, 400)))]
        for _ in range(r.randint(1, 6)):
            now = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 4))):
                now[r.randrange(len(now))] = r.choice(words)
            texts.append("\n ".join(now))
    return texts


@pytest.mark.parametrize("part", [2048, 3])
def test_simhash_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    texts = planted_texts()
    df = docs(spark, texts, 100).unionByName(docs(spark, texts[:9], 100)).unionByName(spark.createDataFrame([(None, "a b", "x", "y", 1, 2), (None, "a lonely one of no other", "x", "y", 1, 2)], SCHEMA))
    given = [(100 + i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:9])] + [(None, "a b"), (None, "a lonely one of no other")]
    fps = [plain_fingerprint(t) for _, t in given]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, _), f, c in zip(given, fps, smallest_reachable([d for d, _ in given], fps), strict=True))
    got = sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in simhash.near_duplicates(df).collect())
    assert got == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want}) < len(want)


def test_simhash_of_no_rows_and_a_long_text(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "Some words of a text \t" * 40000
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)


def test_keys_lose_no_pair():
    """Two fingerprints at up to four bits share a key, as plain ones or as given and asked."""
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(400)]
    near = []
    for k, x in enumerate(base):
        for i in r.sample(range(64), k % 4 + 1):
            x ^= 1 << i
        near.append(x)

    def of(v):
        row, key, role = simhash.keys(np.array(v, np.uint64))
        out = [{} for _ in v]
        for a, b, c in zip(row.tolist(), key.tolist(), role.tolist(), strict=True):
            out[a][b] = c
        return out

    for x, y in zip(of(base), of(near), strict=True):
        assert any((x[k], y[k]) in ((0, 0), (1, 2), (2, 1)) for k in x.keys() & y.keys())


def test_golay_decoding_covers_the_space():
    """Every remainder stands for errors of at most three bits, and decoded words are codewords."""
    _, _, errors = simhash.decoder()
    assert len({int(e) for e in errors}) == 2048 and all(int(e).bit_count() <= 3 for e in errors)
    for v in random.Random(4).choices(range(1 << 23), k=50):
        assert simhash.remainder(v ^ int(errors[simhash.remainder(v)])) == 0


def test_search_joins_what_pairs_join():
    r = random.Random(6)
    v = np.array([sum(1 << b for b in r.sample(range(24), r.randint(0, 12))) for _ in range(300)], np.uint64)
    a, b = simhash.tree(v)
    values = sorted(set(v.tolist()))
    tree = {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    up = {x: x for x in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in tree:
        up[root(x)] = root(y)
    for x, y in combinations(values, 2):
        assert (x ^ y).bit_count() > 4 or root(x) == root(y)
    assert len(tree) == len(values) - len({root(x) for x in values})


VECTORS = "vec_id long, label int, embedding array<double>, key long, anchor string, rank int"


def plain_hard_negatives(rows, every=10):
    use = sorted({(i, (l + 1) % 10 if i % 7 == 0 else l, tuple(math.floor(256 * x) for x in v)) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in use:
        if a[0] % every == 0:
            scored = [(dot(a[2], b[2]), b) for b in use if b[0] != a[0]]
            same = sorted({(-s, b[0]) for s, b in scored if b[1] == a[1]})[:5]
            for p, of in same:
                p = -p
                hard = sorted({(-s, b[0]) for s, b in scored if b[1] != a[1] and 30 * p <= 100 * s <= 90 * p})[:10]
                out += [(a[0], of, k, n, p, -s) for k, (s, n) in enumerate(hard, 1)]
    return sorted(out)


def moved(vec_id, label):
    from pyspark.sql import functions as F

    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


@pytest.mark.parametrize("block", [8192, 16])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "SAMPLE", 40)
    monkeypatch.setattr(hardneg, "ASKED", 5)
    r = np.random.default_rng(4)
    rows = []
    for i in range(240):
        v = (r.normal(size=6) + 3 * np.eye(6)[i % 6]) * 2.0 ** r.integers(-3, 6)
        rows.append((i, int(i % 3), v.tolist()))
    rows += [(300, 1, [0.0] * 6), (301, 1, [1e30, -1e30, 2.0, 0.0, 0.0, 1.0]), (302, 1, [1.0, 2.0]), (303, None, [1.0] * 6), (304, 1, None), (305, 1, [1.0, None]), (306, 1, [float("nan")] * 6), (310, 2, []), (None, 1, [1.0] * 6)]
    rows += [rows[20], rows[20], (21, 2, rows[20][2]), (320, 1, rows[30][2]), (330, 1, rows[30][2])]
    df = spark.createDataFrame([(*x, 1, "a", 2) for x in rows], VECTORS)
    far = {301}  # its scores pass 64 bits
    got = sorted(tuple(x) for x in hardneg.hard_negatives(df, every=10, moved=moved).collect())
    want = plain_hard_negatives(rows)
    assert len(want) > 300 and [x for x in got if x[1] not in far] == [x for x in want if x[1] not in far]
    assert hardneg.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0


def test_ranges_prune_and_lose_nothing():
    """Clustered rows of many lengths: feasible ranges leave few candidates, and every row at the threshold is among them."""
    r = np.random.default_rng(7)
    centre = np.eye(32)[r.integers(0, 32, 3000)]
    x = np.floor((centre + 0.05 * r.normal(size=(3000, 32))) * r.uniform(200, 260, 3000)[:, None])
    b = hardneg.Block(np.arange(3000), np.zeros(3000, np.int64), x)
    met = 0
    for q in x[:50]:
        score = hardneg.products(x, q[None])[:, 0]
        least = np.sort(score)[-20]
        rows = b.feasible(q, float(hardneg.lengths(q[None])[0]), float(least))
        assert rows is not None and set(np.flatnonzero(score >= least)) <= set(rows.tolist())
        met += len(rows)
    assert met < 0.1 * 50 * 3000


def test_products_beyond_double_precision():
    x, q = np.array([[2.0**40, 1.0], [2.0**61, 2.0**61]]), np.array([[2.0**20, 3.0]])
    assert hardneg.products(x, q).tolist() == [[2**60 + 3], [2**63 - 1]]
