import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import similarity as S
from vellum.llm.common import Scratch, bit_array, bit_filter, in_bits, passing
from vellum.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(texts, ids, percent=80):
    sets = [shingles(t) for t in texts]
    index = {}
    for d, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in index.values() if len(ds) < 200 for a in ds for b in ds if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(len(sets), links)
    least = {}
    for d, r in enumerate(root):
        if ids[d] is not None:
            least[r] = min(least.get(r, ids[d]), ids[d])
    return sorted(((ids[d], len(s), least.get(root[d]) if s else ids[d]) for d, s in enumerate(sets)), key=str)


def check(frame):
    rows = frame.select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in S.jaccard_components(frame).collect()), key=str)
    assert got == brute([r.text for r in rows], [r.doc_id for r in rows])
    return got


def test_given_documents(documents):
    got = check(documents)
    assert len({c for _, _, c in got}) < len(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_families(docs, seed):
    """Chains of near copies with similarities around the threshold, copies, short and empty texts."""
    r = random.Random(seed)
    texts = [None, "", " ", "a", "A", "a b c", "a b  c", "x y z u v", "x y z u v w", "é É"]
    for _ in range(12):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(6, 120))]
        for _ in range(r.randint(1, 14)):
            texts.append(r.choice([" ", "\n"]).join(base))
            base = list(base)
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(base))
                base[at:at + r.randint(0, 1)] = [f"w{r.randint(0, 400)}"] if r.random() < 0.8 else []
    r.shuffle(texts)
    check(docs(texts, ids=[3 * k + 7 for k in range(len(texts))]))


def test_repeated_rows_null_ids_and_long_text(docs):
    long = " ".join(f"n{k}" for k in range(60_000))
    texts = ["p q r s t u"] * 3 + [long, long + " end", "lone text of five words", None, None, "P q r s t u"]
    check(docs(texts, ids=[9, 9, 4, 12, 11, None, None, 6, None]))
    assert S.jaccard_components(docs([])).collect() == []


def test_prefix_size():
    n = np.arange(0, 2000)
    assert list(S.prefix_size(n, 80)) == [0] + [x - -(-80 * x // 100) + 1 for x in range(1, 2000)]


def test_shingle_sets_against_definition():
    texts = ["a b c d e f a b c d e f", None, "A b", "", "x x x x x x x"]
    h, first = S.shingle_sets(pa.array(texts), 5)
    assert list(np.diff(first)) == [len(shingles(t)) for t in texts]


def test_components(spark):
    """Paths, a star, a cycle, two nodes."""
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (301, 300)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.root for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((200, 201, 202), 200), 300: 300, 301: 300}
    assert components(df.where("a < 0"), Scratch(spark, "test")).collect() == []


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_bit_filter_lets_every_member_pass(spark, bits):
    rng = np.random.default_rng(1)
    keys = rng.integers(-2**63, 2**63 - 1, 500)
    other = rng.integers(-2**63, 2**63 - 1, 5000)
    maps = bit_filter(spark.createDataFrame([(int(k),) for k in keys], "h bigint"), "h", bits)
    taken = {int(k) & (bits - 1) for k in keys}
    array = bit_array(maps, bits)
    assert in_bits(array, keys.view(np.uint64)).all()
    want = [int(k) for k in other if int(k) & (bits - 1) in taken]
    assert other[in_bits(array, other.view(np.uint64))].tolist() == want
    df = spark.createDataFrame([(int(k),) for k in other], "h bigint")
    assert sorted(r.h for r in passing(df, "h", maps, bits).collect()) == sorted(want)


def test_distinct_lists_keep_every_pair(spark):
    """Lists with equal members come once, as the one that stands first; each pair of members still meets at its first list."""
    import random
    from vellum.llm.common import Scratch
    from vellum.llm.similarity import _distinct_lists

    rnd = random.Random(6)
    groups = [rnd.sample(range(40), rnd.randrange(2, 6)) for _ in range(12)]
    rows, at = [], {c: 0 for c in range(40)}
    for s in range(80):
        for c in groups[rnd.randrange(12)]:
            rows.append((s, c, 100, at[c]))
            at[c] += 1
    got = [tuple(r) for r in _distinct_lists(spark.createDataFrame(rows, "s bigint, c bigint, n int, pos int"), Scratch(spark, "test")).select("s", "c", "pos", "weight").collect()]
    first = lambda entries: {(a[1], b[1]): min((a[2], a[0]) for a, b in [(a, b)]) for a in reversed(entries) for b in reversed(entries) if a[0] == b[0] and a[1] < b[1]}
    whole = sorted((s, c, p) for s, c, _, p in rows)
    assert first(whole) == first(sorted((s, c, p) for s, c, p, _ in got))
    lists = {frozenset(c for t, c, _, _ in rows if t == s) for s, _, _, _ in rows}
    assert len({s for s, _, _, _ in got}) == len(lists)
    assert sum({s: w for s, _, _, w in got}.values()) == len({s for s, _, _, _ in rows})


def test_one_of_each_with_clashing_columns(spark):
    from vellum.llm.similarity import one_of_each

    text = "one two three four five six seven"
    rows = [(1, text, 5, 6, "x"), (2, text, 7, 8, "y"), (None, text, 1, 1, "z"), (3, None, 9, 9, "n"), (3, None, 9, 9, "n"), (4, "other words", 0, 0, "o")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _t int, _id int, has_words string")
    assert sorted(tuple(r) for r in one_of_each(df).collect()) == sorted([rows[0], rows[3], rows[4], rows[5]], key=lambda r: r[0])


def test_parities_of_many_short_sets():
    import numpy as np
    from vellum.llm.similarity import PARTS, parities

    rnd = np.random.default_rng(2)
    n = rnd.integers(0, 5, 1300)
    h = rnd.integers(0, 1 << 63, n.sum()).astype(np.uint64) * np.uint64(2)
    got = np.stack(parities(h, n), 1)
    at = 0
    for k, size in enumerate(n):
        bits = np.zeros(PARTS, np.uint8)
        for x in h[at:at + size]:
            bits[int(x) * PARTS >> 64] ^= 1
        at += size
        assert (np.packbits(bits, bitorder="little").view(np.int64) == got[k]).all()
    assert np.stack(parities(h[:0], n[:0]), 1).shape == (0, PARTS // 64)


def test_copies_of_one_text_leave_few_pairs(docs, monkeypatch):
    """Copies that differ more and more from a text: whoever links with it is found by the leaders, so the pairs joined in full, and
    those whose whole sets are compared, do not grow with the square of the group."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base)]
    for k in range(120):
        own = list(base)
        for at in r.sample(range(400), k % 61):
            own[at] = f"x{k}-{at}"
        texts.append(" ".join(own))
    # long texts that share a passage alone
    texts += [" ".join([f"y{k}-{i}" for i in range(900)] + base[:60] + [f"z{k}-{i}" for i in range(900)]) for k in range(40)]
    r.shuffle(texts)
    rows, save = {}, Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        rows[name] = out.count() if name == "pairs" or name.endswith("-salted") else None
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    got = check(docs(texts))
    assert len({c for _, _, c in got}) < len(texts)
    assert rows["pairs"] < 10
    assert rows["links-salted"] < 10


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(5)
    for size in (1, 5, 63, 64, 700, 3000):
        a = rnd.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2) + rnd.integers(0, 2, size).astype(np.uint64)
        for kept in (0, size // 2, size - size // 9, size):
            b = np.concatenate([a[:kept], rnd.integers(0, 1 << 63, size // 5).astype(np.uint64)])
            n = np.array([size, 0, len(b)])
            x, none, y = S.sketches(np.concatenate([a, b]), n).to_pylist()
            apart = len(set(a.tolist()) ^ set(b.tolist()))
            assert none == b""
            assert not len(b) or S.differing(x, y) == S.differing(y, x) <= apart
            assert S.differing(x, x) == 0
        other = rnd.integers(0, 1 << 63, size).astype(np.uint64)
        x, y = S.sketches(np.concatenate([a, other]), np.array([size, size])).to_pylist()
        assert size < 500 or S.differing(x, y) > 0.7 * size
    assert S.sketches(np.zeros(0, np.uint64), np.zeros(0, np.int64)).to_pylist() == []
