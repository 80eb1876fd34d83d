import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from vellum.llm import decontaminate as D


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_lcs(a, b):
    assert D.lcs(a, b) == brute_lcs(a, b)


def test_passages():
    """Every word lies in a window, windows keep to their document."""
    first = np.array([0, 0, 7, 7 + D.WIDTH, 200])
    doc, start, end = D.passages(first, D.STEP)
    assert set(np.concatenate([np.arange(a, b) for a, b in zip(start, end, strict=True)])) == set(range(200))
    assert all(first[d] <= a < b <= first[d + 1] and b - a <= D.WIDTH for d, a, b in zip(doc, start, end, strict=True))


def corpus(seed=4):
    """Forty items; texts of the same words with a verbatim, reordered or partly reworded item, or none."""
    r = random.Random(seed)
    common = [f"c{k}" for k in range(30)]
    rare = [f"r{k}" for k in range(3000)]
    word = lambda: r.choice(common) if r.random() < 0.45 else r.choice(rare)
    items = [(k, " ".join(word() for _ in range(r.randint(15, 50))).capitalize() + ". " + " ".join(word() for _ in range(6)) + ".") for k in range(40)]
    texts, want = [], set()
    for k in range(240):
        body = [word() for _ in range(r.randint(5, 300))]
        if k % 3 == 0:
            i = r.randrange(40)
            part = items[i][1].split()
            if k % 2:
                for _ in range(len(part) // 8):
                    part[r.randrange(len(part))] = word()
                part = " ".join(part).upper().replace(" ", "\n", 3).split(" ")
            at = r.randrange(len(body))
            body[at:at] = part
            want.add((k, i))
        texts.append(" ".join(body))
    return items, texts, want


def test_planted_leaks(spark, docs):
    items, texts, want = corpus()
    out = D.find_leaks(docs(texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(r.doc_id, x.item_id) for r in out for x in r.leaks}
    assert len(got & want) >= 0.95 * len(want) and got <= want
    # by brute force over all items, the documents found and no others hold the item's words in order
    tokens = {i: D._tokens(t) for i, t in items}
    for r in out:
        w = D._tokens(r.text)
        for i, item in tokens.items():
            whole = max((brute_lcs(item, w[a:a + len(item)]) for a in range(0, max(1, len(w) - len(item) + 1), 3)), default=0)
            assert whole < 0.6 * len(item) or (r.doc_id, i) in want


def test_given_documents(spark, documents):
    """Every item that a text holds verbatim is found."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows, known = documents.collect(), items.collect()
    want = {(r.doc_id, i.item_id) for r in rows for i in known if i.text in (r.text or "")}
    out = D.op3_benchmark_decontamination(spark, "/root/testdata/sf0.001").collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert want <= got and len(got) <= len(want) + 2


def test_blocks_and_cases(spark, docs, monkeypatch):
    """Items in several blocks; nulls, empty and long texts, repeated rows, repeated ids, empty tables."""
    monkeypatch.setattr(D, "BLOCK", 2)
    items = [(k, f"alpha{k} beta{k} gamma{k} delta{k} eps{k} zeta{k} eta{k}. The answer{k} is here{k}.") for k in range(5)]
    table = spark.createDataFrame([*items, (5, None), (6, " "), (None, "x"), (0, items[0][1])], "item_id bigint, text string")
    texts = [None, "", items[3][1], items[3][1], "pad " * 50_000 + items[4][1], "nothing of it"]
    out = D.find_leaks(docs(texts, ids=[1, 2, 3, 3, None, 5]).withColumnRenamed("n_chars", "leaks"), table).collect()
    found = sorted((str(r.doc_id), sorted({x.item_id for x in r.leaks})) for r in out)
    assert found == [("1", []), ("2", []), ("3", [3]), ("3", [3]), ("5", []), ("None", [4])]
    assert D.find_leaks(docs([]), table).collect() == []
    assert [r.leaks for r in D.find_leaks(docs(["a"]), table.where("false")).collect()] == [[]]


def test_long_items_keep_their_passages(spark, docs, monkeypatch):
    """Verbatim copies of items with far more passages than the rank are all found."""
    monkeypatch.setattr(D, "RANK", 48)
    r = random.Random(9)
    items = [(k, " ".join(f"w{r.randrange(4_000)}" for _ in range(200))) for k in range(12)]
    texts = [f"{'foreign words ' * 20}{t}" for _, t in items]
    out = D.find_leaks(docs(texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, x.item_id) for r in out for x in r.leaks} == {(k, k) for k in range(12)}
    assert all(x.similarity >= D.KEPT - 0.01 for r in out for x in r.leaks)


def test_blocks_and_directions():
    """256 items of 200 words lie in blocks of no more passages than the rank; every passage keeps its norm in any basis."""
    items = [(k, " ".join(f"w{k}x{j}" for j in range(200))) for k in range(256)]
    parts = list(D.blocks(iter([*items, (256, " "), (257, "v " * 9_000)])))
    assert [i for p in parts for i, _ in p] == [*range(256), 257] and len(parts[-1]) == 1
    assert all(sum(len(D.passages(np.array([0, 200]), D.ITEM_STEP)[0]) for _ in p) <= D.RANK for p in parts[:-1])
    rng = np.random.default_rng(3)
    own = rng.normal(size=(60, 500))
    own = np.vstack([own, own[:5]]) / np.linalg.norm(np.vstack([own, own[:5]]), axis=1, keepdims=True)
    basis = D.whole_passages(np.linalg.qr(rng.normal(size=(500, 10)))[0], own)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1])) and (np.linalg.norm(own @ basis, axis=1) >= D.KEPT).all()


def test_short_items_in_running_text(spark, docs):
    """Verbatim items of 1 to 19 words between rare words and between repeated ones; a document shorter than the item."""
    r = random.Random(5)
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in range(1, D.WIDTH)]
    texts = [" ".join([*(f"rare{n}y{j}" for j in range(41)), t, *(f"rare{n}z{j}" for j in range(33))]) for n, t in items]
    texts += [" ".join(["same"] * 41 + [t] + ["same"] * 33) for _, t in items]
    texts += [" ".join(t.split()[1:]) for n, t in items if n > 9]
    texts += [" ".join(t for _, t in items) for _ in range(8)]  # their words are common
    r.shuffle(texts)
    out = D.find_leaks(docs(texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {(k, n) for k, t in enumerate(texts) for n, i in items if set(i.split()[1:] or i.split()) <= set(t.split())}
    assert {(x.doc_id, y.item_id) for x in out for y in x.leaks} == want


def test_filter_lets_every_candidate_pass():
    """By brute force over all windows with each word once; many words repeat."""
    rng = np.random.default_rng(6)
    h = rng.integers(0, 12, 300).astype(np.uint64) << np.uint64(48)
    idf = rng.uniform(0.1, 3, D.TERMS)
    first, vocabulary = np.array([0, 0, 4, 11, 160, 300]), np.arange(5).astype(np.uint64) << np.uint64(48)
    weight, place = idf[D._term(h)] ** 2, D.find(vocabulary, h)
    known = np.concatenate([[0], np.cumsum(np.where(place >= 0, weight, 0))])
    norm = np.concatenate([[0], np.cumsum(np.where(D.repeated(h), 0, weight))]) * (1 - 1e-9)
    for width, step in ((D.WIDTH, D.STEP), (7, 1), (1, 1)):
        live = {(int(a), int(b)) for _, a, b in zip(*D.live_windows(first, step, width, known, norm), strict=True)}
        for _, a, b in zip(*D.passages(first, step, width), strict=True):
            once = np.unique(h[a:b])
            square = idf[D._term(once)] ** 2
            if square[np.isin(once, vocabulary)].sum() >= D.COSINE ** 2 * square.sum():
                assert (int(a), int(b)) in live


def test_any_column_names(spark):
    from vellum.llm.decontaminate import find_leaks

    item = "what is the name of the old stone bridge that crosses the river near the northern gate of town answer karlow"
    rows = [(1, f"some words before {item} some words after", 1, "a", "b", "c"), (2, "nothing of the kind", 2, "a", "b", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _before int, before string, whole string, _text string")
    out = find_leaks(df, spark.createDataFrame([(5, item)], "item_id bigint, text string"))
    assert out.columns == [*df.columns, "leaks"]
    got = {r.doc_id: r for r in out.collect()}
    assert tuple(got[1])[:6] == rows[0] and [x.item_id for x in got[1].leaks] == [5] and got[2].leaks == []


def test_every_corpus_passage_shapes_the_latent_space(spark, docs, monkeypatch):
    """A'A of the whole corpus by brute force, for two vocabularies in one pass, with repeated words and copies."""
    monkeypatch.setattr(D, "PAIRED", 5)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 25, size=n)) for n in rng.integers(0, 90, size=3000)] + ["w1 w2 w1 foreign"] * 4
    items = [[(0, "w1 w2 w3 w4 w7 w20 absent")], [(1, "w2 w9 w24")]]
    frame = docs(texts).select("text")
    idf, _ = D.inverse_frequencies(frame)
    vocabularies = [D.vocabulary_of(i) for i in items]
    grams, n = D.corpus_grams(frame.repartition(5), vocabularies, idf)
    w = D.words(D.pa.array(texts), plain=True)
    _, start, end = D.passages(w.first, D.WIDTH)
    assert n == len(start)
    for vocabulary, got in zip(vocabularies, grams, strict=True):
        a = np.zeros((n, len(vocabulary)))
        for k, (x, y) in enumerate(zip(start, end, strict=True)):
            weight = idf[D._term(w.hash[x:y])]
            for place, v in zip(D.find(vocabulary, w.hash[x:y]), weight / np.linalg.norm(weight), strict=True):
                if place >= 0:
                    a[k, place] += v
        assert np.allclose(got, a.T @ a)


def test_passes_are_bounded(monkeypatch):
    monkeypatch.setattr(D, "ENTRIES", 50)
    parts = [[(k, " ".join(f"w{j}" for j in range(n)))] for k, n in enumerate([5, 4, 5, 20, 3])]
    assert [[i for own in g for i, _ in own] for g in D.passes(iter(parts))] == [[0, 1], [2], [3], [4]]


def test_only_windows_near_the_threshold_are_projected():
    """Few windows are projected into the latent space, and by brute force every one that reaches COSINE is among the candidates."""
    items, texts, _ = corpus()
    w = D.words(D.pa.array(texts), plain=True)
    idf = np.random.default_rng(3).uniform(0.5, 3, D.TERMS)
    vocabulary = D.vocabulary_of(items)
    space = D.latent_space(np.zeros((len(vocabulary), len(vocabulary))), 0, items, idf)
    projected = []

    class Basis(np.ndarray):
        def __getitem__(self, key):
            projected.append(len(key))
            return np.asarray(self)[key]

    plain = space.basis
    space.parts  # the words' shares
    space.basis = plain.view(Basis)
    got = {(int(a), int(b)) for _, start, end, _, _ in D.candidate_windows(w, space) for a, b in zip(start, end, strict=True)}
    _, start, end = D.passages(w.first, D.STEP)
    want = set()
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        h = np.unique(w.hash[a:b])
        x, place = idf[D._term(h)], D.find(vocabulary, h)
        cosine = (plain[place[place >= 0]] * x[place >= 0, None]).sum(0) @ space.vectors[space.size >= D.WIDTH].T / np.linalg.norm(x)
        if cosine.max() >= D.COSINE:
            want.add((a, b))
    assert len(want) > 50 and {x for x in got if x in set(zip(start.tolist(), end.tolist(), strict=True))} >= want
    assert sum(projected) < 2 * sum(b - a for a, b in got)


def test_find_with_shared_first_bits():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 40, 500).astype(np.uint64) | (rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(48)) | np.uint64(0xFFFF << 48) * (rng.random(500) < 0.1)
    vocabulary = np.unique(h[:60])
    place = D.find(vocabulary, h)
    assert all((vocabulary[p] == x) if p >= 0 else x not in vocabulary for p, x in zip(place, h, strict=True))
    assert (D.find(np.zeros(0, np.uint64), h) == -1).all()
