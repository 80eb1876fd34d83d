import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vellum.llm import packing as P
from vellum.llm.common import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
SLOW = Tokenizer.from_file(PATH)
ids_of = lambda t: SLOW.encode(t or "", add_special_tokens=False).ids + [0]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "'ll", "é", "12", "a", "　", "<|"]), max_size=12).map("".join))
def test_encoder_gives_the_ids_of_the_file(text):
    assert P.encoder(PATH).fast is not None
    assert P.encoder(PATH)([text])[0].tolist() == SLOW.encode(text, add_special_tokens=False).ids


def check(pieces, rows, width=1024):
    """Every id of every document in exactly one piece, gapless sequences, right figures."""
    want = sorted(ids_of(t) for _, t in rows)
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        by_seq[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= width
    unique = {d: t for d, t in rows if [x for x, _ in rows].count(d) == 1} if len(rows) < 5000 else dict(rows)
    for d, t in unique.items():
        got, at = [], 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids_of(t))
            got += np.frombuffer(p.ids, "<u4").tolist()
            at += p.length
        assert got == ids_of(t)
    assert sum(p.length for p in pieces) == sum(map(len, want))
    return by_seq


def test_given_documents(spark, documents):
    pieces = P.pack_documents(documents, PATH, shard_docs=50).collect()
    seqs = check(pieces, [(r.doc_id, r.text) for r in documents.collect()])
    short = sum(sum(p.length for p in s) < 1024 for s in seqs.values())
    assert short <= len({s >> 32 for s in seqs})  # one padded sequence a shard
    q = P.op1_packing(spark, "/root/testdata/sf0.001").collect()
    assert {(p.doc_id, p.ids_crc32) for p in q} == {(p.doc_id, zlib.crc32(p.ids)) for p in P.pack_documents(documents, PATH).collect()}


def test_cases(docs):
    """Nulls, empty and long texts, repeated rows, null ids, an empty table."""
    texts = [None, "", "one two", "one two", "word " * 100_000, "x" * 50_000, "tail <|endoftext|> end"]
    ids = [1, 2, 3, 3, 4, None, 6]
    check(P.pack_documents(docs(texts, ids), PATH).collect(), list(zip(ids, texts, strict=True)))
    assert P.pack_documents(docs([]), PATH).collect() == []


def index_of(texts, member=None):
    doc, word, times, total = P.term_counts(pa.array(texts))
    corpus = P.Corpus(len(texts), total.mean(), *np.unique(word, return_counts=True))
    return P.Retrieval(doc, word, times, total, np.arange(len(texts)) if member is None else np.array(member), corpus)


def bm25(texts, seed):
    """Of every text for the seed's words, from the definition."""
    bags = [Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t in texts]
    n, df = len(texts), Counter(w for bag in bags for w in bag)
    size = [sum(bag.values()) for bag in bags]
    mean = max(sum(size) / n, 1.0)
    return [sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * s / mean))
                for w in bags[seed] if w in bag) for bag, s in zip(bags, size, strict=True)]


def test_scores_against_the_definition():
    texts = ["red fox runs", "red RED hen", "blue fox", "", "green grass grows"]
    found = index_of(texts)
    for seed in range(5):
        others = [k for k in range(5) if k != seed]
        assert np.allclose(found.scores(seed)[others], np.array(bm25(texts, seed))[others])


def test_equal_texts_are_indexed_once():
    texts, member = ["sea wind", "sea salt", "sky"], [0, 0, 1, 2, 0]
    s = index_of(texts, member=member).scores(1)
    assert s[0] == s[1] == s[4] > s[2] > s[3] == 0


def recall(texts, shard, ids, seeds):
    """Share of the ten best by brute force over all rows that the seeds' own shards hold among their ten best."""
    at, hits = {d: k for k, d in enumerate(ids)}, []
    doc, word, times, total = P.term_counts(pa.array(texts))
    word, n = np.unique(word, return_counts=True)
    top = np.argsort(-n, kind="stable")[:P.FREQUENT]
    corpus = P.Corpus(len(texts), total.mean(), word[top], n[top])
    for number in sorted(set(shard.values())):
        own = [d for d in ids if shard[d] == number]
        doc, word, times, total = P.term_counts(pa.array([texts[at[d]] for d in own]))
        found = P.Retrieval(doc, word, times, total, np.arange(len(own)), corpus)
        for k in (k for k, d in enumerate(own) if d in seeds):
            truth, got = np.array(bm25_all(texts, at[own[k]])), found.scores(k)
            truth[at[own[k]]] = got[k] = -1
            best = np.sort(truth)[-10]
            hits.append(min(10, sum(truth[at[own[j]]] >= best - 1e-9 for j in np.argsort(-got, kind="stable")[:10])) / 10)
    return float(np.mean(hits))


_bags: dict[int, tuple] = {}


def bm25_all(texts, seed):
    """``bm25`` over many texts, with the postings of words kept."""
    if id(texts) not in _bags:
        postings, size = defaultdict(list), []
        for k, t in enumerate(texts):
            bag = Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
            size.append(sum(bag.values()))
            for w, c in bag.items():
                postings[w].append((k, c))
        _bags[id(texts)] = postings, size, sum(size) / len(size)
    postings, size, mean = _bags[id(texts)]
    out, n = [0.0] * len(texts), len(texts)
    for w in set(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[seed]))):
        f = len(postings[w])
        idf = math.log1p((n - f + 0.5) / (f + 0.5))
        for k, c in postings[w]:
            out[k] += idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * size[k] / mean))
    return out


def test_recall_against_brute_force_over_all_rows(spark):
    """sf0.1, every document in production shards: the seeds are the ids divisible by 100."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS text")
    scratch = Scratch(spark, "test")
    for shard_docs, least in ((P.SHARD_DOCS, 0.9), (2500, 0.4)):  # a deal by hash into four would find a quarter
        dealt, corpus = P.deal(rows, scratch, shard_docs)
        got = dealt.collect()
        texts, ids = [r.text for r in got], [r.doc_id for r in got]
        assert len(got) == corpus.n == 10_000 and len({r.shard for r in got}) == -(-10_000 // shard_docs)
        found = recall(texts, {r.doc_id: r.shard for r in got}, ids, {d for d in ids if d % 100 == 0})
        print("recall", shard_docs, found)
        assert found >= least


def test_deal_splits_repeated_rows(spark, docs):
    """A third of the rows are one row: their shards stay even, and the copies lie together."""
    texts = ["the same words again"] * 600 + [f"w{k} x{k % 7} y{k % 11}" for k in range(1200)]
    dealt, _ = P.deal(docs(texts, [7] * 600 + list(range(100, 1300))).select("doc_id", "text"), Scratch(spark, "test"), 100)
    sizes = Counter(r.shard for r in dealt.collect())
    same = Counter(r.shard for r in dealt.where("doc_id = 7").collect())
    assert max(sizes.values()) < 200 and 5 <= len(same) <= 8


def test_neighbours_share_a_window():
    """Remainders about the same thing meet; all ids are taken once and only the last window is short."""
    texts = [f"{topic} {topic}a {topic}b {topic}{k} " * 5 for topic in ("sea", "sky", "sun") for k in range(4)]
    windows = P.fill(np.full(12, 256), index_of(texts), 1024)
    assert [sorted({d // 4 for d, _ in w}) for w in windows] == [[0], [1], [2]]
    rng = np.random.default_rng(2)
    for left in (rng.integers(0, 1024, 12), rng.integers(0, 9, 12)):
        windows = P.fill(left, index_of(texts), 1024)
        taken = np.zeros(12, int)
        for w in windows:
            for d, n in w:
                taken[d] += n
        assert (taken == left).all() and all(sum(n for _, n in w) == 1024 for w in windows[:-1])


def test_tree_sees_every_document(spark, docs):
    """Weights, axes and cuts against plain numpy over all rows, of which a draw of a few thousand would miss some."""
    texts = [f"{'red' if k % 3 else 'blue'} w{k % 50} x{k % 7} " + "y " * (k % 5) for k in range(300)]
    counts = P.term_counts(pa.array(texts))
    terms = P.packed_terms(counts).to_pylist()
    assert [len(t) // 4 for t in terms] == [len(set(t.split())) for t in texts]
    weight = np.random.default_rng(1).random(P.TERMS)
    tree = P.fit_tree(spark.createDataFrame([(t,) for t in terms], "terms binary").repartition(3), weight, 2, Scratch(spark, "test"))
    x = P.sketch(terms, weight)
    y = np.rint(x @ tree.axes)
    assert np.abs(np.cov(x.T, bias=True) @ tree.axes[:, 0] - np.linalg.eigvalsh(np.cov(x.T, bias=True))[-1] * tree.axes[:, 0]).max() < 1e-3
    assert np.isclose(tree.cut[0], y.mean(0) @ tree.way[0])
    leaf = (y @ tree.way[0] > tree.cut[0]).astype(int)
    for k in (0, 1):
        own = y[leaf == k]
        assert np.isclose(tree.cut[1 + k], own.mean(0) @ tree.way[1 + k])
        assert np.isclose(np.var(own @ tree.way[1 + k]), np.linalg.eigvalsh(np.cov(own.T, bias=True))[-1])


def test_every_row_moves_the_deal(spark, docs, monkeypatch):
    """The tree's sums hold each of 20,000 rows, more than the sample of before had."""
    seen = []
    grow = P.Tree.grow
    monkeypatch.setattr(P.Tree, "grow", lambda self, m: (seen.append(int(m.value[m.cell == 0].sum())), grow(self, m))[1])
    rows = spark.range(20_000).selectExpr("id AS doc_id", "concat('a', id % 9, ' b', id % 31, ' c', id) AS text")
    P.deal(rows, Scratch(spark, "test"), 10_000)
    assert seen == [20_000] * 3


def test_words_of_many_documents_score_by_the_matrix(monkeypatch):
    texts = [f"the {'sea' if k % 2 else 'sky'} w{k % 3} THE" for k in range(40)]
    plain = index_of(texts)
    monkeypatch.setattr(P, "OFTEN", 4)
    found = index_of(texts)
    assert plain.matrix.shape[1] == 0 < found.matrix.shape[1]
    for seed in range(40):
        others = np.arange(40) != seed
        assert np.allclose(found.scores(seed)[others], plain.scores(seed)[others])
        assert np.allclose(found.scores(seed)[others], np.array(bm25(texts, seed))[others])
    left = np.arange(40) % 2 == 0
    found.forget(left)
    found.ask(np.array([0, 6]))
    assert np.allclose(found.scores(6)[left], plain.scores(6)[left])


def test_a_shard_keeps_its_terms_narrow_and_lets_them_go():
    shard = P._Shard(0, 1024)
    assert list(shard.add([1, 2], pa.array(["sea wind", "sea salt sea"]), P.encoder(PATH))) == []
    assert [x.dtype for x in shard.terms[0]] == [np.int32, np.uint64, np.int32]
    pieces = list(shard.finish(P.Corpus(2, 2.5, np.zeros(0, np.uint64), np.zeros(0))))
    assert sorted(p[0] for p in pieces) == [1, 2] and shard.terms == []


def test_ids_of_odd_white_space_and_marks():
    """The pattern without backtracking cuts as the file's own library does."""
    import random

    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    bits = [" ", "  ", "\n", "\r\n", "\t", "\x0b", " ", " ", "　", "'s", "'S", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "a", "Zz", "é", "日本",
            "7", "٣", "½", "_", "-", "...", "\U0001f600", "é", "\x00", "\x85"]
    texts = ["", *bits, *("".join(r.choices(bits, k=r.randint(1, 30))) for _ in range(3000))]
    own = P.Encoder(path)
    assert own.fast is not None
    for text, found, want in zip(texts, own(texts), Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), strict=True):
        assert found.tolist() == want.ids, text


def test_white_space_is_looked_ahead_for_only_in_runs():
    """Texts without two white-space characters in a row take the faster pattern as they are, others between their runs; same ids."""
    texts = ["one two\tthree\n", " a\u3000b c's ", "x\u2009\u2009y", "a \n\n b", "a  ", "  ", "\u00a0 z", "caf\u00e9 \u201cq\u201d", "", "t <|endoftext|>  u"]
    flags = P.runs_of_space(texts).tolist()
    assert flags == [False, True, True, True, True, True, True, True, False, True]
    own = P.Encoder(PATH)
    for text, found in zip(texts, own(texts), strict=True):
        assert found.tolist() == SLOW.encode(text, add_special_tokens=False).ids == own.one(text).tolist(), text
    own.fast = None  # only runs and special tokens go there
    assert own.single.decode(own.one(texts[0], False).tolist()) == texts[0]


def test_counts_of_words_are_summed_by_ranges_of_their_hash(spark, docs):
    """The corpus' frequencies against plain Python, over texts in several tasks; words of one document are left out."""
    texts = [f"w{k % 9} w{k % 9} v{k % 50} only{k} ALL" for k in range(400)]
    frame = docs(texts).select("doc_id", "text").repartition(5)
    _, corpus = P.deal(frame, Scratch(spark, "test"), 10_000)
    want = Counter(w for t in texts for w in set(t.lower().split()))
    hashes = {w: int(P.words(pa.array([w])).hash[0]) for w in want}
    assert dict(zip(corpus.word.tolist(), corpus.frequency.tolist(), strict=True)) == {hashes[w]: n for w, n in want.items() if n > 1}
    word = np.random.default_rng(2).integers(-2**63, 2**63 - 1, 3000)
    own = np.sort(word.view(np.uint64)).view(np.int64)
    table = np.empty(3000, P._COUNTED)
    table["word"], table["n"] = own, 1
    out = pa.Table.from_batches(P._dealt(16, iter([pa.RecordBatch.from_arrays([pa.array([table.tobytes()])], names=["words"])]))).to_pylist()
    assert [r["part"] for r in out] == list(range(16)) and b"".join(r["words"] for r in out) == table.tobytes()
    for r in out:
        assert {int(x) >> 60 for x in np.frombuffer(r["words"], P._COUNTED)["word"].view(np.uint64)} == {r["part"]}
