import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from leadcurve.llm import attention as A
from leadcurve.llm import lm_scoring
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, docs, written

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def brute(rows):
    """(doc_id, held out, tokens, known, training tokens, base score) by the formula."""
    low = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    end = object()
    counts = Counter(w for d, t in rows if not held(d) for w in [*low(t), end])
    n, v = counts.total(), len(counts)
    for d, t in rows:
        own = [*low(t), end]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        yield str(d), held(d), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)


def base_of(out):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)


EDGES = [(1, None), (2, ""), (3, " \n"), (None, "alpha beta"), (None, "alpha beta"), (4, "ALPHA Äb beta"), (5, "x\xa0y\x85z 　w"), (5, "other"), (6, "long " * 3000), (7, "\x1cq '' don't 's")]


@pytest.mark.parametrize(("rows", "frequent"), [(EDGES, 2), ([(i, f"word{i} the {'of ' * (i % 4)}") for i in range(60)], 3), ([], 5)])
def test_base_scores(spark, rows, frequent):
    out = lm_scoring.scored(docs(spark, rows), FILE, PATTERN, frequent).collect()
    assert base_of(out) == sorted(brute(rows))
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_driver_table_and_held_out_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = QUERIES["op4_attention_lm"](spark, SF).collect()
    assert base_of(out) == sorted(brute(rows))
    held = sum(r.score for r in out if r.held_out)
    start = lm_scoring.scored(spark.read.parquet(f"{SF}/documents.parquet"), FILE, PATTERN, rounds=0).collect()
    assert held > sum(r.score for r in start if r.held_out)  # what is learned predicts unseen texts better


def subwords(n=40, seed=0):
    rng = np.random.default_rng(seed)
    return A.subword_classes(rng.integers(0, 50, n + 1).astype(float), rng.random(n + 1) < 0.5, classes=8)


def test_classes_share_all_probability():
    own = subwords()
    for c in range(own.klass.max() + 1):
        assert abs((10 ** own.share[own.klass == c]).sum() - 1) < 1e-9
    assert (own.klass == own.klass[-1]).sum() == 1 and own.klass.max() + 1 <= 8
    assert abs(own.class_share.sum() - 1) < 1e-9


def plain(w, own, ids):
    """The model written place by place, window by window."""
    before, out, at, step = [own.end, *ids[:-1]], [0.0] * len(ids), 0, A.WINDOW - A.OVERLAP
    done = 0
    while done < len(ids):
        part = before[at : at + A.WINDOW]
        x = [w["input"][own.input[t]] + w["place"][i] for i, t in enumerate(part)]
        qkv = [v @ w["qkv"] for v in x]
        d = A.WIDTH
        for i in range(len(part)):
            if at + i < done:
                continue
            s = np.array([qkv[i][:d] @ qkv[j][d : 2 * d] for j in range(i + 1)]) / math.sqrt(d)
            a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            h = x[i] + sum(a[j] * qkv[j][2 * d :] for j in range(i + 1)) @ w["out"]
            z = h @ w["classes"] + w["bias"]
            p = z[own.klass[ids[at + i]]] - z.max() - math.log(np.exp(z - z.max()).sum())
            out[at + i] = p / math.log(10) + own.share[ids[at + i]]
        done = min(at + A.WINDOW, len(ids))
        at += step
    return out


def test_windows_score_every_subword_once_like_the_plain_model():
    own, rng = subwords(), np.random.default_rng(2)
    w = A.first_weights(own)
    lists = [np.append(rng.integers(0, 40, n), own.end) for n in (0, 1, 14, 15, 16, 27, 28, 29, 100)]
    first = np.append(0, np.cumsum([len(x) for x in lists]))
    ids = np.concatenate(lists)
    text = A.windows(own, ids, first)
    assert sorted(text.at[text.used]) == list(range(len(ids)))
    got = A.scores(w, own, text, batch=3)
    want = [y for x in lists for y in plain(w, own, x.tolist())]
    assert np.allclose(got, want, atol=1e-4)


def test_gradients_equal_differences():
    own, rng = subwords(), np.random.default_rng(3)
    w = {k: (v + 0.3 * rng.normal(size=v.shape)).astype(np.float64) for k, v in A.first_weights(own).items()}
    ids = np.append(rng.integers(0, 40, 37), own.end)
    text = A.windows(own, ids, np.array([0, 20, 38]))
    target, index = own.klass[ids[text.at]], text.input[text.at]

    def loss(w):
        h = A._forward(w, index)["h"][text.valid]
        return -A._class_scores(w, h)[np.arange(len(h)), target[text.valid]].mean()

    grads = A.gradients(w, index, target, text.valid)
    for k, v in w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if k == "input" and rng.random() < 0.7:
                at = (index[0, 0], at[1])
            up, down = {**w, k: v.copy()}, {**w, k: v.copy()}
            up[k][at] += 1e-4
            down[k][at] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - grads[k][at]) < 1e-4, k


def test_learning_finds_a_pattern():
    counts = np.full(9, 100.0)
    own = A.subword_classes(counts, np.arange(9) < 4, classes=9)
    ids = np.concatenate([np.append(np.tile([0, 5, 3, 7], 50), 8)] * 20)
    text = A.windows(own, ids, np.arange(0, len(ids) + 1, 201))
    learner = A.Learner(A.first_weights(own), own, 0.02)
    before = A.scores(learner.w, own, text).mean()
    for _ in range(20):
        learner.learn(text)
    assert A.scores(learner.w, own, text).mean() > before / 4


def test_subwords_of_words(spark):
    with open(FILE, "rb") as f:
        own = lm_scoring.Tokenizer(f.read(), PATTERN)
    for words in (["the", "don't", "'s", "日本語", "a1b2"], ["x\xa0y", "　", "plain"], []):
        ids, first = own([w.encode() for w in words])
        got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        assert got == [own.encoding.encode_ordinary(" " + w) for w in words]


def test_clashing_columns(spark, tmp_path):
    df = docs(spark, [(1, "a b"), (2, "c")]).withColumnRenamed("lang", "held_out").withColumnRenamed("source", "word")
    assert QUERIES["op4_attention_lm"](spark, written(df, tmp_path)).count() == 2


def test_blocks_are_parts_of_a_text_and_every_round_differs():
    text = " ".join(f"w{i}" for i in range(5000))
    found = [x for turn in range(lm_scoring.ROUNDS) for doc in range(40) for x in lm_scoring._blocks(text, doc, turn)]
    words = {w for own, _ in found for w in own}
    assert words == {w.encode() for w in text.split()}  # over many documents, every part is used
    one = [tuple(own) for turn in range(lm_scoring.ROUNDS) for own, _ in lm_scoring._blocks(text, 3, turn)]
    assert len(one) == len(set(one)) and sum(map(len, one)) < 5000 / lm_scoring.SHARE * 2
    assert [x for t in range(lm_scoring.ROUNDS) for x in lm_scoring._blocks(None, 0, t)] in ([], [([], True)])


@pytest.mark.parametrize("length", [0, 1, 40, 599, 600, 601, 2000])
def test_every_block_of_every_document_is_learned_from_once(length):
    text = " ".join(f"w{i}" for i in range(length))[:length]
    for doc in range(40):
        found = [x for turn in range(lm_scoring.ROUNDS) for x in lm_scoring._blocks(text, doc, turn)]
        assert Counter(w for own, _ in found for w in own) == Counter(text.encode().split())
        assert sum(last for _, last in found) == 1


def test_windows_without_overlap_hold_every_subword_once():
    ids = np.append(np.arange(39) % 40, 40)
    text = A.windows(subwords(), ids, np.array([0, 17, 40]), overlap=0)
    assert sorted(text.at[text.valid]) == list(range(40)) and (text.valid == text.used).all()


def test_products_take_one_thread():
    from leadcurve.llm.blas import single_thread

    assert single_thread()  # the library that numpy brings here is known
    a = np.random.default_rng(1).normal(size=(300, 40))
    assert np.allclose(a.T @ a, np.einsum("ij,ik->jk", a, a))


def test_texts_are_turned_into_subwords_once(spark, monkeypatch):
    """Both rounds and the scores read stored subwords: after the texts were read, no task needs a tokenizer."""
    from leadcurve.llm import frames

    names = []
    monkeypatch.setattr(lm_scoring, "staged", lambda df, name: names.append(name) or frames.staged(df, name))
    rows = [(i, f"word{i} the {'of ' * 300}") for i in range(20)]
    out = lm_scoring.scored(docs(spark, rows), FILE, PATTERN, 2).collect()
    assert names == ["word-counts", "subwords", "scored"] and base_of(out) == sorted(brute(rows))


def test_stored_subwords_hold_every_block(spark):
    with open(FILE, "rb") as f:
        own = lm_scoring.Tokenizer(f.read(), PATTERN)
    texts = [None, "", "Alpha beta", " ".join(f"w{i}" for i in range(900)), "x" * 1500 + " y z " + "日本 " * 700]
    classes = A.subword_classes(np.ones(own.size + 1), own.opens())
    batch = pa.RecordBatch.from_arrays(
        [pa.array([None, 1, 2, 3, 4], pa.int64()), pa.array([False] * 5), pa.array(texts, pa.string())], ["doc_id", "held_out", "text"]
    )
    rows = [r for b in lm_scoring._Reader(own, {}, 1.0, 1, classes)([batch]) for r in b.to_pylist() if r["word"] is None]
    for r, text in zip(rows, texts, strict=True):
        ids = np.frombuffer(r["ids"], lm_scoring._id_type(classes))
        cuts = np.append(np.frombuffer(r["cuts"], lm_scoring._CUT), len(ids))
        for turn in range(lm_scoring.ROUNDS):
            mine = np.flatnonzero(lm_scoring._turns(r["doc_id"], len(cuts) - 1) == turn)
            want = [own(words)[0].tolist() + [classes.end] * last for words, last in lm_scoring._blocks(text, r["doc_id"], turn)]
            assert [ids[cuts[b] : cuts[b + 1]].tolist() for b in mine] == want


def test_products_in_slices_are_those_of_whole_matrices():
    rng = np.random.default_rng(5)
    for rows in (1, A.SLICE - 1, A.SLICE, 2 * A.SLICE + 3):
        x, y, m = rng.normal(size=(rows, 16)), rng.normal(size=(rows, 48)), rng.normal(size=(16, 48))
        assert np.allclose(A._product(x, m), x @ m) and np.allclose(A._summed_product(x, y), x.T @ y)
        assert np.allclose(A._row_sums(y, 3), y.sum(axis=1, keepdims=True))
        assert [len(part) for part in A._parts(x)] == [rows // A.SLICE, 1]


def test_a_place_takes_two_products_before_its_classes(monkeypatch):
    """Query and key are one map, value and out another."""
    own, made, product = subwords(), [], A._product
    monkeypatch.setattr(A, "_product", lambda y, by: made.append(by.shape) or product(y, by))
    A._forward(A.first_weights(own), np.zeros((3, A.WINDOW), np.int64))
    assert len(made) == 3  # the third adds up rows


@pytest.mark.parametrize("size", [1, 40, 400])
def test_powers_out_of_range_change_no_result(size):
    """Large weights lead out of single precision; scores and gradients stay those of double precision."""
    own, rng = subwords(), np.random.default_rng(6)
    w = {k: v.astype(np.float64) for k, v in A.first_weights(own).items()}
    w["classes"], w["qkv"], w["bias"] = w["classes"] * size, w["qkv"] * min(size, 20), w["bias"] + 100
    single = {k: v.astype(np.float32) for k, v in w.items()}
    ids = np.append(rng.integers(0, 40, 61), own.end)
    text = A.windows(own, ids, np.array([0, 30, 62]))
    got, want = A.scores(single, own, text), np.array(plain(w, own, ids[:30].tolist()) + plain(w, own, ids[30:].tolist()))
    seen = want > -30  # single precision ends there
    assert np.isfinite(got).all() and (got[~seen] < -29).all() and np.allclose(got[seen], want[seen], rtol=2e-3, atol=2e-3)
    index, target = text.input[text.at], own.klass[ids[text.at]]
    for k, v in A.gradients(w, index, target, text.valid).items():
        assert np.allclose(A.gradients(single, index, target, text.valid)[k], v, rtol=2e-2, atol=2e-3 * max(1, abs(v).max())), k


def test_gradients_in_parts_are_those_of_the_whole(monkeypatch):
    own, rng = subwords(), np.random.default_rng(7)
    w = {k: v.astype(np.float64) for k, v in A.first_weights(own).items()}
    ids = np.append(rng.integers(0, 40, 700), own.end)
    text = A.windows(own, ids, np.array([0, 300, 701]), overlap=0)
    index, target = text.input[text.at], own.klass[ids[text.at]]
    whole = A.gradients(w, index, target, text.valid)
    monkeypatch.setattr(A, "PART", 7)
    assert all(np.allclose(v, whole[k]) for k, v in A.gradients(w, index, target, text.valid).items())


def test_only_input_vectors_that_are_read_move():
    own = subwords()
    learner, before = A.Learner(A.first_weights(own), own, 0.02), A.first_weights(own)
    ids = np.array([3, 5, 3, 5, own.end])
    learner.learn(A.windows(own, ids, np.array([0, 5]), overlap=0))
    read = {own.input[i] for i in (own.end, 3, 5)}
    assert set(np.flatnonzero((learner.w["input"] != before["input"]).any(axis=1))) == read


def test_tasks_tokenize_rare_words_alone(monkeypatch):
    """Frequent words come with their subwords, also after rare ones were forgotten."""
    with open(FILE, "rb") as f:
        own = lm_scoring.Tokenizer(f.read(), PATTERN)
    frequent = lm_scoring.frequent_subwords({b"the": 7, b"alpha": 3}, own)
    asked, call = [], lm_scoring.Tokenizer.__call__
    monkeypatch.setattr(lm_scoring.Tokenizer, "__call__", lambda self, words: asked.extend(words) or call(self, words))
    monkeypatch.setattr(lm_scoring, "REMEMBERED", 2)
    classes = A.subword_classes(np.ones(own.size + 1), own.opens())
    reader = lm_scoring._Reader(own, frequent, 1.0, 1, classes)
    for text in ("the Alpha x1 the", "alpha x1 x2 x3 the", "the x1 alpha"):
        batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([False]), pa.array([text])], ["doc_id", "held_out", "text"])
        row, *rare = [r for b in reader([batch]) for r in b.to_pylist()]
        words = text.lower().split()
        assert np.frombuffer(row["ids"], lm_scoring._id_type(classes)).tolist() == [*call(own, [w.encode() for w in words])[0], classes.end]
        assert {r["word"] for r in rare} == {w for w in words if w[0] == "x"}
    assert asked == [b"x1", b"x2", b"x3", b"x1"]
