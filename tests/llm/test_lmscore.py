from __future__ import annotations

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from noticeloom.llm import lmscore
from pyspark.sql import functions as F

from .conftest import DOCS, prose, rows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
_LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER)), None]


def brute(docs, learn):
    train = Counter(t for i, text in docs if learn(i) for t in tokens(text))
    n, v = sum(train.values()), len(train)
    out = {}
    for i, text in docs:
        own = tokens(text)
        out[i] = (len(own), sum(train[t] > 0 for t in own), n, sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))
    return out


@pytest.fixture(scope="module")
def model():
    subwords = lmscore.Subwords(PATH)
    texts = [subwords.ids(prose(i, 60)) for i in range(60)]
    found = lmscore.train(texts, subwords.size, subwords.end, epochs=3)
    every = np.concatenate(texts)
    found.learn_counts(np.bincount(every, minlength=subwords.size).astype(float), found.count_pairs(every))
    return found


def test_next_id_probabilities_sum_to_one(model):
    subwords = lmscore.Subwords(PATH)
    context, total = subwords.ids("the of and to in is was on")[:-1], 0.0
    for first in range(0, subwords.size, 4000):
        last = np.arange(first, min(first + 4000, subwords.size), dtype=np.int32)
        each = np.concatenate([np.concatenate([context, [x]]).astype(np.int32) for x in last])
        size = len(context) + 1
        total += np.exp(model.log_probs(each, np.arange(0, len(each) + 1, size))[size - 1 :: size].astype(float)).sum()
    assert abs(total - 1) < 1e-3


def plain_attention(model, ids):
    """One id at a time, by the definition of the windows."""
    w, s, out = model.w, lmscore.STRIDE, []
    context = [model.kind[i] for i in (len(model.group) - 1, *ids[:-1])]
    for t in range(len(ids)):
        row = t % s
        seen = range(max(0, t - row - s), t + 1)
        q = w["Q"][context[t]]
        score = np.array([min(30, q @ w["K"][context[j]] + w["bias"][row, s + row - (t - j)]) for j in seen], float)
        a = np.exp(score) / np.exp(score).sum()
        mixed = sum(x * w["V"][context[j]] for x, j in zip(a, seen, strict=True))
        h = np.tanh(np.concatenate([mixed, w["X"][context[t]], [1]]) @ w["H"])
        logit = (np.append(h, 1) @ w["O"]).astype(float)
        group = model.group[ids[t]]
        out.append(logit[group] - np.log(np.exp(logit).sum()) + model.pair[context[t], model.column[ids[t]]] + model.alone[ids[t]])
    return np.array(out)


def test_windows_equal_the_definition_wherever_a_text_lies(model):
    subwords = lmscore.Subwords(PATH)
    texts = [subwords.ids(t) for t in (prose(1, 70), "", prose(2, 3), "x", prose(3, 20), None)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.log_probs(np.concatenate(texts), bounds)
    for i, t in enumerate(texts):
        assert np.allclose(got[bounds[i] : bounds[i + 1]], plain_attention(model, t), atol=1e-3)


def test_counts_and_base_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "HEAD_WORDS", 20)  # most words go through the join
    docs = [(i, prose(i, 5 + i % 40) + (f" rare{i}" if i % 3 == 0 else " Ünï\x1cx")) for i in range(80)] + [(100, None), (101, ""), (102, "NEW words only-here")]
    learn = lambda i: i % 4 != 1 and i != 102
    column = (F.col("doc_id") % 4 != 1) & (F.col("doc_id") != 102)
    got = lmscore.score_texts(spark.createDataFrame(rows(docs), DOCS), column, PATH).collect()
    want = brute(docs, learn)
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_order_of_words_matters(spark):
    """Held-out texts in order are likelier than the same words shuffled: the model has learned from context."""
    text = lambda i: " ".join(w for k in range(12) for w in (("red", "apples", "grow", "slowly") if (i + k) % 2 else ("blue", "rivers", "run", "quickly")))
    shuffled = lambda i: " ".join(np.random.default_rng(i).permutation(text(i).split()))
    docs = [(i, text(i)) for i in range(120)] + [(1000 + i, shuffled(i)) for i in range(20)]
    got = {r.doc_id: r.score for r in lmscore.score_texts(spark.createDataFrame(rows(docs), DOCS), F.col("doc_id") < 100, PATH).collect()}
    assert np.mean([got[100 + i] for i in range(20)]) > np.mean([got[1000 + i] for i in range(20)]) + 5


def test_odd_rows(spark, odd_docs, no_docs):
    got = lmscore.score_texts(odd_docs, F.col("doc_id") > 5, PATH).collect()
    assert len(got) == odd_docs.count() and all(np.isfinite([r.score, r.base_score]).all() for r in got)
    assert lmscore.score_texts(no_docs, F.lit(True), PATH).count() == 0
    untrained = lmscore.score_texts(odd_docs, F.lit(None).cast("boolean"), PATH).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_the_model_learns_from_texts_beyond_the_sample(spark, monkeypatch):
    """With a sample of one text, ids of all others have kinds and columns of their own, and all texts move the network."""
    seen, learn_counts = [], lmscore.AttentionModel.learn_counts
    monkeypatch.setattr(lmscore, "SAMPLE_IDS", 1)
    monkeypatch.setattr(lmscore.AttentionModel, "learn_counts", lambda self, *a: (seen.append(self), learn_counts(self, *a)))
    common = [prose(1, 12)] * 40
    for more in ("reservoir turbine " * 30, "turbine reservoir reservoir " * 20):
        docs = [(i, t) for i, t in enumerate(common)] + [(100 + i, more) for i in range(40)]
        lmscore.score_texts(spark.createDataFrame(rows(docs), DOCS), F.col("doc_id") < 1000, PATH).collect()
    subwords = lmscore.Subwords(PATH)
    for model in seen:
        for word in (b"reservoir", b"turbine"):
            ids = np.frombuffer(subwords[word], np.uint32)
            assert (model.kind[ids] < lmscore.KINDS - lmscore.CLASSES).all() and (model.column[ids] < lmscore.COLUMNS - lmscore.CLASSES).all()
    assert not np.allclose(seen[0].w["H"], seen[1].w["H"])


def test_the_gradient_equals_differences():
    r = np.random.default_rng(3)
    group = np.arange(lmscore.COLUMNS) % lmscore.CLASSES
    layout = lmscore._layout(np.arange(lmscore.COLUMNS)[::-1], group)
    texts = [r.integers(0, 40, n).astype(np.int32) for n in (50, 21)]
    p = lmscore.train_weights(texts, layout, epochs=1)
    ids, text = np.concatenate(texts), np.repeat([0, 1], [50, 21])
    kinds, targets = layout[1][ids], group[ids]
    loss = lambda: -lmscore._class_log_probs(lmscore._tables(p), kinds, targets, layout[1][-1], text, 0, len(ids))[0].sum()
    g = lmscore._gradient(p, lmscore._tables(p), kinds, targets, layout[1][-1], text, 0, len(ids))
    for name in p:
        flat = p[name].reshape(-1)
        for at in r.integers(0, flat.size, 4):
            kept, found = flat[at], []
            for move in (1e-5, -1e-5):
                flat[at] = kept + move
                found.append(loss())
            flat[at] = kept
            assert abs((found[0] - found[1]) / 2e-5 - g[name].reshape(-1)[at]) < 1e-3


def test_a_step_makes_no_index_of_every_weight_and_adam_equals_its_formula():
    """What a step costs is the arrays it makes; one index of every place and weight was the largest of them."""
    r = np.random.default_rng(4)
    group = np.arange(lmscore.COLUMNS) % lmscore.CLASSES
    layout = lmscore._layout(np.arange(lmscore.COLUMNS)[::-1], group)
    text = r.integers(0, 600, 3 * lmscore.STEP_IDS).astype(np.int32)
    p = {k: x.astype(np.float32) for k, x in lmscore.train_weights([text[:500]], layout, epochs=1).items()}
    args = (p, lmscore._tables(p), layout[1][text], group[text], layout[1][-1], np.zeros(len(text), np.int64), lmscore.STEP_IDS, 2 * lmscore.STEP_IDS)
    g = lmscore._gradient(*args)
    tracemalloc.start()
    lmscore._gradient(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1350 * lmscore.STEP_IDS  # bytes an id
    want = {k: x.astype(float) for k, x in p.items()}
    adam = lmscore._Adam(p)
    m, s = ({k: np.zeros(x.shape) for k, x in want.items()} for _ in range(2))
    for t in (1, 2, 3):
        adam.step(g, lmscore.STEP_IDS, 0.01)
        for k, x in g.items():
            m[k] += 0.1 * (x / lmscore.STEP_IDS - m[k])
            s[k] += 0.01 * ((x / lmscore.STEP_IDS) ** 2 - s[k])
            want[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
    assert all(np.allclose(p[k], want[k], atol=1e-4) for k in want)


def test_phrases_are_cut_alike_wherever_they_stand():
    r = np.random.default_rng(1)
    shared = r.integers(0, 5000, 400).astype(np.int32)
    own = [r.integers(0, 5000, n).astype(np.int32) for n in (37, 1, 90)]
    texts = [np.concatenate([own[0], shared, own[1]]), np.concatenate([own[2], shared]), own[1], shared]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, key = lmscore.phrases(np.concatenate(texts), bounds)
    assert start[0] == 0 and start[-1] == bounds[-1] and set(bounds) <= set(start.tolist())
    found = [set(key[(start[:-1] >= a) & (start[:-1] < b)].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert len(found[0] & found[1] & found[3]) >= len(found[3]) - 2
    for t, names in zip(texts, found, strict=True):  # a text alone is cut as among others
        assert set(lmscore.phrases(t, np.array([0, len(t)]))[1].tolist()) == names


def test_scores_equal_brute_force_and_a_text_is_not_its_own_memory(spark, monkeypatch):
    """Scores are sums over phrases of the network mixed with the counts of the other training texts, frequent phrases or rare."""
    kept, learn_counts = [], lmscore.AttentionModel.learn_counts
    monkeypatch.setattr(lmscore.AttentionModel, "learn_counts", lambda self, *a: (kept.append(self), learn_counts(self, *a)))
    docs = [(i, prose(i, 60)) for i in range(40)] + [(50 + i, prose(3, 60)) for i in range(3)] + [(60, prose(7, 60)), (61, prose(900, 60)), (62, "")]
    learn = lambda i: i < 52
    subwords = lmscore.Subwords(PATH)
    for words in (0, 30):
        monkeypatch.setattr(lmscore, "HEAD_WORDS", words)
        got = {r.doc_id: r.score for r in lmscore.score_texts(spark.createDataFrame(rows(docs), DOCS), F.col("doc_id") < 52, PATH).collect()}
        model, every = kept[-1], {i: subwords.ids(t) for i, t in docs}
        cut = {i: lmscore.phrases(ids, np.array([0, len(ids)])) for i, ids in every.items()}
        memory = Counter(k for i in every if learn(i) for k in cut[i][1].tolist())
        for i, ids in every.items():
            start, key = cut[i]
            log_p, own, score = model.log_probs(ids, np.array([0, len(ids)])) / np.log(10), Counter(key.tolist() if learn(i) else []), 0.0
            for a, b, k in zip(start[:-1], start[1:], key.tolist(), strict=True):
                n, total = memory[k] - own[k], sum(memory.values()) - sum(own.values())
                score += math.log10(0.9 * 10 ** log_p[a:b].sum() + 0.1 * n / total)
            assert abs(score - got[i]) < 1e-3 * abs(score), i
    alone = np.mean([got[i] for i in range(20, 40)])
    assert got[60] > 0.7 * alone and got[3] > 0.7 * alone and got[52] > 0.7 * alone  # met elsewhere, and alone < 0
    assert abs(got[61] - alone) < 0.25 * abs(alone)


def test_words_are_told_by_their_ids():
    subwords = lmscore.Subwords(PATH)
    texts = ["the of THE untokenizableish", "", "x", None, "Ünï\x1cx of \x85 \x85 " + "w" * 500, "the\u00a0of the"]
    every = [subwords.ids(t) for t in texts]
    doc, key = lmscore.words_of(np.concatenate(every), np.concatenate([[0], np.cumsum([len(x) for x in every])]), subwords.begins)
    want = [(i, w) for i, t in enumerate(texts) for w in tokens(t)[:-1]]
    assert doc.tolist() == [i for i, _ in want]
    names = {}
    for k, (_, w) in zip(key.tolist(), want, strict=True):
        assert names.setdefault(w, k) == k
    assert len(set(names.values())) == len(names)


def test_frequent_keys_are_found():
    r = np.random.default_rng(1)
    key = r.integers(-(2**63), 2**63 - 1, 5000)
    key[:40] = (key[0] >> 44 << 44) + np.arange(40)  # equal high bits
    head = lmscore._Head(key, np.arange(1, 5001))
    asked = np.concatenate([key, key + 1000, [0]])
    hit, n = head.find(asked)
    want = dict(zip(key.tolist(), range(1, 5001), strict=True))
    assert hit.tolist() == [k in want for k in asked.tolist()] and n.tolist() == [want.get(k, 0) for k in asked.tolist()]
    assert not lmscore._Head(np.empty(0, np.int64), np.empty(0, np.int64)).find(asked)[0].any()


def test_a_batch_of_texts_encodes_each_word_once_and_equals_word_by_word():
    subwords = lmscore.Subwords(PATH)
    asked, encode = [], subwords._encode
    subwords._encode = lambda text: (asked.append(text), encode(text))[1]
    odd = ["the of THE the", "", None, "  lead\ttrail \n\r\x0b\x0c ", "Ünï\x1cx of \x85 \x85 " + "w" * 500, "\x00 a\x00b \x1c\x1d", "   ", "İI ﬁ 😀 x　y the of", "<|endoftext|>"]
    texts = pa.array(odd + ["common words here"] * 200)
    for some in (texts, texts.slice(3, 5), texts.slice(0, 0)):  # a slice begins within the buffers of its column
        asked.clear()
        ids, bounds = subwords.batch(some)
        words = {w for t in some.to_pylist() for w in tokens(t)[:-1]}
        assert len(asked) == 1 and sorted(w for w in asked[0].split(" ") if w) == sorted(words)
        for t, a, b in zip(some.to_pylist(), bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == [i for w in tokens(t)[:-1] for i in encode(" " + w)] + [subwords.end]


def test_a_gradient_step_makes_no_copies_of_its_inputs_for_columns_of_ones():
    r = np.random.default_rng(4)
    group = np.arange(lmscore.COLUMNS) % lmscore.CLASSES
    layout = lmscore._layout(np.arange(lmscore.COLUMNS)[::-1], group)
    text = r.integers(0, 600, 3 * lmscore.STEP_IDS).astype(np.int32)
    p = {k: x.astype(np.float32) for k, x in lmscore.train_weights([text[:500]], layout, epochs=1).items()}
    args = (p, lmscore._tables(p), layout[1][text], group[text], layout[1][-1], np.zeros(len(text), np.int64), lmscore.STEP_IDS, 2 * lmscore.STEP_IDS)
    lmscore._gradient(*args)
    tracemalloc.start()
    lmscore._gradient(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1100 * lmscore.STEP_IDS  # bytes an id
