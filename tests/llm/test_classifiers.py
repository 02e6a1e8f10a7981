from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from noticeloom.llm import quality, toxicity
from noticeloom.llm.folds import labelled_texts, remainder, training_rows
from noticeloom.llm.wordhash import raw_strings
from pyspark.sql import functions as F

from .conftest import DOCS, prose, rows


def toxic_corpus(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    """An insult alone is harmless here, and so is a group; only both make a text toxic - a pair, not a sum."""
    r = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = prose(seed * 7919 + i, r.randint(20, 60)).split()
        for there, word in ((insult, "vermin"), (group, "martians")):
            if there:
                words.insert(r.randrange(len(words)), word)
        texts.append(" ".join(words))
        y.append(int(insult and group))
    return texts, np.array(y)


def labelled(spark, texts, y):
    docs = spark.createDataFrame(rows(list(enumerate(texts))), DOCS)
    return docs, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")


def test_pairs_are_learned(spark):
    texts, y = toxic_corpus(1500, 1)
    model = toxicity.fit(*labelled(spark, texts, y), F.lit(True))
    more, truth = toxic_corpus(400, 2)
    score = model.score(pa.array(more))
    assert ((score >= 0.7) == truth).mean() > 0.97


def test_pairs_whose_words_tell_nothing_alone_are_learned(spark):
    """Toxic if both words stand there or neither: each alone is as frequent in toxic texts as in clean ones."""

    def corpus(n: int, seed: int):
        r, texts, y = random.Random(seed), [], []
        for i in range(n):
            both, either = r.random() < 0.5, r.random() < 0.5
            words = prose(seed * 7919 + i, r.randint(20, 60)).split()
            new = (["vermin", "martians"] if either else []) if both else (["vermin"] if either else ["martians"])
            at = r.randrange(len(words))
            texts.append(" ".join([*words[:at], *new, *words[at:]]))
            y.append(int(both))
        return texts, np.array(y)

    model = toxicity.fit(*labelled(spark, *corpus(2000, 3)), F.lit(True))
    more, truth = corpus(400, 4)
    assert ((model.score(pa.array(more)) >= 0.7) == truth).mean() > 0.95


def test_scores_equal_the_definition_over_all_pairs(spark):
    """Brute force: the weights of the distinct known terms, and the products of all their pairs."""
    texts, y = toxic_corpus(300, 5)
    model = toxicity.fit(*labelled(spark, texts, y), F.lit(True))
    for text in [*texts[:20], "", "vermin vermin martians", texts[0] * 40]:
        _, found = toxicity._terms(*raw_strings(pa.array([text])))
        at = [int(np.searchsorted(model.terms, t)) for t in sorted(set(found.tolist()) & set(model.terms.tolist()))]
        logit = model.bias + sum(model.weight[i] for i in at) + sum(model.factor[i] @ model.factor[j] for n, i in enumerate(at) for j in at[n + 1 :])
        assert abs(model.score(pa.array([text]))[0] - 1 / (1 + np.exp(-logit))) < 1e-6


def test_chosen_terms_equal_a_count_in_python(spark):
    texts, y = toxic_corpus(400, 6)
    docs, labels = labelled(spark, texts, y)
    got = toxicity._useful(docs.join(labels, "doc_id").select("doc_id", F.col("toxic").alias("y"), "text").repartition(5), int(y.sum()), int((1 - y).sum()))

    def gain(present):
        total = 0.0
        for there in (True, False):
            for label in (0, 1):
                seen = sum(p == there and v == label for p, v in zip(present, y, strict=True))
                total += seen * np.log(seen / (sum(p == there for p in present) * sum(y == label) / len(y))) if seen else 0
        return 2 * total

    name = lambda w: int(toxicity._terms(*raw_strings(pa.array([w])))[1][0])
    words = [set(t.split()) for t in texts]
    for w in ("vermin", "martians", "the", "of"):
        if gain([w in own for own in words]) > toxicity.TERM_GAIN:
            assert name(w) in got
    assert name("vermin") in got and name("martians") in got


def test_a_cut_is_in_the_widest_gap_with_the_least_errors():
    assert toxicity._cut(np.array([0.0, 1, 2, 10, 11]), np.array([0, 0, 0, 1, 1])) == 6
    assert toxicity._cut(np.array([0.0, 5, 2, 10, 11]), np.array([0, 0, 1, 1, 1])) in (1.0, 7.5)


def test_only_one_class_or_nothing(spark):
    for y in (0, 1):
        model = toxicity.fit(*labelled(spark, ["a b", "c"], [y, y]), F.lit(True))
        assert ((model.score(pa.array(["x", None, ""])) > 0.5) == y).all()
    docs, labels = labelled(spark, ["x"], [0])
    assert toxicity.fit(docs.limit(0), labels.limit(0), F.lit(True)).score(pa.array(["x"]))[0] < 0.5


def test_repeated_labelled_ids_count_once(spark):
    docs, labels = labelled(spark, [f"some text {i}" for i in range(20)], [i % 2 for i in range(20)])
    many = docs.unionByName(docs).unionByName(docs.withColumn("text", F.lit("zzz")))
    got = labelled_texts(many, training_rows(labels.unionByName(labels), "toxic", F.lit(True), {1: 5, 0: 5})).collect()
    assert len(got) == len({r.doc_id for r in got}) == 10 and all(r.text.startswith("some") for r in got)


def bad(seed: int, n: int) -> str:
    r = random.Random(seed)
    kind = r.randrange(3)
    words = prose(seed, n).split()
    return " | ".join(words) if kind == 0 else " ".join(w for w in words[: n // 10] for _ in range(10)) if kind == 1 else " ".join(w.upper() + "!!" for w in words)


def test_one_bad_passage_decides():
    texts = [prose(i, random.Random(i).randint(10, 400)) for i in range(300)]
    labels = [1] * 300
    for i in range(300):
        texts.append(prose(1000 + i, 150) + " " + bad(i, 100) + " " + prose(2000 + i, 100))
        labels.append(0)

    def bags(some):
        data, offsets = raw_strings(pa.array(some))
        x, b = quality.measures(data, offsets)
        return [x[b[i] : b[i + 1]].astype(float) for i in range(len(some))]

    y = np.array(labels, float)
    order = np.random.default_rng(0).permutation(len(y))
    model = quality.train([bags(texts)[i] for i in order[:450]], y[order[:450]])
    held = order[450:]
    score = model.score(pa.array([texts[i] for i in held]))
    assert ((score >= 0.5) == y[held]).mean() > 0.95


def test_quality_scores_equal_the_definition():
    """Brute force: passages of 64 words, their measures and hashed words one by one, gates, attention and mixture by loops."""
    texts = [prose(i, n) for i, n in enumerate((1, 63, 64, 65, 200))] + ["", " \n", bad(3, 150), "ÜBER \x85 12 !! a a a", "w" * 5000]
    data, offsets = raw_strings(pa.array([*texts, None]))
    x, b = quality.measures(data, offsets)
    bags = [x[b[i] : b[i + 1]].astype(float) for i in range(len(texts))]
    model = quality.train(bags, np.arange(len(bags)) % 2.0, epochs=3)
    w = {k: v.astype(float) for k, v in model.weights.items()}
    for text, got, bag in zip(texts, model.score(pa.array(texts)), bags, strict=True):
        words = text.encode().split()
        passages = [words[i : i + quality.PASSAGE] for i in range(0, len(words), quality.PASSAGE)] or [[]]
        assert len(passages) == len(bag)
        weight, encoded = [], []
        for own, row in zip(passages, bag, strict=True):
            if own:
                chars = sum(map(len, own))
                assert abs(row[0] - np.log1p(len(own)) / 4) < 1e-6 and abs(row[6] - len({v.lower() for v in own}) / len(own)) < 1e-6
                assert abs(row[4] - sum(chr(c).isdigit() for v in own for c in v if c < 128) / chars) < 1e-6
                assert abs((row[quality.MEASURED :] * len(own) ** 0.5).sum() - len(own)) < 1e-3
            h = np.tanh((row - w["shift"]) * w["scale"] @ w["E"] + w["e"])
            weight.append(np.exp(sum(a * np.tanh(h @ w["V"][:, k]) / (1 + np.exp(-(h @ w["U"][:, k]))) for k, a in enumerate(w["a"]))))
            encoded.append(h)
        z = sum(a * h for a, h in zip(weight, encoded, strict=True)) / sum(weight)
        assert abs(got - 1 / (1 + np.exp(-(z @ w["c"] + w["b"][0])))) < 1e-4


def test_gradient_is_right():
    r = np.random.default_rng(1)
    w = {"E": r.normal(size=(16, 5)), "e": r.normal(size=5), "V": r.normal(size=(5, 3)), "U": r.normal(size=(5, 3)), "a": r.normal(size=3), "c": r.normal(size=5), "b": r.normal(size=1)}
    x, bounds, y = r.normal(size=(7, 16)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality._forward(w, x, bounds)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in quality._gradient(w, x, bounds, y).items():
        at = (0,) * w[name].ndim
        keep, step = w[name][at], 1e-6
        w[name][at] = keep + step
        up = loss()
        w[name][at] = keep - step
        down = loss()
        w[name][at] = keep
        assert abs((up - down) / (2 * step) - g[at]) < 1e-5


def test_whole_queries_on_odd_rows(spark, odd_docs, no_docs):
    train = spark.createDataFrame(rows([(100 + i, prose(i, 40) if i % 2 else bad(i, 40) + " scum") for i in range(60)]), DOCS)
    labels = train.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    labels = labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, None, None)], labels.schema))
    fold = remainder("doc_id", 3) != 1
    for module, column in ((toxicity, toxicity.toxicity_score), (quality, quality.quality_score)):
        model = module.fit(train, labels, fold)
        for docs in (odd_docs, no_docs):
            got = docs.select(column(model, F.col("text")).alias("s")).collect()
            assert len(got) == docs.count() and all(0 <= r.s <= 1 for r in got)
        module.fit(train.limit(0), labels.limit(0), fold)


def test_a_long_text_takes_no_more_room_in_the_fit():
    import numpy as np
    from noticeloom.llm import quality

    x = np.random.default_rng(1).random((1000, 5)).astype(np.float32)
    for n in (1, 127, 128, 129, 200, 256, 1000):
        bag = quality.bounded_bag(x[:n])
        assert len(bag) == min(n, quality.BAG)
        cuts = [i * n // len(bag) for i in range(len(bag))] + [n]
        assert np.allclose(bag, [x[a:b].mean(0) for a, b in zip(cuts, cuts[1:])], atol=1e-6)
