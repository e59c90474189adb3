import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import toxicity as T


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def fitted(texts, labels, penalty):
    sample = T.Sample()
    for t in texts:
        sample.add(T.words_of(t))
    return T.fit(sample, np.array(labels), np.ones(len(labels)), penalty)


def test_swaps_keep_a_group_from_being_a_sign():
    """In the labelled texts one group is mentioned in toxic ones only; a neutral mention must not be toxic."""
    rng = np.random.default_rng(0)
    filler = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for _ in range(600):
        y = int(rng.random() < 0.4)
        words = list(rng.choice(filler, 12))
        if y:
            words += [str(rng.choice(["vile", "scummy", "moronic"]))] + (["muslims"] if rng.random() < 0.6 else [])
        elif rng.random() < 0.3:
            words += [str(rng.choice(["christians", "jews"]))]
        texts.append(" ".join(words))
        labels.append(y)
    neutral = ["muslims word1 word2 word3", "word4 muslims word5"]
    plain, fair = fitted(texts, labels, 0.0), fitted(texts, labels, 20.0)
    assert all(fair.score(t) < plain.score(t) for t in neutral)
    assert all(fair.score(t) < T.THRESHOLD for t in neutral)
    assert all(fair.score(t.replace("muslims", "vile")) >= T.THRESHOLD for t in neutral)
    gap = lambda m: abs(m.logit("muslims word1") - m.logit("jews word1"))
    assert gap(fair) < 0.5 * gap(plain)


def test_swapped():
    assert T.swapped({"a", "b"}) == []
    out = T.swapped({"a", "woman", "gay"})
    assert len(out) == T.SWAPS and all("a" in s and len(s) == 3 and "woman" not in s and "gay" not in s for s in out[:3])


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    from lexloom.llm.toxicity import op10_toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    own = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    toxic, clean = [r["predicted"] for r in own if r["toxic"]], [r["predicted"] for r in own if not r["toxic"]]
    assert np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.01


def test_messy(spark, messy, nothing):
    labels = spark.createDataFrame([(13, 1), (13, 0), (5, 0), (3, 0), (2, 0), (99, 1), (None, 1), (14, None), (12, 0)], "doc_id long, toxic int")
    model = T.train(messy, labels)
    rows = T.score(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert T.score(nothing, model).count() == 0
    kept = T.clean(messy, model)
    assert kept.columns == messy.columns
    assert kept.count() == sum(r["score"] < T.THRESHOLD for r in rows)
    none = T.train(messy, labels.where("false"))
    assert {round(r["score"], 6) for r in T.score(messy, none).collect()} == {0.0}
    assert T.train(nothing, labels).weights == {}


def test_learns_from_the_training_folds_only(spark):
    ids = [i for i in range(200) if held(i)]
    docs = spark.createDataFrame([(i, "vile words") for i in ids] + [(i, "fine words") for i in range(200) if not held(i)], "doc_id long, text string")
    model = T.train(docs, docs.select("doc_id", (F.col("text") == "vile words").cast("int").alias("toxic")))
    assert not any("vile" in f for f in model.weights) and model.score("vile words") < 0.01


def test_g2():
    """Against the statistic written out for one word."""
    for a, b, n, m in ((5, 1, 10, 90), (3, 30, 10, 90), (0, 4, 7, 9), (7, 9, 7, 9)):
        cells = [(a, n, a + b), (b, m, a + b), (n - a, n, n + m - a - b), (m - b, m, n + m - a - b)]
        want = sum(2 * x * math.log(x * (n + m) / (row * column)) for x, row, column in cells if x)
        assert T.g2(np.array([float(a)]), np.array([float(b)]), n, m)[0] == pytest.approx(want, abs=1e-9)


def test_fit_is_at_the_minimum(monkeypatch):
    """The loss, written out plainly, has no slope at the fitted weights, and grows on both sides."""
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for _ in range(300):
        y = int(rng.random() < 0.5)
        texts.append(" ".join([*rng.choice(["river", "table", "cloud"], 2), str(rng.choice(["vile", "awful"])) if y != (rng.random() < 0.2) else "fine", *(["women"] if rng.random() < 0.3 else [])]))
        labels.append(y)
    model = fitted(texts, labels, 2.0)

    def loss(bias, weights):
        logit = lambda words: bias + sum(weights.get(f, 0.0) for f in T.features_of(words))
        total = 0.0
        for text, y in zip(texts, labels, strict=True):
            words = T.words_of(text)
            z = logit(words)
            total += math.log1p(math.exp(-z if y else z))
            total += 2.0 / T.SWAPS * sum((logit(s) - z) ** 2 for s in T.swapped(words))
        return total / len(texts) + T.RIDGE / 2 * sum(w * w for w in weights.values()) / len(texts)

    least = loss(model.bias, model.weights)
    for name in [None, *model.weights]:
        for d in (-0.05, 0.05):
            moved = loss(model.bias + d, model.weights) if name is None else loss(model.bias, model.weights | {name: model.weights[name] + d})
            assert moved >= least - 1e-4, (name, d)


def test_score_is_a_sum_over_features():
    model = T.Model(-1.0, {"vile": 2.0, "vile-": 0.5, "aw-": 9.0, "river--": -0.25})
    assert model.logit("Vile RIVERS vile, aw x") == -1.0 + 2.0 + 0.5 + 9.0 - 0.25
    assert model.score("") == pytest.approx(1 / (1 + math.e)) and model.score("Vile RIVERS vile, aw x") == pytest.approx(1 / (1 + math.exp(-10.25)))


def test_columns_named_like_a_label(spark, messy):
    labels = spark.createDataFrame([(13, 1), (5, 0), (3, 0), (2, 0), (12, 0), (11, 1)], "doc_id long, toxic int")
    plain = messy.select("doc_id", "text")
    of = lambda docs, own: sorted(((r["doc_id"], round(r["score"], 9)) for r in T.score(docs, T.train(docs, own)).collect()), key=str)
    assert of(messy, labels) == of(plain, labels) == of(messy, labels.withColumns({"text": F.lit("x"), "quality": F.lit(1), "source": F.lit("s")}))


def test_an_id_of_many_rows_is_one_text_of_the_fit(spark):
    rows = [(1, f"vile {i}") for i in range(300)] + [(i, "vile words" if i % 2 else "fine words") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, *range(3, 60))], "doc_id long, toxic int")
    once = docs.where("doc_id > 1").unionByName(docs.where("text = 'vile 0'"))
    a, b = T.train(docs, labels), T.train(once, labels)
    assert a.weights.keys() == b.weights.keys() and a.bias == pytest.approx(b.bias)


def test_labels_as_texts(spark):
    """Give the same model as numbers; what is neither 0 nor 1 is no label."""
    docs = spark.createDataFrame([(i, f"{'vile' if i % 5 == 0 else 'fine'} word{i % 17} and more") for i in range(300)], "doc_id long, text string")
    numbers = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    texts = numbers.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("toxic").cast("string").alias("toxic")).unionByName(spark.createDataFrame([("1", "yes"), ("2", None), ("3", "7"), (None, "1")], "doc_id string, toxic string"))
    a, b = T.train(docs, numbers), T.train(docs, texts)
    assert a == b and a.weights["vile"] > 0
