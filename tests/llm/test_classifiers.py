import zlib

import numpy as np
import pandas as pd
import pytest

from ticketloom.llm import quality_classifier, toxicity
from ticketloom.llm.queries import QUERIES, table
from ticketloom.llm.samples import Sample

FOLDER = "/root/testdata/sf0.01"


def held_out_accuracy(spark, name, label, folds, held):
    found = QUERIES[name](spark, FOLDER).toPandas()
    ids = pd.read_parquet(f"{FOLDER}/documents.parquet")["doc_id"]
    assert sorted(found["doc_id"]) == sorted(ids)
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % folds == held for i in found["doc_id"]]).all()
    assert found["score"].between(0, 1).all()
    rows = found[found["held_out"]].merge(pd.read_parquet(f"{FOLDER}/labels.parquet"), on="doc_id")
    return (rows["predicted"] == rows[label]).mean(), found


def test_quality_of_held_out_documents(spark):
    accuracy, found = held_out_accuracy(spark, "op4_quality_classifier", "quality", 4, 2)
    assert accuracy >= 0.95
    assert (found["predicted"] == (found["score"] >= 0.7)).all()


def test_toxicity_of_held_out_documents(spark):
    accuracy, found = held_out_accuracy(spark, "op9_toxicity", "toxic", 5, 0)
    assert accuracy >= 0.9
    assert (found["predicted"] == (found["score"] >= 0.5)).all()


def test_labels_of_the_held_out_fold_change_nothing(spark):
    documents, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    held = "pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), {0}) = {1}"
    for module, label, folds, fold in ((quality_classifier, "quality", 4, 2), (toxicity, "toxic", 5, 0)):
        turned = labels.selectExpr("doc_id", f"IF({held.format(folds, fold)}, 1 - {label}, {label}) AS {label}")
        one, other = module.fit(documents, labels), module.fit(documents, turned)
        if module is toxicity:
            assert one == other
        else:
            assert all((one.weights[k] == other.weights[k]).all() for k in one.weights)


def test_models_of_all_kinds_of_rows(edge, none, labels_of):
    labels = labels_of((1, 1, 0), (5, 0, 1), (5, 0, 1), (6, 0, 1), (7, 1, 0), (8, 1, 0), (9, 0, 0), (3, 1, 0), (3, 0, 1), (None, 1, 1))
    for module, constant in ((quality_classifier, 0.5), (toxicity, 0.0)):
        for model in (module.fit(edge, labels), module.fit(edge, labels.limit(0)), module.fit(none, labels)):
            found = module.scored(edge, model).collect()
            assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r["doc_id"]) for r in edge.collect())
            assert all(0 <= r["score"] <= 1 for r in found)
            assert module.scored(none, model).collect() == []
        nothing = module.scored(edge, module.fit(edge, labels.limit(0)))
        assert {r["score"] for r in nothing.collect()} == {constant}
    net = quality_classifier.fit(edge, labels)
    assert quality_classifier.accepted(edge, net).columns == edge.columns


def test_passages_cover_whole_texts():
    texts = ["", "one", "w " * 64, "w " * 65, " x\n" * 1_000, "#" * 9_000]
    features, counts = quality_classifier.passages(texts)
    assert counts.tolist() == [1, 1, 1, 2, 16, 1]
    assert features.shape == (22, quality_classifier.FEATURES) and np.isfinite(features).all()
    alone = [quality_classifier.passages([t])[0] for t in texts]
    assert np.allclose(features, np.concatenate(alone))


def test_gradients_of_the_attention_network():
    rng = np.random.default_rng(3)
    texts = ["good words here " * 40, "BAD!! ### $$$ " * 70, "plain", "x x x x " * 50]
    net = quality_classifier.fitted(Sample(texts * 4, [1, 0, 1, 0] * 4, 0.5))
    net.weights = {k: rng.standard_normal(v.shape) / 4 for k, v in net.weights.items()}
    features, counts = quality_classifier.passages(texts)
    labels, importance = np.array([1, 0, 1, 0.0]), np.array([0.1, 0.4, 0.2, 0.3])

    def loss():
        y = net.forward(features.astype(np.float64), counts)["y"]
        return -(importance * (labels * np.log(y) + (1 - labels) * np.log(1 - y))).sum()

    found = quality_classifier._gradients(net, features.astype(np.float64), counts, labels, importance)
    for k, w in net.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(n) for n in w.shape)
            keep, step = w[at], 1e-6
            w[at] = keep + step
            up = loss()
            w[at] = keep - step
            down = loss()
            w[at] = keep
            assert found[k][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)


def test_toxic_words_are_those_beside_different_neighbours():
    import random

    rng = random.Random(6)
    plain = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    ordinary = [" ".join(plain(60)) for _ in range(60)]
    toxic = [" ".join(plain(20) + ["Scoundrel!"] + plain(20) + ["copied shared passage"]) for _ in range(30)]
    assert toxicity.toxic_words(toxic, ordinary) == {b"scoundrel"}
    texts = [t for pair in zip(ordinary, toxic) for t in pair] + ordinary[30:]
    model = toxicity.fitted(Sample(texts, [0, 1] * 30 + [0] * 30, 1 / 3))
    fresh = [" ".join(plain(50)), " ".join(plain(50) + ["scoundrel,"] + plain(9))]
    low, high = toxicity.scores(fresh, model)
    assert low < 0.5 <= high


def test_the_driver_holds_the_features_of_the_sample_once(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(quality_classifier, "STEPS", 1)
    texts = ["", " \n", "a"] + [f"word{i} other, words\n" * (150 + i % 7) for i in range(1500)]
    want = quality_classifier.passages(texts)
    found = quality_classifier._sample_passages(texts)
    assert all(np.array_equal(a, b) for a, b in zip(found, want))
    size = want[0].nbytes
    del want, found
    tracemalloc.start()
    quality_classifier.fitted(Sample(texts, [i % 2 for i in range(len(texts))], 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.7 * size
