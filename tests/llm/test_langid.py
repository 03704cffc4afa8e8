import numpy as np
import pandas as pd

from shelfmark.llm.langid import fit, identify, label_rows, pooled
from shelfmark.llm.recurrent import GRU, LSTM, BiRNN


def squares(model, scores, target):
    d = scores - target
    return 0.5 * float((d * d).sum()), d, {}


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(1)
    for cell in (GRU, LSTM):
        model = BiRNN(cell, 5, 3, 2)
        model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
        x, y = rng.integers(0, 5, (6, 4)), rng.normal(size=(6, 4, 2))

        def value(model=model, x=x, y=y, cell=cell):
            f = np.stack(cell.train_pass(model.side("f"), x)[0]) @ model.p["fW"]
            b = np.stack(cell.train_pass(model.side("b"), x[::-1])[0])[::-1] @ model.p["bW"]
            return 0.5 * ((f + b + model.p["bias"] - y) ** 2).sum(), f + b + model.p["bias"] - y

        _, d = value()
        grads = {k: np.zeros_like(v) for k, v in model.p.items()}
        for side, order, dd in (("f", x, d), ("b", x[::-1], d[::-1])):
            _, kept = cell.train_pass(model.side(side), order)
            own = {k[1:]: g for k, g in grads.items() if k[0] == side and k != "bias"}
            cell.back_pass(model.side(side), kept, dd @ model.p[side + "W"].T, own)
        for name in (f"{s}{kind}{g}" for s in "fb" for kind in "EU" for g in cell.GATES):
            at = tuple(int(k) // 2 for k in model.p[name].shape)
            kept = model.p[name][at]
            model.p[name][at] = kept + 1e-6
            high = value()[0]
            model.p[name][at] = kept - 1e-6
            low = value()[0]
            model.p[name][at] = kept
            assert abs((high - low) / 2e-6 - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at])), name


def test_fast_and_training_pass_agree():
    x = np.random.default_rng(2).integers(0, 5, (7, 3))
    for cell in (GRU, LSTM):
        model = BiRNN(cell, 5, 4, 2)
        slow, _ = cell.train_pass(model.side("f"), x)
        assert np.allclose(np.stack(list(cell.states(model.side("f"), x))), np.stack(slow), atol=1e-5)


def test_segments_cover_whole_texts():
    sample = pd.DataFrame({"lang": ["a"] * 20 + ["b"] * 20, "piece": [b"xy zx yy zz " * 8] * 20 + [b"pq rp qq rr " * 8] * 20})
    languages, model = fit(sample, steps=40)
    texts = [b"xyzz " * 9, b"pqrr " * 300 + b"xyzz ", b"", b"p"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = pooled(model, np.cumsum([0, *map(len, texts)]), data)
    assert languages == ["a", "b"] and out[0].argmax() == 0 and out[1].argmax() == 1 and out[2].sum() == 0
    assert np.allclose(out[[0, 1, 3]].sum(1), 1, atol=1e-3)
    assert 0.9 < out[1][1] < 1  # the tail counts too


def test_held_out_accuracy(small):
    docs = small["documents"]
    out = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.95 and out["score"].between(0, 1).all()


def test_edges(documents, small):
    train = [(1000 + r.doc_id, r.text, r.lang) for r in small["documents"].limit(120).collect()]
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", None), (4, "the and of the " * 40_000, None), (4, "x", None)]
    out = label_rows(documents(train + rows), ["doc_id", "row"]).where("doc_id < 10").orderBy("doc_id", "score").collect()
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and len(out) == 5 and all(r.row == 1 for r in out)
    assert any(r.lang_pred == "en" for r in out[3:])
    assert [r.lang_pred for r in identify(documents([(5, "abc", None)])).collect()] == ["und"]
    assert identify(documents([])).count() == 0
