import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm.mixing import DOMAINS, TARGETS, fit_rates, mix, rate_of, settle


def plain_rates(tokens, p, targets, steps):
    """Projected gradient document by document."""
    wanted = np.array([targets[k] for k in DOMAINS])
    total = tokens.sum()
    length = 1 / np.linalg.eigvalsh((p * (tokens / total)[:, None]).T @ p)[-1]
    rate = np.ones(len(tokens))
    for _ in range(steps):
        over = (p * (tokens * rate)[:, None]).sum(0) / total - wanted
        rate = np.maximum(0, rate - length * (p @ over))
    return rate


def test_rates_match_documentwise_descent(spark):
    rng = np.random.default_rng(9)
    p = rng.dirichlet([0.4, 0.3, 0.3], 400)
    p = np.floor(p * 1000).astype(int)
    p[:, 0] += 1000 - p.sum(1)
    tokens = rng.integers(0, 500, 400)
    frame = spark.createDataFrame([(k, int(t), [int(x) for x in row]) for k, (t, row) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<int>")
    targets = {"good": 0.6, "low": 0.3, "toxic": 0.1}
    steps = fit_rates(frame, targets, tolerance=1e-3)
    got = [r[0] for r in frame.orderBy("doc_id").select(rate_of(F.col("p"), steps)).collect()]
    assert np.allclose(got, plain_rates(tokens, p / 1000, targets, len(steps)), atol=1e-9)
    sums = ((p / 1000) * (tokens * np.array(got))[:, None]).sum(0) / tokens.sum()
    assert np.abs(sums - [0.6, 0.3, 0.1]).max() <= 1e-3 and min(got) >= 0


def test_targets_are_met_and_toxic_documents_leave(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    out = mix(docs, labels).join(labels, "doc_id", "left").toPandas()
    total = out["tokens"].sum()
    for name, share in TARGETS.items():
        assert abs((out["tokens"] * out["rate"] * out[f"p_{name}"]).sum() / total - share) < 0.03
    known = out.dropna(subset=["toxic"])
    assert (known.loc[known["toxic"] == 0, "rate"] >= 0.5).mean() > 0.98
    assert (known.loc[known["toxic"] == 1, "rate"] < 0.5).mean() > 0.7
    assert ((out["copies"] - out["rate"]).abs() < 1).all()


@pytest.mark.parametrize("labelled", [True, False])
def test_edges(spark, documents, labelled):
    rows = [(1, None, "en"), (2, "", "en"), (3, "idiot trash " * 30_000, "en"), (4, "fine words here", "en"), (4, "fine words here", "en"), (5, "fine", None)]
    marks = [(3, 0, 1, "z"), (4, 1, 0, "z"), (4, None, 0, "z"), (None, 1, 1, "z"), (99, 1, 0, "z")] if labelled else []
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, domain string")
    out = mix(documents(rows), labels, keep=["doc_id", "row"]).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 3, 4, 4, 5] and {r.doc_id: r.tokens for r in out}[3] == 60_000
    assert all(abs(r.p_good + r.p_low + r.p_toxic - 1) < 1e-9 and r.rate >= 0 and r.row == 1 for r in out)
    if not labelled:
        assert {(r.p_good, r.p_low, r.p_toxic) for r in out} == {(0.25, 0.25, 0.5)}
    assert mix(documents([]), labels).count() == 0


@pytest.mark.parametrize("share", [0.002, 0.01])
@pytest.mark.parametrize("good", [0.85, 0.7])
def test_toxic_documents_leave_whatever_their_share(spark, share, good):
    rest = 1_000_000 * (1 - share)
    rows = [(int(rest * good), [990, 5, 5]), (int(rest * (1 - good)), [10, 985, 5]), (int(1_000_000 * share), [0, 20, 980])]
    frame = spark.createDataFrame(rows, "tokens long, p array<int>")
    steps = settle(frame, TARGETS, fit_rates(frame, TARGETS))
    got = frame.select("tokens", "p", rate_of(F.col("p"), steps).alias("rate")).collect()
    by_domain = [r.rate for r in sorted(got, key=lambda r: -r.tokens)]
    assert by_domain[2] < 0.1 and min(by_domain[:2]) > 0.4
    total = sum(r.tokens for r in got)
    for k, name in enumerate(DOMAINS[:2]):
        assert abs(sum(r.tokens * r.rate * r.p[k] for r in got) / 1000 / total - TARGETS[name]) <= 0.01 * TARGETS[name] + 1e-9
