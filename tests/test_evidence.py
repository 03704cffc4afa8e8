import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import text as T
from shelfmark.operators import evidence as E
from shelfmark.sources import sinks

PATHS = [
    "Users/admin/Finance/Tax 2021/tax return final.pdf",
    "Users/admin/Finance/Tax 2021/tax tax receipt.pdf",
    "Users/admin/Finance/Bank/statement march.xlsx",
    "games/engine/bin/lib/resources/cache/share_common.dll",
    "readme.txt",
] + [f"games/engine/bin/lib/resources/cache/pack_{i:03d}_asset.dll" for i in range(12)]


@pytest.fixture
def evidence(inventory):
    return E.file_evidence(P.with_parts(inventory(PATHS))).persist()


def test_file_evidence_sources(evidence):
    row = evidence.filter("base = 'tax tax receipt.pdf'").first()
    assert row["filename_tokens"] == ["tax", "tax", "receipt"]
    assert row["parent_tokens"] == ["tax", "2021"]
    assert row["higher_path_tokens"] == ["users", "admin", "finance"]
    assert row["format_package_tokens"] == ["pdf"]
    assert row["candidate_tokens"] == ["2021", "admin", "finance", "pdf", "receipt", "tax", "users"]
    assert row["cluster_root"] == "finance > tax_2021"


def expected_weights(rows):
    """Weights worked out from the definition with plain counters."""
    weight = {"filename": 3.0, "parent": 2.2, "higher_path": 1.4, "format_package": 0.6}
    files, clusters, raw, mix, refs, marked = Counter(), defaultdict(set), Counter(), defaultdict(Counter), Counter(), Counter()
    markers = "resources cache caches tmp bin lib share common objects deps build dist __pycache__".split()
    for r in rows:
        seen = set()
        for source in weight:
            tokens = r[f"{source}_tokens"]
            for t in tokens:
                raw[t] += weight[source]
                mix[t][source] += 1
            for t in set(tokens):
                refs[r["cluster_root"]] += 1
                marked[r["cluster_root"]] += t in markers
            seen |= set(tokens)
        for t in seen:
            files[t] += 1
            clusters[t].add(r["cluster_root"])
    bundle = {c for c in refs if refs[c] >= 40 and marked[c] / refs[c] >= 0.18}
    total, n_clusters = len(rows), len({r["cluster_root"] for r in rows})
    noise = T.NoiseTerms().labels()
    factor = {"stopword": 0.15, "path_scaffolding": 0.35, "packaging": 0.22, "format": 0.18}
    out = {}
    for t in files:
        conc = 1 - len(clusters[t]) / (n_clusters + 1)
        idf = math.log((total + 1) / (files[t] + 1)) + 1
        penalty = 0.25 if clusters[t] & bundle else 1.0
        share = len(clusters[t] & bundle) / len(clusters[t])
        n = sum(mix[t].values())
        high, named = mix[t]["higher_path"] / n, mix[t]["filename"] / n
        if share >= 0.6 and high >= 0.6 and named < 0.2:
            penalty *= 0.28
        elif share >= 0.6 and high >= 0.4:
            penalty *= 0.45
        f = math.prod(factor[k] for k, words in noise.items() if t in words)
        out[t] = (files[t], len(clusters[t]), raw[t] * idf * (0.6 + conc) * f * penalty)
    return out, bundle


def test_single_terms_match_the_definition(evidence):
    singles, _, bundles = E.theme_evidence(evidence)
    want, bundle = expected_weights(evidence.collect())
    got = {r["term"]: r for r in singles.collect()}
    assert set(got) == set(want) and bundle
    for term, (files, clusters, weight) in want.items():
        assert (got[term]["file_presence"], got[term]["cluster_presence"]) == (files, clusters), term
        assert got[term]["adjusted_weight"] == pytest.approx(weight, abs=1e-4), term
    assert {r["cluster_root"] for r in bundles.filter("is_bundle").collect()} == bundle
    assert got["tax"]["source_mix"] == {"filename": 3, "parent": 2}
    assert got["pdf"]["noise_labels"] == ["format"]


def test_phrases_and_samples(evidence):
    _, phrases, _ = E.theme_evidence(evidence)
    got = {r["term"]: r for r in phrases.collect()}
    assert got["tax 2021"]["source_mix"] == {"phrase_path": 2} and got["tax 2021"]["raw_count"] == 4.0
    assert "tax tax" not in got and got["tax tax receipt"]["file_presence"] == 1
    sampled = E.with_samples(phrases, E.exploded_phrases(evidence, ["path", "base"]), 3)
    first = sampled.filter("term = 'games engine'").first() or sampled.filter("term = 'cache games'").first()
    inside = sorted(p for p in PATHS if p.startswith("games"))[:3]
    assert first["sample_paths"] == inside


def test_raw_counts_and_lists(evidence):
    counts = {r["term"]: r["files"] for r in E.raw_term_counts(evidence).collect()}
    assert counts["tax"] == 2 and counts["dll"] == 13
    singles, _, _ = E.theme_evidence(evidence)
    by_count, by_weight = sinks.theme_lists(singles)
    assert by_count.filter(F.col("line") == "receipt: 3").count() == 1
    assert by_weight.filter(F.col("line").rlike(r"^receipt\t\d+\.\d{4}$")).count() == 1


def test_noise_lists_are_extended():
    noise = T.NoiseTerms().merged(stopword=["Your", "into"])
    assert {"your", "into", "and"} <= set(noise.stopword)


def test_first_handoff_document(spark, inventory):
    import json

    from shelfmark.operators import rules as R
    from shelfmark.plans import handoff

    parts = P.with_parts(inventory(PATHS + ["proj/.git/HEAD", "t.tmp"]))
    evidence = E.file_evidence(parts)
    doc = json.loads(handoff.round_one(R.split_inventory(parts), evidence, note="my drive", terms=7).first()[0])
    assert doc["author_note"] == "my drive"
    assert (doc["drive_overview"]["files_total"], doc["drive_overview"]["needing"], doc["drive_overview"]["junk_files"]) == (19, 17, 1)
    weights = [t["adjusted_weight"] for t in doc["top_single_terms"]]
    assert len(weights) == 7 and weights == sorted(weights, reverse=True)
    assert all(len(t["sample_paths"]) <= 3 for t in doc["top_single_terms"])
    assert [c["cluster_root"] for c in handoff.bundle_roots(evidence).collect()] == ["games > engine > bin"]
    folder = doc["folder_map"][0]
    assert (folder["folder"], folder["files"], folder["top_types"], folder["sample_names"].count(";")) == ("games\\engine", 13, ".dll=13", 4)
    assert doc["file_type_table"][0]["type"] == ".dll"
