"""Main text of web pages: a classifier's costs and a minimum cut separate content blocks from boilerplate.

A page becomes a row of text blocks.  A logistic model gives each block a content probability; its costs are the capacities to the
two terminals.  Neighbours in page order and neighbours under one parent are tied by edges that weigh more the deeper they share
their elements.  The minimum cut labels the blocks.  The model is trained in numpy on the blocks of a bounded sample of pages, with
labels from their mark-up (article and main against navigation, asides, forms, footers and the like); each training row is
seen a second time without the article feature, so that pages without such mark-up are judged by their text.

Defined results: null or empty html gives an empty text; a page without content blocks too; white space inside a block is one space,
blocks are joined by one space in page order; repeated rows get equal texts; broken mark-up is read as far as it goes; an empty table
trains nothing and returns nothing; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.blocks import Block, Element, boiler_elements, parse
from shelfmark.llm.mincut import source_side

SAMPLE_PAGES = 300
SMOOTHNESS = 1.0
FEATURES = ("bias", "in_main", "boiler", "link_share", "log_chars", "sentence_end", "is_paragraph", "is_heading", "is_item", "start_of_page")


def describe(elements: list[Element], blocks: list[Block]) -> np.ndarray:
    boiler = boiler_elements(elements)
    rows = []
    for number, block in enumerate(blocks):
        tags = [elements[k].tag for k in block.chain[:3]]
        text = block.text
        rows.append((
            1.0, any(elements[k].tag in ("article", "main") for k in block.chain), any(boiler[k] for k in block.chain),
            min(1.0, block.linked / len(text)), min(6.0, np.log(len(text))) / 6, text[-1] in ".!?…:;\"'”", tags[:1] == ["p"],
            bool(tags) and tags[0][:1] == "h" and tags[0][1:].isdigit(), bool({"li", "td", "th"} & set(tags)), number / len(blocks) < 0.05))
    return np.array(rows, np.float64).reshape(len(blocks), len(FEATURES))


def fit(pages: list[str]) -> np.ndarray:
    """Logistic weights, by gradient descent with classes weighted evenly."""
    rows, labels = [], []
    for page in pages:
        x = describe(*parse(page))
        known = (x[:, 1] > 0) | (x[:, 2] > 0)
        rows.append(x[known])
        labels.append(1.0 - x[known][:, 2])
    x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
    y = np.concatenate(labels) if labels else np.zeros(0)
    weights = np.zeros(len(FEATURES))
    weights[1], weights[2] = 3.0, -9.0  # where nothing is labelled, mark-up alone decides
    if not 0 < y.sum() < len(y):
        return weights
    x = np.concatenate([x, x])
    x[len(y):, 1] = 0
    y = np.concatenate([y, y])
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(400):
        p = 1 / (1 + np.exp(-(x @ weights)))
        weights -= 2.0 * (x.T @ ((p - y) * share) + 1e-4 * weights)
    return weights


def _ties(elements: list[Element], blocks: list[Block], smoothness: float) -> list[tuple[int, int, float]]:
    edges, last_under = [], {}
    for i, block in enumerate(blocks):
        if i:
            shared = set(block.chain) & set(blocks[i - 1].chain)
            edges.append((i - 1, i, smoothness * len(shared) / max(len(block.chain), len(blocks[i - 1].chain), 1)))
        parent = elements[block.element].parent
        if parent in last_under and last_under[parent] != i - 1:
            edges.append((last_under[parent], i, smoothness * 0.5))
        last_under[parent] = i
    return edges


def main_text(source: str, weights: np.ndarray, smoothness: float = SMOOTHNESS) -> str:
    elements, blocks = parse(source)
    if not blocks:
        return ""
    score = np.clip(describe(elements, blocks) @ weights, -20, 20)
    as_boiler, as_content = np.logaddexp(0, score), np.logaddexp(0, -score)  # costs of the labels
    keep = source_side(as_boiler.tolist(), as_content.tolist(), _ties(elements, blocks, smoothness))
    return " ".join(block.text for block, kept in zip(blocks, keep, strict=True) if kept)


def training_pages(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> list[str]:
    """About `sample_pages` pages chosen by a hash of page_id, at most twice as many."""
    total = pages.count()
    place = F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = pages.where((place < min(1.0, sample_pages / max(total, 1))) & F.col("html").isNotNull())
    rows: pd.DataFrame = sample.select("page_id", "html").limit(2 * sample_pages).toPandas()
    return rows.sort_values(["page_id", "html"])["html"].tolist()


def extract(pages: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    weights = fit(training_pages(pages if training is None else training))

    def run(batches):
        for batch in batches:
            texts = [main_text(x or "", weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
