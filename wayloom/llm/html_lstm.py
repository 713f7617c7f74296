"""Main-text extraction by a recurrent block labeller in numpy.

A page is cut into leaf blocks (html_blocks). Each block's hashed tag-path and
word vectors and some numbers go through a bidirectional LSTM over the page's
whole sequence, and each block is labelled main text or not with the context of
all others. The weights come from html_training.py, which trains them on
generated pages.

Cases: null and empty pages and pages without main blocks give an empty text;
pages of any length are read whole. Other columns pass through; columns
main_text and n_blocks are replaced.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, map_arrow, with_fields
from .html_blocks import NUMBERS, PATH_SLOTS, WORD_SLOTS, blocks, feature_arrays

WEIGHTS = os.path.join(os.path.dirname(__file__), "html_lstm.npz")
PATH_SIZE, WORD_SIZE, HIDDEN = 12, 6, 16
INPUT = PATH_SIZE + WORD_SIZE + NUMBERS
TOGETHER = 64  # pages of similar length that step through the network together


def fresh_weights(seed: int) -> dict[str, np.ndarray]:
    """Embeddings start at 0, so slots that training never meets stay neutral."""
    rng = np.random.default_rng(seed)
    out = {"path": np.zeros((PATH_SLOTS, PATH_SIZE)), "word": np.zeros((WORD_SLOTS, WORD_SIZE)), "out": rng.normal(0, 0.3, 2 * HIDDEN), "out_b": np.zeros(1)}
    for d in ("f", "b"):
        out[d + "x"] = rng.normal(0, 0.3, (INPUT, 4 * HIDDEN))
        out[d + "h"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        out[d + "c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in out.items()}


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def mean_by(table, slots, owner, n):
    """Mean of the slots' vectors for each of n owners, and each owner's count."""
    count = np.maximum(np.bincount(owner, minlength=n), 1).astype(np.float32)
    sums = np.stack([np.bincount(owner, weights=table[slots, k], minlength=n) for k in range(table.shape[1])], axis=1) if len(slots) else np.zeros((n, table.shape[1]))
    return (sums / np.sqrt(count)[:, None]).astype(np.float32), count


def run_lstm(x, mask, wx, wh, bias, keep=False):
    """x: (time, pages, INPUT); mask: (time, pages). The hidden states, and all that backpropagation needs."""
    steps, pages, _ = x.shape
    h = c = np.zeros((pages, HIDDEN), dtype=np.float32)
    given, out, saved = x @ wx + bias, np.zeros((steps, pages, HIDDEN), dtype=np.float32), []
    for t in range(steps):
        z = given[t] + h @ wh
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            saved.append((i, f, o, g, c, tc, h, m))
        c, h = m * c_new + (1 - m) * c, m * (o * tc) + (1 - m) * h
        out[t] = h
    return out, saved


def scores(pages: list[list], w: dict) -> list[np.ndarray]:
    """The logit of main text for each block of each page."""
    out: list = [None] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    for k in range(len(pages)):
        if not pages[k]:
            out[k] = np.zeros(0, dtype=np.float32)
    for start in range(0, len(order), TOGETHER):
        group = order[start : start + TOGETHER]
        x, mask = inputs([pages[k] for k in group], w)[:2]
        fwd, _ = run_lstm(x, mask, w["fx"], w["fh"], w["fc"])
        bwd, _ = run_lstm(x[::-1], mask[::-1], w["bx"], w["bh"], w["bc"])
        logit = np.concatenate([fwd, bwd[::-1]], axis=2) @ w["out"] + w["out_b"]
        for col, k in enumerate(group):
            out[k] = logit[: len(pages[k]), col]
    return out


def inputs(pages: list[list], w: dict):
    path, path_of, word, word_of, numbers = feature_arrays(pages)
    n, lengths = len(numbers), [len(p) for p in pages]
    pv, pn = mean_by(w["path"], path, path_of, n)
    wv, wn = mean_by(w["word"], word, word_of, n)
    flat = np.concatenate([pv, wv, numbers], axis=1)
    time = np.concatenate([np.arange(m) for m in lengths])
    page = np.repeat(np.arange(len(pages)), lengths)
    x = np.zeros((max(lengths), len(pages), INPUT), dtype=np.float32)
    mask = np.zeros((max(lengths), len(pages)), dtype=np.float32)
    x[time, page], mask[time, page] = flat, 1
    return x, mask, time, page, (path, path_of, pn, word, word_of, wn)


def load_weights(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def main_texts(pages: list[str | None], w: dict) -> list[tuple[str, int]]:
    cut = [blocks(p) if p else [] for p in pages]
    return [("\n\n".join(b[1] for b, s in zip(bs, ss, strict=True) if s > 0), len(bs)) for bs, ss in zip(cut, scores(cut, w), strict=True)]


def extract(pages: DataFrame, html: str = "html", weights: dict | None = None) -> DataFrame:
    """pages with main_text and n_blocks (leaf blocks read)."""
    shipped = pages.sparkSession.sparkContext.broadcast(weights or load_weights())  # of fixed size
    pages = pages.drop("main_text", "n_blocks")
    names, at = pages.columns, pages.columns.index(html)

    def run(frames):
        w = shipped.value
        for frame in frames:
            texts = [x for part in batches(iter(frame.column(at).to_pylist()), 512) for x in main_texts(part, w)]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array([t for t, _ in texts], pa.string()), pa.array([n for _, n in texts], pa.int64())], names=[*names, "main_text", "n_blocks"])

    return map_arrow(pages, run, with_fields(pages.schema, main_text="string", n_blocks="long"))
