"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A block's features are the tags and class names of the elements around it and simple measures of its text. The field is
trained in numpy on labelled pages, by gradient steps on the likelihood of whole label sequences (forward-backward), and
decoded by Viterbi. Extraction is a map over whole pages.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.dom import Block, Element, blocks
from memspark.llm.labelled_pages import labelled_pages

#: Labelled pages that a fit uses, steps, and weight decay.
PAGES, STEPS, DECAY = 1000, 200, 2e-4


@dataclass
class Field:
    weights: dict[str, float]  # of a feature, for main text
    start: tuple[float, float]
    change: tuple[tuple[float, float], tuple[float, float]]


def _own_features(e: Element) -> list[str]:
    """What an element adds to the features of the elements around it."""
    return [f"in:{e.tag}"] * e.fresh_tag + [f"name:{x}" for x in e.fresh_marks]


def _last_features(e: Element | None) -> list[str]:
    """What only the innermost elements tell."""
    own, nearest, near = (e.own, e.nearest, e.near) if e else ("-", "-", ())
    return [f"own:{own}", f"nearest:{nearest}", *[f"near:{x}" for x in near]]


def context_features(around: Element | None) -> list[str]:
    """Of the elements around a block."""
    out, e = _last_features(around), around
    while e:
        out += _own_features(e)
        e = e.parent
    return out


class _ContextWeights:
    """Summed weights of the elements around blocks, once per element."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.chain, self.whole = weights, {None: 0.0}, {}

    def _of(self, features: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def __call__(self, around: Element | None) -> float:
        if around not in self.whole:
            path, e = [], around
            while e not in self.chain:
                path.append(e)
                e = e.parent
            for inner in reversed(path):
                self.chain[inner] = self.chain[inner.parent] + self._of(_own_features(inner))
            self.whole[around] = self.chain[around] + self._of(_last_features(around))
        return self.whole[around]


def text_features(b: Block) -> list[str]:
    length = min(7, int(math.log2(b.words + 1)))
    share = b.linked / max(1, b.words)
    linked = 0 if share == 0 else 1 if share < 0.5 else 2
    out = ["bias", f"words:{length}", f"linked:{linked}", f"words:{length}/{linked}", f"ends:{b.text[-1] in '.!?'}"]
    return [*out, "copyright"] if "©" in b.text else out


def fit(pages: list[tuple[str, list[bool]]], steps: int = STEPS, decay: float = DECAY, rate: float = 0.1) -> Field:
    """Fit on pages with a label per block. Pages whose number of blocks and labels differ are an error."""
    ids: dict[str, int] = {}
    sequences, flat, at, labels = [], [], [], []
    for page, truth in pages:
        found = blocks(page)
        if len(found) != len(truth):
            raise ValueError(f"{len(found)} blocks, {len(truth)} labels")
        if found:
            sequences.append(len(found))
            for b, y in zip(found, truth, strict=True):
                row = [ids.setdefault(f, len(ids)) for f in context_features(b.around) + text_features(b)]
                flat += row
                at.append(len(row))
                labels.append(int(y))
    flat, starts, y = np.array(flat), np.cumsum([0, *at[:-1]]), np.array(labels)
    owner = np.repeat(np.arange(len(at)), at)
    n, lengths = len(sequences), np.array(sequences)
    first = np.cumsum(lengths) - lengths
    page = np.repeat(np.arange(n), lengths)
    step_of = np.arange(len(y)) - first[page]
    longest = int(lengths.max())
    w, s, c = np.zeros(len(ids)), np.zeros(2), np.zeros((2, 2))
    theta = np.zeros(len(ids) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen_change = np.zeros((2, 2))
    inner = step_of > 0
    np.add.at(seen_change, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    seen_start = np.bincount(y[first], minlength=2)
    for step in range(1, steps + 1):
        w, s, c = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        e = np.full((n, longest, 2), 0.0)
        e[page, step_of, 1] = np.add.reduceat(w[flat], starts)
        on = np.arange(longest)[None, :] < lengths[:, None]
        a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        a[:, 0] = s + e[:, 0]
        for t in range(1, longest):
            x = a[:, t - 1, :, None] + c
            a[:, t] = np.where(on[:, t, None], np.logaddexp(x[:, 0], x[:, 1]) + e[:, t], a[:, t - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            x = c + (e[:, t + 1] + b[:, t + 1])[:, None, :]
            b[:, t] = np.where(on[:, t + 1, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0.0)
        marginal = np.exp(a + b - z[:, None, None])
        g_w = np.bincount(flat, (marginal[page, step_of, 1] - y)[owner], len(ids))
        pair = np.exp(a[:, :-1, :, None] + c + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        g_c = (pair * on[:, 1:, None, None]).sum((0, 1)) - seen_change
        g_s = marginal[:, 0].sum(0) - seen_start
        g = np.concatenate([g_w, g_s, g_c.ravel()]) / n + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    w, s, c = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
    return Field({f: float(w[i]) for f, i in ids.items()}, tuple(s), tuple(map(tuple, c)))


@lru_cache(1)
def default_field() -> Field:
    return fit(labelled_pages(PAGES))


def decode(field: Field, found: list[Block]) -> list[bool]:
    """The likeliest labels of a page's blocks (Viterbi); ties go to no main text."""
    if not found:
        return []
    (c00, c01), (c10, c11) = field.change
    back = []
    zero, one = field.start
    context = _ContextWeights(field.weights)
    for i, b in enumerate(found):
        e = context(b.around) + sum(field.weights.get(f, 0.0) for f in text_features(b))
        if i:
            from0, from1 = zero + c01, one + c11
            stay, leave = zero + c00, one + c10
            back.append((leave > stay, from1 > from0))
            zero, one = max(stay, leave), max(from0, from1) + e
        else:
            one += e
    label = one > zero
    out = [label]
    for was0, was1 in reversed(back):
        label = was1 if label else was0
        out.append(label)
    return out[::-1]


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, decode(field, found), strict=True) if keep)


def extract(df: DataFrame, html: str, field: Field | None = None, name: str = "text") -> DataFrame:
    """All columns of ``df`` and the main text in ``name`` (which replaces a column of that name): the blocks decoded as main
    text, joined by newlines, empty if there are none. A null or empty page has none; rows are independent, so repeated rows
    get equal texts. Pages are read whole."""
    field = field or default_field()

    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, field) for p in pages], dtype=object)

    return df.withColumn(name, extracted(F.col(html).cast("string")))
