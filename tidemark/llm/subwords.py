"""Bags of hashed subwords: averaged embeddings under a linear softmax, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.llm.common import text_slices

#: Characters of text whose subwords are held at once.
AT_ONCE = 1 << 19
SPACE = 32
#: Letters stay, every other ASCII byte becomes a space; bytes of longer characters stay.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else SPACE for b in range(256))
SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``lengths``: bytes of a subword, word borders included; ``bits``: log2 of the hash buckets; ``dim``: of the embeddings.

    ``distinct``: a subword counts once per text, however often it comes; ``prior``: empty subwords averaged along, so that a
    few subwords alone decide little.
    """

    lengths: tuple[int, ...] = (2, 3, 4)
    bits: int = 16
    dim: int = 16
    epochs: int = 5
    rate: float = 0.3
    seed: int = 7
    distinct: bool = False
    prior: float = 0.0


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(PLAIN)


def buckets(texts: list[str], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each subword length ``(bucket, owner)``: hashed subwords of all texts in order, and the text each belongs to.

    A subword lies inside a word or touches a border with its first or last byte, never crosses one.
    """
    parts = [plain(t) for t in texts]
    joined = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    starts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]]) if parts else np.zeros(0, np.int64)
    letter = joined != SPACE
    out = []
    for n in settings.lengths:
        count = len(joined) - n + 1
        if count <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(len(starts), np.int64)))
            continue
        inside = np.ones(count, bool) if n > 2 else letter[:count] | letter[1 : count + 1]
        for k in range(1, n - 1):
            inside &= letter[k : count + k]
        at = np.flatnonzero(inside)
        packed = np.full(len(at), n, np.uint64)
        for k in range(n):
            packed = packed << np.uint64(8) | joined[at + k].astype(np.uint64)
        hashed = ((packed * SPREAD) >> np.uint64(64 - settings.bits)).astype(np.int64)
        out.append((hashed, np.searchsorted(at, starts)))
    return out


def means(texts: list[str], table: np.ndarray, settings: Settings) -> np.ndarray:
    """Mean of the table rows over the subwords of each text; ``table`` has a row per bucket. Some texts are worked on at a time."""
    parts = [_means(group, table, settings) for _, group in text_slices(texts, AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros((0, table.shape[1]))


def _means(texts: list[str], table: np.ndarray, settings: Settings) -> np.ndarray:
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    columns = [np.ascontiguousarray(table[:, c]) for c in range(table.shape[1])]
    last = np.empty(len(table), np.int64) if settings.distinct else None
    for hashed, first in buckets(texts, settings):
        if last is not None:
            hashed, first = _distinct(hashed, first, last)
        sizes = np.diff(np.r_[first, len(hashed)])
        count += sizes
        full = sizes > 0
        for c, column in enumerate(columns):
            if full.any():
                total[full, c] += np.add.reduceat(column[hashed], first[full], dtype=np.float64)
    return total / np.maximum(count + settings.prior, 1)[:, None]


def _distinct(hashed: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with each bucket once per text. ``last`` is scratch space, one place per bucket."""
    kept = np.empty(len(hashed), bool)
    ends = np.r_[first[1:], len(hashed)]
    for start, end in zip(first.tolist(), ends.tolist(), strict=True):
        mine, place = hashed[start:end], np.arange(end - start)
        last[mine] = place
        kept[start:end] = last[mine] == place
    before = np.r_[0, np.cumsum(kept)]
    return hashed[kept], before[first]


def bags(texts: list[str], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(distinct buckets, share of each)`` of each text, in small types."""
    return [bag for _, group in text_slices(texts, AT_ONCE) for bag in _bags(group, settings)]


def _bags(texts: list[str], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    found = buckets(texts, settings)
    out = []
    for i in range(len(texts)):
        mine = [h[f[i] : f[i + 1] if i + 1 < len(f) else len(h)] for h, f in found]
        if settings.distinct:  # once for each length, as when scoring
            mine = [np.unique(h) for h in mine]
        kinds, counts = np.unique(np.concatenate(mine), return_counts=True)
        out.append((kinds.astype(np.int32), (counts / max(1, counts.sum() + settings.prior)).astype(np.float32)))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, classes: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Train embeddings and softmax together, one text at a step with rates adapted per row.

    Returns the class scores per bucket (embedding times weights) and the bias: the score of a text is the mean of its
    subwords' scores plus the bias. Deterministic for a given order of texts.
    """
    rng = np.random.default_rng(settings.seed)
    emb = rng.uniform(-1, 1, (1 << settings.bits, settings.dim)).astype(np.float32) / settings.dim
    weights, bias = rng.normal(0, 0.3, (settings.dim, classes)).astype(np.float32), np.zeros(classes, np.float32)
    emb_sq, weights_sq, bias_sq = np.full(1 << settings.bits, 1e-8, np.float32), np.full(weights.shape, 1e-8, np.float32), np.full(classes, 1e-8, np.float32)
    data = bags(texts, settings)
    steps = settings.epochs * len(data)
    for step, i in enumerate(np.concatenate([rng.permutation(len(data)) for _ in range(settings.epochs)]) if steps else ()):
        rate = settings.rate * (1 - step / steps)
        at, share = data[i]
        if not len(at):
            continue
        hidden = share @ emb[at]
        error = softmax(hidden @ weights + bias)
        error[labels[i]] -= 1
        back = weights @ error
        grad_w = np.outer(hidden, error)
        weights_sq += grad_w * grad_w
        weights -= rate * grad_w / np.sqrt(weights_sq)
        bias_sq += error * error
        bias -= rate * error / np.sqrt(bias_sq)
        emb_sq[at] += share * share * float(back @ back) / settings.dim
        emb[at] -= (rate * share / np.sqrt(emb_sq[at]))[:, None] * back
    return emb @ weights, bias


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The scale of the logits under which held-back labels are likeliest."""
    grid = np.exp(np.linspace(-4, 4, 81))
    loss = [-np.log(softmax(logits * t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))]) if len(labels) else 1.0
