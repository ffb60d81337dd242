"""What the language model works out for a token, and its words by Arrow's kernels."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import gru, lm
from tidemark.llm.common import words_of


def test_outputs_of_a_token_are_few():
    """Under Zipf's law a token of 32,768 words once cost 112 classes and 103 words."""
    counts = np.sort((1e7 / np.arange(1, 32_771)).astype(np.int64))[::-1]
    _, (classes, groups) = gru.start(counts, gru.Settings(classes=lm._classes(len(counts))))
    share = counts / counts.sum()
    of_class = np.add.reduceat(share, classes[:-1])
    of_group = np.add.reduceat(of_class, groups[:-1])
    outputs = len(of_group) + of_group @ np.diff(groups) + of_class @ np.diff(classes)
    assert outputs < 110
    assert classes[-1] == len(counts) and groups[-1] == len(classes) - 1 and min(np.diff(classes).min(), np.diff(groups).min()) >= 1


@pytest.mark.parametrize("scale", [1.0, 400.0])
def test_large_logits_still_add_up_to_one_and_have_gradients(scale):
    params, borders = gru.start(np.arange(40, 0, -1), gru.Settings(hidden=5, classes=9))
    rng = np.random.default_rng(3)
    for k in ("group_w", "class_w", "word_w"):
        params[k][:, :-1] = rng.normal(0, scale, params[k][:, :-1].shape)
    states = np.c_[np.tile(rng.uniform(-1, 1, 5), (40, 1)), np.ones(40)].astype(np.float32)
    grads = gru.Buffers(params).grads
    logp, back = gru._outputs(params, borders, states, np.arange(40), grads)
    assert np.isfinite(logp).all() and np.isfinite(back).all() and all(np.isfinite(grads[k]).all() for k in ("group_w", "class_w", "word_w"))
    assert np.exp(logp.astype(float)).sum() == pytest.approx(1.0, abs=1e-3)


def test_words_are_those_of_the_contract():
    texts = [None, "", " \t", "A bÄ İ", "\x1ca\x0bb\x0cc\x85d e f ", " x  y\r\nz", "a a A"]
    wanted = [words_of(t) for t in texts]
    table = pa.table({"text": pa.array(texts, pa.string())})
    words, sizes = lm._words(table.column("text"))
    assert [w.encode() for w in words.to_pylist()] == [w for x in wanted for w in x] and sizes.tolist() == [len(x) for x in wanted]
    known = lm.Vocabulary(["a", "x", "z"], [9, 5, 3], 20, 4, 7, 2)
    streams = known.streams(known.ranks(words), sizes)
    assert [s.tolist() for s in streams] == [known.tokens_of(known.ranks(x)).tolist() for x in wanted]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_runs_hold_every_row_once_in_order(most):
    texts = ["a" * n if n % 4 else None for n in range(30)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 10)), pa.array(texts[i : i + 10], pa.string())], names=["i", "t"]) for i in (0, 10, 20)]
    runs = list(lm._runs(iter(batches), 1, most))
    assert [r for x in runs for r in x.column("i").to_pylist()] == list(range(30)) and len(runs) <= math.ceil(30 / 1)
    assert most < 1000 or len(runs) == 1
