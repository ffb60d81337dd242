"""A gated recurrent language model in numpy: truncated backpropagation, softmax by groups, classes and words, state carried across windows."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    """``hidden`` units, ``classes`` of the output, ``window`` steps of backpropagation, ``lanes`` read side by side."""

    hidden: int = 24
    classes: int = 48
    window: int = 16
    lanes: int = 256
    rate: float = 0.12
    seed: int = 11


Params = dict[str, np.ndarray]


def class_borders(counts: np.ndarray, classes: int) -> np.ndarray:
    """Borders of classes of about equal mass over tokens sorted by falling count; every class holds one token at least."""
    n = len(counts)
    classes = min(classes, n)
    mass = np.cumsum(np.sqrt(counts.astype(np.float64) + 1))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1
    borders = np.r_[0, cuts, n]
    for i in range(1, classes):  # no empty class at the frequent end
        borders[i] = max(borders[i], borders[i - 1] + 1)
    for i in range(classes - 1, 0, -1):
        borders[i] = min(borders[i], borders[i + 1] - 1)
    return borders


#: Borders of the classes over tokens, and of the groups over classes.
Borders = tuple[np.ndarray, np.ndarray]


def start(counts: np.ndarray, s: Settings) -> tuple[Params, Borders]:
    """Fresh parameters whose outputs begin at the unigram shares. The last column of the weights of outputs is their bias."""
    rng = np.random.default_rng(s.seed)
    share = (counts + 1.0) / (counts.sum() + len(counts))
    classes = class_borders(counts, s.classes)
    of_class = np.add.reduceat(share, classes[:-1])
    groups = class_borders(np.add.reduceat(counts, classes[:-1]), math.isqrt(len(of_class)))
    of_group = np.add.reduceat(of_class, groups[:-1])
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    outputs = lambda share, of, borders: np.c_[draw(len(share), s.hidden), np.log(share / np.repeat(of, np.diff(borders)))].astype(np.float32)
    params = {
        "gates": draw(len(counts), 3 * s.hidden), "state": draw(s.hidden, 3 * s.hidden) + 0, "bias": np.zeros(3 * s.hidden, np.float32),
        "group_w": outputs(of_group, 1.0, np.array([0, len(of_group)])), "class_w": outputs(of_class, of_group, groups), "word_w": outputs(share, of_class, classes),
    }
    params["bias"][: s.hidden] = 1.0  # keep the state at first
    return params, (classes, groups)


def _sigmoid(x: np.ndarray) -> None:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)


def _step(weights: np.ndarray, given: np.ndarray, before: np.ndarray, own: np.ndarray, gates: np.ndarray, new: np.ndarray, state: np.ndarray) -> None:
    """One step of all lanes; a row is a unit, so that every operation runs over consecutive numbers. The last four are written to."""
    h = len(before)
    np.matmul(weights, before, out=own)
    np.add(own[: 2 * h], given[: 2 * h], out=gates)
    _sigmoid(gates)
    np.multiply(gates[h:], own[2 * h :], out=new)
    new += given[2 * h :]
    np.tanh(new, out=new)
    np.subtract(before, new, out=state)
    state *= gates[:h]
    state += new


#: Outputs worked out at once: they stay in the processor's cache, where exponentials cost a fraction.
ROOM = 1 << 15
#: Targets' logits down to the negative of this need no shift before exponentials; states lie between -1 and 1, so that others are rare.
LEAST_LOGIT = 60.0
#: Numbers of a parameter that a step changes at once, for the same reason.
CACHED = 32_768


class Buffers:
    """Arrays kept from window to window, since fresh large ones cost more than the sums written to them."""

    def __init__(self, params: Params):
        self.grads: Params = {k: np.zeros_like(v) for k, v in params.items() if k != "gates"}
        self.spare = {k: np.empty_like(v) for k, v in self.grads.items()}


def _level(
    weights: np.ndarray, borders: np.ndarray, parents: np.ndarray, children: np.ndarray, states: np.ndarray, room: np.ndarray, grad: np.ndarray | None, careful: bool = False,
) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each child given its parent (rows sorted by parent), with ``grad`` (written there) also the gradient of the loss in the states.

    Unless ``careful`` exponentials are taken of logits as they are, and all is worked out again if they are too large or too small for that.
    """
    cuts = np.searchsorted(parents, np.arange(len(borders)))
    met = (np.diff(cuts) > 0) & (np.diff(borders) > 1)
    if grad is not None:
        for c in np.flatnonzero(~met).tolist():
            grad[borders[c] : borders[c + 1]] = 0
    place = children - borders[parents]
    starts, ends = borders.tolist(), cuts.tolist()
    rows, ones = np.arange(len(states)), np.ones(int(np.diff(borders).max()), np.float32)
    value, total = np.zeros(len(states), np.float32), np.ones(len(states), np.float32)
    back = None if grad is None else np.zeros_like(states)
    for c in np.flatnonzero(met).tolist():
        low, high = starts[c], starts[c + 1]
        mine, size = weights[low:high], high - low
        turned = np.ascontiguousarray(mine.T)
        step = max(1, len(room) // size)
        for at in range(ends[c], ends[c + 1], step):
            upto = min(at + step, ends[c + 1])
            n, part, sums = upto - at, states[at:upto], total[at:upto]
            out = room[: n * size].reshape(n, size) if n * size <= len(room) else np.empty((n, size), np.float32)
            np.matmul(part, turned, out=out)
            if careful:
                out -= out.max(axis=1, keepdims=True)
            told = (rows[:n], place[at:upto])
            value[at:upto] = out[told]
            np.exp(out, out=out)
            np.matmul(out, ones[:size], out=sums)
            if grad is not None:
                out[told] -= sums
                shared = part / sums[:, None]
                if at == ends[c]:
                    np.matmul(out.T, shared, out=grad[low:high])
                else:
                    grad[low:high] += out.T @ shared
                np.matmul(out, mine, out=back[at:upto])
    if not careful and not (np.isfinite(total).all() and value.min(initial=0) > -LEAST_LOGIT):
        return _level(weights, borders, parents, children, states, room, grad, True)
    if back is not None:
        back /= total[:, None]
    return value - np.log(total), back


def _outputs(
    params: Params, borders: Borders, states: np.ndarray, targets: np.ndarray, grads: Params | None = None, mine: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each target, and with ``grads`` (written there) the gradient of the loss in the states. Rows not ``mine`` get zeros.

    ``states`` end with a one, which brings the bias. A target's group is told first, then its class in the group, then the word in the class.
    """
    classes, groups = borders
    kind = np.uint16 if len(classes) <= 1 << 16 else np.int64  # short numbers are sorted by digits
    class_of, group_of = (np.repeat(np.arange(len(x) - 1), np.diff(x)) for x in borders)
    counted = targets if mine is None else targets[mine]
    of = class_of[counted]
    order = np.argsort(of.astype(kind), kind="stable")
    of, words = of[order], counted[order]
    order = order if mine is None else mine[order]
    sorted_states, group = states.take(order, axis=0), group_of[of]
    gained, pulled = np.zeros(len(order), np.float32), None
    room = np.empty(ROOM, np.float32)
    top = np.array([0, len(groups) - 1])
    for name, over, parents, children in (("group_w", top, np.zeros(len(of), np.int64), group), ("class_w", groups, group, of), ("word_w", classes, of, words)):
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            more, back = _level(params[name], over, parents, children, sorted_states, room, None if grads is None else grads[name])
        gained += more
        pulled = back if pulled is None else np.add(pulled, back, out=pulled)
    logp = np.zeros(len(targets), np.float32)
    logp[order] = gained
    if pulled is None:
        return logp, None
    back = np.zeros(states.shape, np.float32)
    back[order] = pulled
    return logp, back


def _with_one(states: np.ndarray) -> np.ndarray:
    """``(steps, units, lanes)`` as one row per step and lane, with a one behind."""
    steps, h, lanes = states.shape
    out = np.ones((steps, lanes, h + 1), np.float32)
    out[:, :, :h] = states.transpose(0, 2, 1)
    return out.reshape(-1, h + 1)


def window_gradients(
    params: Params, borders: Borders, tokens: np.ndarray, targets: np.ndarray, fresh: np.ndarray, before: np.ndarray, counted: np.ndarray | None = None,
    buffers: Buffers | None = None,
) -> tuple[float, Params, np.ndarray]:
    """Loss (negative log-likelihood), gradients and last state of one window of ``(steps, lanes)``; ``fresh`` marks starts of documents.

    Targets that are not ``counted`` only move the state. With ``buffers`` the gradients lie there until the next call. ``gates`` gradients come as one row per step and lane, since most tokens do not occur in a window.
    """
    steps, lanes = tokens.shape
    h = before.shape[1]
    weights = np.ascontiguousarray(params["state"].T)
    held, own, gates, new, states = (np.empty((steps, n * h, lanes), np.float32) for n in (1, 3, 2, 1, 1))
    starts, given = [np.flatnonzero(f) for f in fresh], np.empty((lanes, 3 * h), np.float32)
    for t in range(steps):
        params["gates"].take(tokens[t], axis=0, out=given, mode="clip")
        given += params["bias"]
        held[t] = states[t - 1] if t else before.T
        held[t][:, starts[t]] = 0
        _step(weights, given.T, held[t], own[t], gates[t], new[t], states[t])
    buffers = buffers or Buffers(params)
    grads = dict(buffers.grads)
    mine = None if counted is None or counted.all() else np.flatnonzero(counted.reshape(-1))
    logp, pulled = _outputs(params, borders, _with_one(states), targets.reshape(-1), grads, mine)
    back = pulled.reshape(steps, lanes, h + 1)[:, :, :h].transpose(0, 2, 1)
    rows, through = np.empty((3 * h, steps, lanes), np.float32), np.empty((3 * h, lanes), np.float32)
    later, rest, spare = np.zeros((h, lanes), np.float32), np.empty((h, lanes), np.float32), np.empty((h, lanes), np.float32)
    one = np.float32(1)
    grads["state"].fill(0)
    for t in range(steps - 1, -1, -1):
        keep, reset = gates[t, :h], gates[t, h:]
        to_keep, to_reset, to_new = rows[:h, t], rows[h : 2 * h, t], rows[2 * h :, t]
        later += back[t]
        np.subtract(one, keep, out=rest)
        rest *= later
        np.subtract(held[t], new[t], out=to_keep)  # later * (held - new) * keep * (1 - keep)
        to_keep *= keep
        to_keep *= rest
        np.multiply(new[t], new[t], out=spare)  # later * (1 - keep) * (1 - new^2)
        np.subtract(one, spare, out=to_new)
        to_new *= rest
        np.subtract(one, reset, out=to_reset)  # to_new * own * reset * (1 - reset)
        to_reset *= own[t, 2 * h :]
        np.multiply(to_new, reset, out=through[2 * h :])
        to_reset *= through[2 * h :]
        through[:h], through[h : 2 * h] = to_keep, to_reset
        grads["state"] += held[t] @ through.T
        later *= keep
        later += params["state"] @ through
        later[:, starts[t]] = 0
    grads["bias"] = rows.reshape(3 * h, -1).sum(axis=1)
    grads["gates"] = rows.reshape(3 * h, -1).T
    return -float(logp.sum(dtype=np.float64)), grads, states[-1].T


def squares_of(params: Params) -> Params:
    """Sums of squared gradients before the first step."""
    return {k: np.full_like(v, 1e-6) for k, v in params.items()}


def train(
    params: Params, borders: Borders, streams: list[np.ndarray], end: int, s: Settings, epochs: int = 1, rate: float | None = None,
    leads: list[int] | None = None, squares: Params | None = None,
) -> float:
    """Train in place over documents of token ids (each closed by ``end``); returns the mean loss of the last epoch.

    Documents are laid end to end and dealt to lanes; the state runs on from window to window and starts anew with a document.
    Every token is learned, but for the first ``leads`` of a stream (the tokens before a later piece of a document), which only
    bring the state there. With ``squares`` the sums of earlier calls go on, in place, and the rate is not lowered besides.
    """
    leads = leads or [0] * len(streams)
    streams, leads = [x for x in streams if len(x)], [n for x, n in zip(streams, leads, strict=True) if len(x)]
    if not streams:
        return 0.0
    rng = np.random.default_rng(s.seed)
    lowered = squares is None
    squares = squares_of(params) if squares is None else squares
    rate, loss, count = s.rate if rate is None else rate, 0.0, 0
    total = epochs * sum(map(len, streams))
    done = 0
    buffers = Buffers(params)
    for _ in range(epochs):
        order = rng.permutation(len(streams))
        size = sum(map(len, streams))
        lanes = min(s.lanes, max(1, size // s.window))
        length = -(-size // lanes)
        targets = np.full(lanes * length, end, np.int32)
        targets[:size] = np.concatenate([streams[i] for i in order])
        fresh, counted = np.zeros(lanes * length, bool), np.arange(lanes * length) < size
        starts = np.cumsum([0] + [len(streams[i]) for i in order[:-1]])
        fresh[starts] = True
        for i, at in zip(order, starts, strict=True):
            counted[at : at + leads[i]] = False
        tokens = np.r_[end, targets[:-1]].astype(np.int32)
        tokens, targets, fresh, counted = (x.reshape(lanes, length).T for x in (tokens, targets, fresh, counted))
        state, loss, count = np.zeros((lanes, s.hidden), np.float32), 0.0, 0
        for at in range(0, length, s.window):
            part = slice(at, at + s.window)
            part_loss, grads, state = window_gradients(params, borders, tokens[part], targets[part], fresh[part], state, counted[part], buffers)
            loss, count = loss + part_loss, count + int(counted[part].sum())
            done += tokens[part].size
            _update(params, squares, grads, tokens[part].reshape(-1), rate * max(0.1, 1 - done / total) if lowered else rate, buffers.spare)
    return loss / max(1, count)


def _update(params: Params, squares: Params, grads: Params, tokens: np.ndarray, rate: float, spare: Params) -> None:
    """Gradient steps with rates adapted per parameter."""
    rows = grads.pop("gates")
    place = np.bincount(tokens, minlength=len(params["gates"]))
    distinct = np.flatnonzero(place)
    place[distinct] = np.arange(len(distinct))
    place = place[tokens]
    summed = np.empty((len(distinct), rows.shape[1]), np.float32)
    for unit in range(rows.shape[1]):
        summed[:, unit] = np.bincount(place, rows[:, unit])
    own = squares["gates"][distinct] + summed * summed
    squares["gates"][distinct] = own
    params["gates"][distinct] -= rate * summed / np.sqrt(own)
    for k, g in grads.items():
        flat = [x.reshape(-1) for x in (g, squares[k], params[k], spare[k])]
        for at in range(0, len(flat[0]), CACHED):  # all steps on a run of numbers while they are in the cache
            slope, square, value, room = (x[at : at + CACHED] for x in flat)
            np.multiply(slope, slope, out=room)
            square += room
            np.sqrt(square, out=room)
            np.divide(slope, room, out=room)
            room *= np.float32(rate)
            value -= room


#: Tokens whose outputs are worked out together when scoring, so that each class is met with many.
SCORED = 65_536


def score(params: Params, borders: Borders, streams: list[np.ndarray], end: int, lanes: int = 512, window: int | None = None) -> np.ndarray:
    """Natural log-probability of each whole document (ids closed by ``end``).

    Documents are packed into lanes of about equal length, longest first, as many lanes as keep step with the longest document;
    shorter lanes drop out when they end. The state is carried over all windows of a document, of ``SCORED`` tokens unless told.
    """
    out = np.zeros(len(streams))
    sizes = np.array([len(x) for x in streams], np.int64)
    if not sizes.sum():
        return out
    lanes = max(1, min(lanes, len(streams), max(16, -(-int(sizes.sum()) // int(sizes.max())))))
    held: list[list[int]] = [[] for _ in range(lanes)]
    filled = [(0, i) for i in range(lanes)]
    for i in np.argsort(-sizes, kind="stable"):
        size, lane = heapq.heappop(filled)
        held[lane].append(int(i))
        heapq.heappush(filled, (size + int(sizes[i]), lane))
    held.sort(key=lambda docs: -sum(int(sizes[i]) for i in docs))
    lengths = np.array([sum(int(sizes[i]) for i in docs) for docs in held])
    longest = int(lengths[0])
    tokens, targets = np.full((longest, lanes), end, np.int32), np.full((longest, lanes), end, np.int32)
    fresh, owner = np.zeros((longest, lanes), bool), np.full((longest, lanes), -1, np.int32)
    for lane, docs in enumerate(held):
        at = 0
        for i in docs:
            n = len(streams[i])
            if n:
                targets[at : at + n, lane], tokens[at + 1 : at + n, lane] = streams[i], streams[i][:-1]
                fresh[at, lane], owner[at : at + n, lane] = True, i
                at += n
    h = params["state"].shape[0]
    weights, table = np.ascontiguousarray(params["state"].T), params["gates"] + params["bias"]
    state = np.zeros((h, lanes), np.float32)
    at = 0
    while at < longest:
        active = int((lengths > at).sum())
        steps = min(window or max(16, SCORED // active), longest - at)
        states = np.empty((steps, h, active), np.float32)
        own, gates, new = (np.empty((n * h, active), np.float32) for n in (3, 2, 1))
        state = state[:, :active].copy()
        for t in range(steps):
            state[:, np.flatnonzero(fresh[at + t, :active])] = 0
            _step(weights, table.take(tokens[at + t, :active], axis=0).T, state, own, gates, new, states[t])
            state[:] = states[t]
        mine = owner[at : at + steps, :active].reshape(-1)
        real = np.flatnonzero(mine >= 0)
        logp, _ = _outputs(params, borders, _with_one(states), targets[at : at + steps, :active].reshape(-1), mine=real)
        out += np.bincount(mine[real], weights=logp[real].astype(np.float64), minlength=len(streams))
        at += steps
    return out
