"""A causal self-attention model over subword classes, in numpy.

One masked attention layer with a residual path reads a window of subwords and gives the
class of the next one; inside its class a subword has its share of the corpus counts.
So probabilities of whole texts add up to one, and no step works over all subwords.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

CLASSES = 64
WIDTH = 16
WINDOW, OVERLAP = 16, 4
OWN_INPUTS = 2048  # subwords with an input vector of their own; others share that of their class
BATCH = 256
PART = 128  # windows of a batch that are worked on at once
SLICE = 256  # rows of a product; numpy's library has quicker products for matrices of this size

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Subwords:
    """Classes and shares of subwords. The last id ends a text and begins the next."""

    klass: np.ndarray
    share: np.ndarray  # log10 of the subword's share of its class
    input: np.ndarray
    class_share: np.ndarray

    @property
    def end(self) -> int:
        return len(self.klass) - 1

    @property
    def inputs(self) -> int:
        return int(self.input.max()) + 1


def subword_classes(counts: np.ndarray, opens: np.ndarray, classes: int = CLASSES) -> Subwords:
    """``counts``: of each id in the corpus, the end last; ``opens``: does the id begin a word?

    Ids of one kind are sorted by count and cut into classes of about equal counts, so a
    frequent id has a class of its own. The end is a class by itself.
    """
    n, klass, next_ = len(counts), np.zeros(len(counts), dtype=np.int64), 0
    mass = counts[:-1] + 0.5
    kinds = [np.flatnonzero(opens[:-1]), np.flatnonzero(~opens[:-1])]
    for k, ids in enumerate(kinds):
        if not len(ids):
            continue
        room = classes - 1 - next_ if k else max(1, min(classes - 2, round((classes - 1) * mass[ids].sum() / mass.sum())))
        ids = ids[np.argsort(-mass[ids], kind="stable")]
        left, i = mass[ids].sum(), 0
        for c in range(room):
            if i >= len(ids):
                break
            goal, at = left / (room - c), i
            total = 0.0
            while at < len(ids) and (at == i or total + mass[ids[at]] / 2 <= goal or c == room - 1):
                total += mass[ids[at]]
                at += 1
            klass[ids[i:at]] = next_
            next_, left, i = next_ + 1, left - total, at
    klass[-1] = next_
    smooth = counts + 0.5
    total = np.bincount(klass, weights=smooth)
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(n)
    own = np.minimum(OWN_INPUTS, n)
    return Subwords(klass, np.log10(smooth / total[klass]), np.where(rank < own, rank, own + klass), total / total.sum())


def first_weights(subwords: Subwords, seed: int = 11) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale=0.1: rng.normal(scale=scale, size=shape).astype(np.float32)
    return {
        "input": draw(subwords.inputs, WIDTH), "place": draw(WINDOW, WIDTH, scale=0.02),
        "qkv": draw(WIDTH, 3 * WIDTH, scale=0.25), "out": draw(WIDTH, WIDTH, scale=0.05),
        "classes": draw(WIDTH, len(subwords.class_share)), "bias": np.log(subwords.class_share).astype(np.float32),
    }


@dataclass
class Windows:
    """Flat subword sequences cut into overlapping windows.

    ``input``, ``target``: per place; ``at``: (window, place) into them; ``used``: which
    places are scored there. Every place is scored in exactly one window, after at least
    ``overlap`` others unless its sequence begins there.
    """

    input: np.ndarray
    target: np.ndarray
    at: np.ndarray
    used: np.ndarray
    valid: np.ndarray


def windows(subwords: Subwords, ids: np.ndarray, first: np.ndarray, overlap: int = OVERLAP) -> Windows:
    """``ids``: all sequences one after another, each with its end; ``first``: where each begins, and the total."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1]] = subwords.end
    length = np.diff(first)
    step = WINDOW - overlap
    count = np.where(length > WINDOW, 1 + -(-(length - WINDOW) // step), 1)
    owner = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = nth[:, None] * step + np.arange(WINDOW)
    valid = place < length[owner][:, None]
    used = valid & ((np.arange(WINDOW) >= overlap) | (nth == 0)[:, None])
    at = first[owner][:, None] + np.where(valid, place, 0)
    return Windows(subwords.input[before], ids, at, used, valid)


_SEEN = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))
_TWO = np.float32(np.log2(np.e))  # powers are of two, which are much faster than those of e
_LOW = -80 * _TWO  # powers below would leave the range of single precision
_LEAST, _MOST = 1e-34, 1e34
_SCALE = WIDTH**-0.5


def _parts(y: np.ndarray) -> list[np.ndarray]:
    """The rows as a stack of matrices of ``SLICE`` rows, and what is left over as one of fewer."""
    rows, whole = y.reshape(-1, y.shape[-1]), y.size // y.shape[-1] // SLICE * SLICE
    return [rows[:whole].reshape(-1, SLICE, y.shape[-1]), rows[whole:][None]]


def _product(y: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each row times a matrix, in slices: products of small matrices are much faster."""
    if y.size % (SLICE * y.shape[-1]) == 0:
        return np.matmul(y.reshape(-1, SLICE, y.shape[-1]), by).reshape(*y.shape[:-1], by.shape[1])
    out = np.empty((*y.shape[:-1], by.shape[1]), np.result_type(y, by))
    for part, to in zip(_parts(y), _parts(out), strict=True):
        if part.size:
            np.matmul(part, by, out=to)
    return out


def _summed_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rows of ``x`` times those of ``y``, summed over all rows."""
    return sum(np.matmul(_turned(a), b).sum(axis=0) for a, b in zip(_parts(x), _parts(y), strict=True) if a.size or not x.size)


def _row_sums(values: np.ndarray, columns: int = 1) -> np.ndarray:
    """As a product with ones, which is much faster than adding along short rows; the sum stands in each column."""
    return _product(values, np.ones((values.shape[-1], columns), values.dtype))


def _powers(exponents: Callable[[], np.ndarray], seen: np.ndarray | None = None) -> np.ndarray:
    """Powers of two, and zero where not ``seen``."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = exponents()
        np.exp2(out, out=out)
        if seen is not None:
            out *= seen
    return out


def _steady(exponents: Callable[[], np.ndarray], seen: np.ndarray | None = None) -> Callable[[], np.ndarray]:
    """The exponents less their row's largest, whose powers stay in the range."""

    def less() -> np.ndarray:
        y = exponents()
        most = (y if seen is None else np.where(seen > 0, y, -np.inf)).max(axis=-1, keepdims=True)
        return np.clip(y - most, _LOW, 0)

    return less


def _fits(sums: np.ndarray) -> bool:
    """Are all in the range in which quotients are exact? Not if one is no number."""
    return not sums.size or bool(sums.min() > _LEAST and sums.max() < _MOST)


def _turned(y: np.ndarray) -> np.ndarray:
    """Each window's matrix transposed, in memory too: products of small matrices are much faster so."""
    return np.ascontiguousarray(y.transpose(0, 2, 1))


@dataclass
class _Maps:
    """What rows are multiplied by; two linear maps in a row are one.

    ``look``: query times key, as exponents of two with the scale of products; ``read``: value
    times out; ``classes``: to exponents of two, without bias; ``bias``: what powers are multiplied by.
    ``unlook``, ``unread`` and ``back`` lead gradients the other way.
    """

    look: np.ndarray
    read: np.ndarray
    classes: np.ndarray
    bias: np.ndarray
    unlook: np.ndarray
    unread: np.ndarray
    back: np.ndarray


def _maps(w: Weights) -> _Maps:
    qkv, number = w["qkv"], w["qkv"].dtype.type
    to_q, to_k, to_v = qkv[:, :WIDTH], qkv[:, WIDTH : 2 * WIDTH], qkv[:, 2 * WIDTH :]
    look, read = to_q @ to_k.T * number(_SCALE), to_v @ w["out"]
    bias = np.exp(np.maximum(w["bias"] - w["bias"].max(), number(-60)))  # adding a number to all changes nothing
    back = (look.T, read.T, (w["classes"] * bias).T)
    return _Maps(look * number(_TWO), read, w["classes"] * number(_TWO), bias, *(np.ascontiguousarray(x) for x in back))


def _forward(w: Weights, index: np.ndarray, since: int = 0, maps: _Maps | None = None) -> dict[str, np.ndarray]:
    """Places see themselves and those before: filler stands after all of a window's own places.

    Of places before ``since`` only what others see is worked out.
    """
    x = w["input"].take(index, axis=0)
    x += w["place"]
    maps = maps or _maps(w)
    seeing = np.ascontiguousarray(x[:, since:])
    q, turned, seen = _product(seeing, maps.look), _turned(x), _SEEN[since:]
    exponents = lambda: np.matmul(q, turned)
    a = _powers(exponents, seen)
    sums = _row_sums(a, WINDOW)
    if not _fits(sums):
        a = _powers(_steady(exponents, seen), seen)
        sums = _row_sums(a, WINDOW)
    a /= sums
    o = np.matmul(a, x)
    h = _product(o, maps.read)
    h += seeing
    return {"x": x, "turned": turned, "q": q, "a": a, "o": o, "h": h}


def _class_scores(w: Weights, h: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the classes."""
    maps = _maps(w)
    powers = _steady_powers(lambda: _product(h.reshape(-1, WIDTH), maps.classes), maps.bias) * maps.bias
    return np.log(powers / _row_sums(powers))


def _steady_powers(exponents: Callable[[], np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Powers that stay in the range with ``bias`` too, which they are still to be multiplied by."""
    return _powers(_steady(lambda: exponents() + np.log2(bias))) / bias


def scores(w: Weights, subwords: Subwords, text: Windows, batch: int = BATCH) -> np.ndarray:
    """log10 probability of each place's target."""
    out = np.zeros(len(text.target))
    klass = subwords.klass[text.target]
    opening, maps = text.used[:, 0], _maps(w)
    for group in (np.flatnonzero(opening), np.flatnonzero(~opening)):
        since = int(text.used[group].any(axis=0).argmax()) if len(group) else 0  # places before are only looked back at
        for lo in range(0, len(group), batch):
            some = group[lo : lo + batch]
            at = text.at.take(some, axis=0)
            h = _forward(w, text.input.take(at), since, maps)["h"].reshape(-1, WIDTH)
            used = np.flatnonzero(text.used.take(some, axis=0)[:, since:])
            place = at[:, since:].reshape(-1).take(used)
            own = klass.take(place)
            if len(used) < len(h):
                h = h.take(used, axis=0)
            exponents = lambda h=h: _product(h, maps.classes)
            mine, sums = _quotient(_powers(exponents), own, maps.bias)
            if not (_fits(mine) and _fits(sums)):
                mine, sums = _quotient(_steady_powers(exponents, maps.bias), own, maps.bias)
            out[place] = np.log10(mine / sums)
    return out + subwords.share[text.target]


def _quotient(powers: np.ndarray, own: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's power of its own class, and the sum of all, both with bias."""
    mine = powers.reshape(-1).take(np.arange(0, powers.size, powers.shape[1]) + own) * bias.take(own)
    return mine, _product(powers, bias[:, None])[:, 0]


def _summed_rows(rows: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the values of each added up; ``rows`` are below ``size``."""
    rows = rows.astype(np.min_scalar_type(size))  # short numbers are sorted by their digits
    order = np.argsort(rows, kind="stable")
    rows = rows.take(order)
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[begin], np.add.reduceat(values.take(order, axis=0), begin, axis=0)


def gradients(w: Weights, index: np.ndarray, target: np.ndarray, used: np.ndarray) -> Weights:
    """Of the mean negative log probability of the target classes where ``used``."""
    rows, values, others = _gradients(w, index, target, used)
    out = np.zeros_like(w["input"])
    out[rows] = values
    return {"input": out, **others}


def _gradients(w: Weights, index: np.ndarray, target: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, Weights]:
    """The input vectors that are read and their gradients, and those of all other weights."""
    maps, places = _maps(w), max(int(used.sum()), 1)
    dx = np.empty((*index.shape, WIDTH), w["input"].dtype)
    parts = [
        _part_gradients(w, maps, index[lo : lo + PART], target[lo : lo + PART], used[lo : lo + PART], places, dx[lo : lo + PART])
        for lo in range(0, len(index), PART)
    ]
    dlook, dread, classes, bias = (sum(x) for x in zip(*parts, strict=True))
    # of a product of two matrices to each of them
    dlook = dlook * dlook.dtype.type(_SCALE)
    qkv = w["qkv"]
    to_q, to_k, to_v = qkv[:, :WIDTH], qkv[:, WIDTH : 2 * WIDTH], qkv[:, 2 * WIDTH :]
    rows, values = _summed_rows(index.reshape(-1), dx.reshape(-1, WIDTH), len(w["input"]))
    return rows, values, {
        "place": dx.sum(axis=0), "qkv": np.hstack([dlook @ to_k, dlook.T @ to_q, dread @ w["out"].T]), "out": to_v.T @ dread,
        "classes": classes * maps.bias, "bias": bias * maps.bias,
    }


def _part_gradients(
    w: Weights, maps: _Maps, index: np.ndarray, target: np.ndarray, used: np.ndarray, places: int, dx: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A part's share of the gradients, small enough for the processor's own memory; those of its rows go to ``dx``."""
    f = _forward(w, index, 0, maps)
    exponents = lambda: _product(f["h"].reshape(-1, WIDTH), maps.classes)
    e, own = _powers(exponents), maps.bias.take(target.reshape(-1))
    sums = _product(e, maps.bias[:, None])[:, 0]
    if not (_fits(sums) and _fits(sums / own)):
        e = _steady_powers(exponents, maps.bias)
        sums = _product(e, maps.bias[:, None])[:, 0]
    # powers, less their row's sum at the target: times ``bias`` and ``share`` they are probabilities less one at the target
    e.reshape(-1)[np.arange(0, e.size, e.shape[1]) + target.reshape(-1)] -= sums / own
    share = used.reshape(-1) / (sums * sums.dtype.type(places))
    wide = np.repeat(share, WIDTH).reshape(-1, WIDTH)
    classes = _summed_product(f["h"].reshape(-1, WIDTH) * wide, e)
    dh = _product(e, maps.back)
    dh *= wide
    dh = dh.reshape(f["h"].shape)
    do = _product(dh, maps.unread)
    ds = np.matmul(do, f["turned"])
    ds *= f["a"]
    ds -= f["a"] * _row_sums(ds, WINDOW)
    dq = np.matmul(ds, f["x"])
    np.add(dh, _product(dq, maps.unlook), out=dx)
    dx += np.matmul(np.multiply(ds.transpose(0, 2, 1), ds.dtype.type(1 / _TWO), order="C"), f["q"])
    dx += np.matmul(_turned(f["a"]), do)
    return _summed_product(f["x"], dq), _summed_product(f["o"], dh), classes, share @ e


class _Adam:
    """Moves weights, whole or some rows of them, and remembers mean and square of each one's gradients."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.mean, self.square = weights, np.zeros_like(weights), np.zeros_like(weights)

    def move(self, g: np.ndarray, rate: np.float32, rows: np.ndarray | slice = slice(None)) -> None:
        mean, square = self.mean[rows], self.square[rows]
        mean += np.float32(0.1) * (g - mean)
        square += np.float32(0.01) * (g * g - square)
        self.mean[rows], self.square[rows] = mean, square
        self.weights[rows] -= rate * mean / (np.sqrt(square) + np.float32(1e-8))


class Learner:
    """Adam over windows as they come; input vectors move where their subword is read."""

    def __init__(self, weights: Weights, subwords: Subwords, rate: float):
        others = {k: v for k, v in weights.items() if k != "input"}
        self.input, self.others = _Adam(weights["input"].copy()), _Adam(flattened(others))
        self.w = {"input": self.input.weights, **_views(self.others.weights, others)}
        self.subwords, self.rate, self.steps, self.places = subwords, rate, 0, 0

    def learn(self, text: Windows) -> None:
        for lo in range(0, len(text.at), BATCH):
            at, valid = text.at[lo : lo + BATCH], text.valid[lo : lo + BATCH]
            rows, values, others = _gradients(self.w, text.input.take(at), self.subwords.klass.take(text.target.take(at)), valid)
            self.steps += 1
            self.places += int(valid.sum())
            rate = np.float32(self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
            self.input.move(values, rate, rows)
            self.others.move(flattened(others), rate)


def flattened(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w)])


def _views(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def shaped(values: np.ndarray, like: Weights) -> Weights:
    return {k: v.astype(np.float32) for k, v in _views(values, like).items()}


