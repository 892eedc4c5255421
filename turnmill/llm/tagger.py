"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by gradients and decoding.

A step reads two characters, so there are half as many steps; tags stand for pairs of characters. Gates are piecewise linear, clip(z / 4 + 1 / 2, 0, 1), and candidates and states are clipped at 1: numpy takes a fifth of
the time of exponentials for them.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

ENTITIES = ("email", "phone", "national_id", "address", "person")
#: Tags: 0 outside, then begin and inside of each entity.
TAGS = 1 + 2 * len(ENTITIES)
#: Symbols: 0 padding, 1 others, 10 line ends, then printable ASCII; digits are one, letters with accents stand for those without.
SYMBOLS = 128


def _code(c: str) -> int:
    o = ord(c)
    if 48 <= o <= 57:
        return 48
    if 32 <= o < 127:
        return o
    if c in "\n\r":
        return 10
    if c.isspace():
        return 32
    d = unicodedata.normalize("NFKD", c)[0]
    if d.isdigit():
        return 48
    return ord(d) if 32 <= ord(d) < 127 else 1


_TABLE = np.array([_code(chr(i)) for i in range(0x3000)] + [1], np.uint8)


def encode(text: str) -> np.ndarray:
    """Symbol of each code point; those from U+3000 on are one."""
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x3000)]


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Tags of the pairs of n characters: a pair in which a span begins has its begin tag, one that a span meets its inside tag."""
    t = np.zeros((n + 1) // 2, np.int64)
    for a, e, k in spans:
        b = 1 + 2 * ENTITIES.index(k)
        t[a // 2 : (e + 1) // 2] = b + 1
    for a, _, k in spans:
        t[a // 2] = 1 + 2 * ENTITIES.index(k)
    return t


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, entity) in characters; an inside tag that continues nothing begins a span."""
    out: list[tuple[int, int, str]] = []
    at = np.flatnonzero(tags).tolist()
    for a in at:
        tag = int(tags[a])
        ent = (tag - 1) // 2
        if tag == 2 + 2 * ent and out and out[-1][1] == 2 * a and out[-1][2] == ENTITIES[ent]:
            out[-1] = (out[-1][0], 2 * a + 2, ENTITIES[ent])
        else:
            out.append((2 * a, 2 * a + 2, ENTITIES[ent]))
    return out


def _folds(hidden: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, offset and lower limit of the columns of input, forget and output gate and candidate."""
    return tuple(np.repeat(np.array(v, kind), hidden) for v in ((0.25, 0.25, 0.25, 1), (0.5, 0.5, 0.5, 0), (0, 0, 0, -1)))  # type: ignore[return-value]


@dataclass
class Tagger:
    """Parameters: per direction x (first and second symbol to gates), w (state to gates); o, b to tags; t transitions, s start."""

    p: dict[str, np.ndarray]
    #: Running mean of the training loss per symbol.
    loss: float = 0.0

    @classmethod
    def new(cls, hidden: int, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["x" + d] = r.normal(0, 0.3, (2 * SYMBOLS, 4 * hidden)).astype(np.float32)
            p["x" + d][:, hidden : 2 * hidden] += 0.5  # open forget gates
            p["w" + d] = r.normal(0, 1 / hidden**0.5, (hidden, 4 * hidden)).astype(np.float32)
        p["o"] = r.normal(0, 0.2, (2 * hidden, TAGS)).astype(np.float32)
        p["b"] = np.zeros(TAGS, np.float32)
        p["t"] = np.zeros((TAGS, TAGS), np.float32)
        p["s"] = np.zeros(TAGS, np.float32)
        return cls(p)

    def _run(self, x: np.ndarray, d: str, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hidden states (time, batch, hidden), gates and cells; live: how many of the batch (longest first) reach each time."""
        _, steps, n = x.shape
        xs, w = self.p["x" + d], self.p["w" + d]
        hidden = w.shape[0]
        gates, cells, out = np.zeros((steps, n, 4 * hidden), w.dtype), np.zeros((steps, n, hidden), w.dtype), np.zeros((steps, n, hidden), w.dtype)
        slope, shift, low = _folds(hidden, w.dtype)
        h = c = np.zeros((n, hidden), w.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            k = live[t]
            z = gates[t, :k]
            np.matmul(h[:k], w, out=z)
            z += xs[x[0, t, :k]]
            z += xs[x[1, t, :k]]
            z *= slope
            z += shift
            np.maximum(z, low, out=z)
            np.minimum(z, 1, out=z)
            np.multiply(z[:, hidden : 2 * hidden], c[:k], out=cells[t, :k])
            cells[t, :k] += z[:, :hidden] * z[:, 3 * hidden :]
            np.multiply(z[:, 2 * hidden : 3 * hidden], np.clip(cells[t, :k], -1, 1), out=out[t, :k])
            h, c = out[t], cells[t]
        return out, gates, cells

    def _infer(self, x: np.ndarray, d: str, live: np.ndarray) -> np.ndarray:
        """Hidden states like _run and a one behind them, for decoding: slopes and offsets folded into the parameters, buffers kept."""
        _, steps, n = x.shape
        w = self.p["w" + d]
        hidden = w.shape[0]
        slope, shift, low = _folds(hidden, np.dtype(np.float32))
        one = (self.p["x" + d] * slope + shift / 2).astype(np.float32)
        table, w = (one[:SYMBOLS, None] + one[SYMBOLS:]).reshape(-1, 4 * hidden), np.ascontiguousarray(w * slope)  # a row per pair
        pairs = x[0] * SYMBOLS + x[1] - SYMBOLS
        out = np.zeros((steps, n, hidden + 1), np.float32)
        h, c, tmp = (np.zeros((n, hidden), np.float32) for _ in range(3))
        z, zx = np.empty((n, 4 * hidden), np.float32), np.empty((n, 4 * hidden), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            k = live[t]
            hk, ck, tk, zk, xk = h[:k], c[:k], tmp[:k], z[:k], zx[:k]
            np.matmul(hk, w, out=zk)
            np.take(table, pairs[t, :k], axis=0, out=xk, mode="clip")
            zk += xk
            np.maximum(zk, low, out=zk)
            np.minimum(zk, 1.0, out=zk)
            ck *= zk[:, hidden : 2 * hidden]
            np.multiply(zk[:, :hidden], zk[:, 3 * hidden :], out=tk)
            ck += tk
            np.maximum(ck, -1.0, out=tk)
            np.minimum(tk, 1.0, out=tk)
            np.multiply(zk[:, 2 * hidden : 3 * hidden], tk, out=hk)
            out[t, :k, :hidden] = hk
            out[t, :k, hidden] = 1.0
        return out

    def emissions(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Scores of the tags less that of outside; 0 beyond a window's end."""
        hidden = self.p["wf"].shape[0]
        o, b = self.p["o"] - self.p["o"][:, :1], self.p["b"] - self.p["b"][0]
        e = self._infer(x, "f", live) @ np.concatenate([o[:hidden], b[None]])
        e += self._infer(x, "b", live) @ np.concatenate([o[hidden:], 0 * b[None]])
        return e

    def decode(self, windows: list[np.ndarray], batch: int = 1024) -> list[np.ndarray]:
        """Best tags of each window (Viterbi).

        Going forward only the best scores are kept; the tag before is looked up for the best path alone.
        """
        order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
        out: list[np.ndarray] = [_NONE] * len(windows)
        trans, into = self.p["t"], np.ascontiguousarray(self.p["t"].T)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x, live, lengths = _stack([windows[i] for i in part])
            if not x.shape[1]:
                continue
            score = np.ascontiguousarray(self.emissions(x, live).transpose(0, 2, 1))
            steps, _, n = score.shape
            score[0] += self.p["s"][:, None]
            m = np.empty((TAGS, n), np.float32)
            for t in range(1, steps):
                k = live[t]
                old, now, mk = score[t - 1, :, :k], score[t], m[:, :k]
                for j in range(TAGS):
                    np.add(old, into[j][:, None], out=mk)
                    now[j, :k] += mk.max(0)
            tags = np.zeros((steps, n), np.int64)
            cur = np.zeros(n, np.int64)
            done = 0
            for t in range(steps - 1, -1, -1):
                k = live[t]
                if k > done:  # windows that end here
                    cur[done:k] = score[t, :, done:k].argmax(0)
                    done = k
                tags[t, :k] = cur[:k]
                if t:
                    cur[:k] = (score[t - 1, :, :k] + trans[:, cur[:k]]).argmax(0)
            for j, i in enumerate(part):
                out[i] = tags[: lengths[j], j]
        return out

    def gradients(self, x: np.ndarray, live: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """CRF loss per symbol and its gradients; forward and backward sums are scaled to 1 at each place."""
        p = self.p
        hf, gf, cf = self._run(x, "f", live)
        hb, gb, cb = self._run(x, "b", live)
        hidden = hf.shape[2]
        e = (hf @ p["o"][:hidden] + hb @ p["o"][hidden:] + p["b"]).astype(np.float64)
        steps, n, _ = e.shape
        trans, start = p["t"].astype(np.float64), p["s"].astype(np.float64)
        top = e.max(2, keepdims=True)
        ex, tx = np.exp(e - top), np.exp(trans)
        alpha, beta, scale = np.zeros_like(e), np.zeros_like(e), np.ones((steps, n))
        for t in range(steps):
            k = live[t]
            a = (alpha[t - 1, :k] @ tx if t else np.exp(start)[None, :]) * ex[t, :k]
            scale[t, :k] = a.sum(1)
            alpha[t, :k] = a / scale[t, :k, None]
        reach = np.arange(steps)[:, None] < lengths
        log_z = ((np.log(scale) + top[:, :, 0]) * reach).sum(0)
        dt = np.zeros_like(trans)
        for t in range(steps - 1, -1, -1):
            k, k2 = live[t], live[t + 1] if t + 1 < steps else 0
            beta[t, k2:k] = 1.0
            if k2:
                after = ex[t + 1, :k2] * beta[t + 1, :k2] / scale[t + 1, :k2, None]
                beta[t, :k2] = after @ tx.T
                dt += alpha[t, :k2].T @ after
        dt *= tx
        de = alpha * beta
        ds = de[0].sum(0)
        at, row = np.nonzero(reach)
        gold = e[at, row, y[at, row]].sum() + start[y[0]].sum()
        de[at, row, y[at, row]] -= 1
        at, row = np.nonzero(reach[1:])
        gold += trans[y[at, row], y[at + 1, row]].sum()
        np.subtract.at(dt, (y[at, row], y[at + 1, row]), 1)
        np.subtract.at(ds, y[0], 1)
        count = float(lengths.sum())
        de32 = (de / count).astype(p["o"].dtype)
        g = {"t": (dt / count).astype(p["o"].dtype), "s": (ds / count).astype(p["o"].dtype), "b": de32.sum((0, 1))}
        g["o"] = np.concatenate([np.tensordot(hf, de32, ((0, 1), (0, 1))), np.tensordot(hb, de32, ((0, 1), (0, 1)))])
        slope, _, low = _folds(hidden, p["o"].dtype)
        by_symbol = []
        for which in x:
            order = np.argsort(which, axis=None, kind="stable")
            symbol = which.reshape(-1)[order]
            by_symbol.append((symbol, order, np.flatnonzero(np.diff(symbol, prepend=-1))))
        for d, h, z, c, part in (("f", hf, gf, cf, p["o"][:hidden]), ("b", hb, gb, cb, p["o"][hidden:])):
            dh_all = de32 @ part.T
            wt = np.ascontiguousarray(p["w" + d].T)
            open_ = slope * ((z > low) & (z < 1))
            tc, free = np.clip(c, -1, 1), np.abs(c) < 1
            none = np.zeros((1, n, hidden), wt.dtype)
            before = (lambda a: np.concatenate([none, a[:-1]])) if d == "f" else (lambda a: np.concatenate([a[1:], none]))
            h0, c0 = before(h), before(c)
            dzs = np.zeros_like(z)
            dh, dc = np.zeros((n, hidden), wt.dtype), np.zeros((n, hidden), wt.dtype)
            i, f, o, u = (slice(g * hidden, (g + 1) * hidden) for g in range(4))
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                k = live[t]
                a, zt, dz = dh_all[t, :k] + dh[:k], z[t, :k], dzs[t, :k]
                np.multiply(a, tc[t, :k], out=dz[:, o])
                a *= zt[:, o]
                a *= free[t, :k]
                a += dc[:k]
                np.multiply(a, zt[:, u], out=dz[:, i])
                np.multiply(a, c0[t, :k], out=dz[:, f])
                np.multiply(a, zt[:, i], out=dz[:, u])
                dz *= open_[t, :k]
                np.matmul(dz, wt, out=dh[:k])
                np.multiply(a, zt[:, f], out=dc[:k])
            flat = dzs.reshape(-1, 4 * hidden)
            g["w" + d] = h0.reshape(-1, hidden).T @ flat
            g["x" + d] = gx = np.zeros_like(p["x" + d])
            for symbol, order, firsts in by_symbol:
                gx[symbol[firsts]] = np.add.reduceat(flat[order], firsts, axis=0)
        return float((log_z.sum() - gold) / count), g


_NONE = np.zeros(0, np.int64)


def _stack(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of a pair, time, batch) of windows, longest first; how many reach each time; steps of each. Second symbols have their own numbers."""
    chars = np.array([len(w) for w in windows], np.int64)
    lengths = (chars + 1) // 2
    steps = int(lengths.max(initial=0))
    x = np.zeros((len(windows), 2 * steps), np.uint8)
    for j, w in enumerate(windows):
        x[j, : len(w)] = w
    pairs = np.ascontiguousarray(x.reshape(len(windows), steps, 2).transpose(2, 1, 0)).astype(np.int64)
    pairs[1] += SYMBOLS
    return pairs, (lengths[None, :] > np.arange(steps)[:, None]).sum(1), lengths


def train(windows: list[np.ndarray], tags: list[np.ndarray], hidden: int = 20, epochs: int = 4, rate: float = 0.015, batch: int = 24, seed: int = 5, model: Tagger | None = None) -> Tagger:
    """Adam over batches of windows of like length, in an order drawn from the seed: the same input gives the same model.

    A model given is trained on.
    """
    model = model or Tagger.new(hidden, seed)
    r = np.random.default_rng(seed)
    by_length = sorted((i for i in range(len(windows)) if len(windows[i])), key=lambda i: (-len(windows[i]), i))
    parts = [by_length[a : a + batch] for a in range(0, len(by_length), batch)]
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    step, total = 0, max(1, epochs * len(parts))
    for _ in range(epochs):
        for j in r.permutation(len(parts)):
            part = parts[j]
            x, live, lengths = _stack([windows[i] for i in part])
            y = np.zeros(x.shape[1:], np.int64)
            for j, i in enumerate(part):
                y[: len(tags[i]), j] = tags[i]
            loss, g = model.gradients(x, live, lengths, y)
            model.loss = 0.95 * model.loss + 0.05 * loss if step else loss
            norm = float(np.sqrt(sum(float((a * a).sum()) for a in g.values())))
            scale = min(1.0, 1.0 / max(norm, 1e-9))
            step += 1
            lr = rate * (1 - 0.95 * step / total)
            for k, a in g.items():
                a = a * scale
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                model.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return model
