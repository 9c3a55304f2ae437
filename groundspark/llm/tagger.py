"""A character-level bidirectional LSTM with CRF transitions, in numpy: training with Adam, emissions, and Viterbi decoding.

Both directions and all four gates of a step are one contiguous array, so that a step is one gather, one batched product and a few
passes over memory.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Sequence

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = len(KINDS) + 1  # 0 is outside
PAD, OTHER, HAN, DROP = 0, 1, 2, -1
EMBED, HIDDEN, CHARS = 16, 12, 900
#: Characters of a window, and those that neighbouring windows share.
WINDOW, SHARED = 640, 32
#: Windows that are treated at once.
BATCH = 512


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Tagger:
    """alphabet: ids of characters; fold: characters that are read as another one, or as none ('')."""

    def __init__(self, alphabet: dict[str, int], seed: int = 0, hidden: int = HIDDEN, fold: dict[int, str] | None = None):
        self.alphabet, self.hidden, self.fold = alphabet, hidden, fold or {}
        r = np.random.default_rng(seed)
        n = max(alphabet.values(), default=2) + 1
        w = lambda fan, *s: (r.standard_normal(s) / np.sqrt(fan)).astype(np.float32)
        bias = np.zeros((4, 2, 1, hidden), np.float32)
        bias[1] = 1  # remember at first
        # Gates: input, forget, output, cell; directions: forwards, backwards.
        self.p = {
            "emb": 0.3 * w(1, n, EMBED), "wx": w(EMBED, 4, 2, EMBED, hidden), "wh": w(hidden, 4, 2, hidden, hidden), "b": bias,
            "out": w(2 * hidden, 2, hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32),
        }
        self.codes = self._codes()

    def __getstate__(self):
        return {"alphabet": self.alphabet, "hidden": self.hidden, "fold": self.fold, "p": self.p}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.codes = self._codes()

    @staticmethod
    def letters(texts: Sequence[str]) -> dict[str, int]:
        """Ids of the most frequent characters; accented letters share the id of their base letter."""
        c: Counter = Counter()
        for t in texts:
            c.update(t)
        base = Counter()
        for k, v in c.items():
            base[unicodedata.normalize("NFD", k)[0]] += v
        return {k: i + 3 for i, (k, _) in enumerate(sorted(base.items(), key=lambda x: (-x[1], x[0]))[:CHARS])}

    def _codes(self) -> np.ndarray:
        """Id of every code point; DROP for those that are read as nothing."""
        table = np.full(0x110000, OTHER, dtype=np.int16)
        table[0x3400:0xA000] = HAN
        for block in ((0x80, 0x530), (0x1E00, 0x2000)):
            for code in range(*block):
                table[code] = self.alphabet.get(unicodedata.normalize("NFD", chr(code))[0], OTHER)
        for c, i in self.alphabet.items():
            table[ord(c)] = i
        for code, to in self.fold.items():
            table[code] = table[ord(unicodedata.normalize("NFD", to)[0])] if to else DROP
        return table

    def ids(self, text: str) -> np.ndarray:
        """Ids of the characters; one that is read as nothing keeps its place as an unknown one."""
        i = self.codes[code_points(text)]
        return np.where(i == DROP, OTHER, i)

    # -- the network; x: steps x windows of ids

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """What each character adds to the gates, and the recurrent weights. Sigmoids are halved arguments of tanh:
        sigmoid(z) = (1 + tanh(z / 2)) / 2. A blank closes all gates, so it leaves no trace."""
        p, n = self.p, len(self.p["emb"])
        half = np.array([0.5, 0.5, 0.5, 1], np.float32).reshape(4, 1, 1, 1)
        table = (p["emb"] @ p["wx"] + p["b"]) * half
        table[:3, :, PAD] = -20
        table[3, :, PAD] = 0
        return np.ascontiguousarray(table.reshape(8 * n, self.hidden)), p["wh"] * half

    def _run(self, x: np.ndarray):
        """Outputs, directions x steps x windows x units; and what the gradients need."""
        (steps, n), size, units = x.shape, len(self.p["emb"]), self.hidden
        table, wh = self._table()
        offset = (np.arange(8) * size).reshape(4, 2, 1)
        at = np.empty((4, 2, n), np.int64)
        g, m = np.empty((4, 2, n, units), np.float32), np.empty((4, 2, n, units), np.float32)
        h, c = (np.zeros((2, n, units), np.float32) for _ in range(2))
        out, memory = np.empty((2, steps, n, units), np.float32), []
        for t in range(steps):
            at[:] = offset
            at[:, 0] += x[t]
            at[:, 1] += x[steps - 1 - t]
            np.take(table, at, axis=0, out=g, mode="clip")
            np.matmul(h, wh, out=m)
            g += m
            np.tanh(g, out=g)
            g[:3] += 1
            g[:3] *= 0.5
            before, last = c, h
            c = g[1] * c + g[0] * g[3]
            tc = np.tanh(c)
            h = g[2] * tc
            memory.append((g.copy(), before, tc, last))
            out[0, t] = h[0]
            out[1, steps - 1 - t] = h[1]
        return out, memory

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """tags x steps x windows. x: steps x windows.

        As _run(), with windows last, and both directions within a row: one product takes the last outputs and the values of the
        characters and says of the tags what the last step told, so that no outputs are kept, and gates lie side by side."""
        p, (steps, n), units = self.p, x.shape, self.hidden
        half = np.array([0.5, 0.5, 0.5, 1], np.float32).reshape(4, 1, 1, 1)
        # The parts of the sums: outputs (doubled, which the weights make up for), values of the character, one, and one for a blank,
        # which closes all gates.
        blank = np.zeros((4, 2, 1, units), np.float32)
        blank[:3] = -20
        w = np.concatenate([0.5 * p["wh"] * half, p["wx"] * half, p["b"] * half, blank], axis=2)[[2, 0, 1, 3]]
        w = w.transpose(1, 0, 3, 2).reshape(2, 4 * units, -1)
        say = np.zeros((2, TAGS, w.shape[2]), np.float32)
        say[:, :, :units] = 0.5 * p["out"].transpose(0, 2, 1)
        w = np.ascontiguousarray(np.concatenate([say, w], axis=1))
        values = np.vstack([p["emb"].T, np.ones(len(p["emb"]), np.float32), np.zeros(len(p["emb"]), np.float32)])
        values[:, PAD] = 0
        values[-1, PAD] = 1
        # Both directions in one row; spare columns, as rows whose starts lie a page apart would share few lines of the cache.
        wide = 2 * n + 16
        own, tc = np.zeros((w.shape[2], wide), np.float32), np.empty((units, wide), np.float32)
        sides = lambda v: v[:, : 2 * n].reshape(len(v), 2, n).transpose(1, 0, 2)
        h, char, last = own[:units], own[units:], sides(own)
        # Rows: tags, output gate, input gate, forget gate, cell, memory.
        g = np.zeros((TAGS + 5 * units, wide), np.float32)
        o, i, f, c = (g[TAGS + k * units : TAGS + (k + 1) * units] for k in (0, 1, 2, 4))
        gates, opened, let, what = g[TAGS:-units], g[TAGS : TAGS + 3 * units], g[TAGS + units : TAGS + 3 * units], g[TAGS + 3 * units :]
        sums, said = sides(g[:-units]), sides(g[:TAGS])
        one, half = np.ones((), np.float32), np.full((), 0.5, np.float32)
        at = np.zeros(wide, np.intp)
        bias, e = p["bias"][:, None], np.empty((steps, TAGS, n), np.float32)

        def tell(t: int) -> None:
            """Adds what the outputs of step t say: of place t, and of the place as far from the end. The first at a place adds the bias."""
            back = steps - 1 - t
            np.add(e[t] if back < t else bias, said[0], out=e[t])
            np.add(e[back] if back <= t else bias, said[1], out=e[back])

        for t in range(steps):
            at[:n], at[n : 2 * n] = x[t], x[steps - 1 - t]
            np.take(values, at, axis=1, out=char, mode="wrap")
            np.matmul(w, last, out=sums)
            if t:
                tell(t - 1)
            np.tanh(gates, out=gates)
            np.add(opened, one, out=opened)
            np.multiply(let, what, out=let)
            np.add(i, f, out=c)
            np.multiply(c, half, out=c)
            np.tanh(c, out=tc)
            np.multiply(o, tc, out=h)
        np.matmul(w[:, :TAGS], last, out=said)
        tell(steps - 1)
        return e.transpose(1, 0, 2)

    def _loss(self, e: np.ndarray, y: np.ndarray, mask: np.ndarray):
        """CRF loss and its gradients, by forward and backward sums that are scaled at every step.

        e: steps x windows x tags; y, mask: windows x steps, left aligned."""
        tr, (steps, n, _) = self.p["trans"].astype(np.float64), e.shape
        e, m, a = e.astype(np.float64), mask.T, np.exp(self.p["trans"].astype(np.float64))
        top = e.max(axis=2)
        ex = np.exp(e - top[:, :, None])
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((steps, n))
        now = ex[0]
        for t in range(steps):
            if t:
                now = np.where(m[t, :, None], (alpha[t - 1] @ a) * ex[t], alpha[t - 1])
            scale[t] = now.sum(axis=1)
            alpha[t] = now / scale[t][:, None]
        for t in range(steps - 2, -1, -1):
            beta[t] = np.where(m[t + 1, :, None], ((ex[t + 1] * beta[t + 1]) @ a.T) / scale[t + 1][:, None], beta[t + 1])
        z = (np.log(scale) + np.where(m, top, 0)).sum(axis=0)
        ge = alpha * beta * m[:, :, None]
        right = ex[1:] * beta[1:] / scale[1:, :, None] * m[1:, :, None]
        gt = (alpha[:-1].reshape(-1, TAGS).T @ right.reshape(-1, TAGS)) * a
        at, step = y.T, np.arange(steps)[:, None]
        score = np.where(m, e[step, np.arange(n), at], 0).sum(axis=0) + np.where(m[1:], tr[at[:-1], at[1:]], 0).sum(axis=0)
        ge[step, np.arange(n), at] -= m
        gt -= np.bincount((at[:-1] * TAGS + at[1:])[m[1:]], minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        return float((z - score).mean()), (ge / n).astype(np.float32), (gt / n).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray):
        """x, y: windows x steps."""
        p, mask, units = self.p, x != PAD, self.hidden
        h, memory = self._run(x.T)
        n, steps = x.shape
        loss, ge, gt = self._loss(h[0] @ p["out"][0] + h[1] @ p["out"][1] + p["bias"], y, mask)
        flat = ge.reshape(-1, TAGS)
        g = {"trans": gt, "bias": flat.sum(axis=0), "out": np.stack([h[d].reshape(-1, units).T @ flat for d in (0, 1)])}
        gh = np.stack([ge @ p["out"][d].T for d in (0, 1)])
        gx = np.zeros((4, 2, steps, n, units), np.float32)
        gwh = np.zeros_like(p["wh"])
        dh, dc = np.zeros((2, n, units), np.float32), np.zeros((2, n, units), np.float32)
        back = p["wh"].transpose(0, 1, 3, 2)
        for t in range(steps - 1, -1, -1):
            (i, f, o, c), before, tc, last = memory[t]
            keep = np.stack([mask[:, t], mask[:, steps - 1 - t]])[:, :, None]
            dht = np.where(keep, np.stack([gh[0, t], gh[1, steps - 1 - t]]) + dh, 0)
            dct = np.where(keep, dht * o * (1 - tc * tc) + dc, 0)
            z = np.stack([dct * c * i * (1 - i), dct * before * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - c * c)])
            gx[:, 0, t], gx[:, 1, steps - 1 - t] = z[:, 0], z[:, 1]
            gwh += last.transpose(0, 2, 1) @ z
            dh, dc = (z @ back).sum(axis=0), dct * f
        at, rows = x.T.reshape(-1), gx.reshape(4, 2, -1, units)
        ex = p["emb"][at]
        g |= {"wx": ex.T @ rows, "b": rows.sum(axis=2, keepdims=True), "wh": gwh, "emb": np.zeros_like(p["emb"])}
        pulled = (rows @ p["wx"].transpose(0, 1, 3, 2)).sum(axis=(0, 1))
        for j in range(EMBED):
            g["emb"][:, j] = np.bincount(at, weights=pulled[:, j], minlength=len(g["emb"]))
        return loss, g

    def train(self, texts: Sequence[str], tags: Sequence[Sequence[int]], steps: int = 500, batch: int = 32, rate: float = 0.02, seed: int = 0) -> float:
        """Texts of similar length train best. Returns the mean loss of the last fifty steps."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        ids, losses = [self.ids(t) for t in texts], []
        for s in range(1, steps + 1):
            at = r.integers(0, len(ids), batch)
            width = max(len(ids[k]) for k in at)
            x, y = np.zeros((batch, width), np.int64), np.zeros((batch, width), np.int64)
            for row, k in enumerate(at):
                x[row, : len(ids[k])], y[row, : len(ids[k])] = ids[k], tags[k]
            loss, g = self._gradients(x, y)
            losses.append(loss)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            lr = rate * min(1, s / 20) * (1 - s / (steps + 1))
            for k, a in g.items():
                a = a * np.float32(min(1, 20 / (norm + 1e-9)))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.995 * v[k] + 0.005 * a * a
                self.p[k] -= (lr * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.995**s)) + 1e-7)).astype(np.float32)
        return float(np.mean(losses[-50:]))

    def viterbi(self, e: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        """The best tags for emissions (steps x tags x texts): texts x steps. size: the texts' own steps, in ascending order; a text
        ends there, whatever it is treated with, and what follows is not to be read."""
        tr, (steps, _, n) = self.p["trans"], e.shape
        size = np.full(n, steps) if size is None else np.asarray(size)
        from_ = np.searchsorted(size, np.arange(steps), side="right").tolist()  # the texts that reach a step
        best = np.empty_like(e)
        best[0] = e[0]
        for t in range(1, steps):
            a = from_[t]
            best[t, :, :a] = best[t - 1, :, :a]
            np.add((best[t - 1, :, None, a:] + tr[:, :, None]).max(axis=0), e[t, :, a:], out=best[t, :, a:])
        out = np.empty((n, steps), np.int8)
        tag = best[-1].argmax(axis=0)
        out[:, -1] = tag
        for t in range(steps - 1, 0, -1):
            a = from_[t]
            tag[a:] = (best[t - 1, :, a:] + tr[:, tag[a:]]).argmax(axis=0)
            out[:, t - 1] = tag
        return out

    def _hopeful(self, excess: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The texts whose best path can leave the outside: flat excesses of the best tag over outside, and the texts' sizes (> 0).

        Relative to staying outside, a stretch of tags gains its excesses, its inner steps and its ends; the largest sum over any
        stretch bounds that. The largest sums come from running sums and their running minima; an offset parts the texts."""
        tr = self.p["trans"].astype(np.float64) - float(self.p["trans"][0, 0])
        inner, into, out_of = tr[1:, 1:].max(), tr[0, 1:].max(), tr[1:, 0].max()
        first = np.cumsum(size) - size
        far = (np.abs(excess).max(initial=0) + abs(inner) + 1) * size.max(initial=1) * 2
        run = np.cumsum(excess.astype(np.float64) + inner)
        start = np.r_[0.0, run[first[1:] - 1]] if len(first) else first
        run -= np.repeat(start, size)
        apart = np.repeat(np.arange(len(size)) * far, size)
        before = np.empty_like(run)
        before[1:] = run[:-1]
        before[first] = 0
        least = np.minimum.accumulate(before - apart) + apart
        reduce = lambda v: np.maximum.reduceat(v, first)
        last = run[first + size - 1]
        within = reduce(run - least) + into + out_of
        head, tail = reduce(run) + out_of, last + reduce(-before) + into
        return np.maximum.reduce([within, head, tail, last]) - inner > -1e-3

    def tag(self, texts: Sequence[str], window: int = WINDOW, shared: int = SHARED, batch: int = BATCH) -> list[np.ndarray]:
        """Tags of the characters of each text."""
        return [np.zeros(len(t), np.int8) if y is None else y for t, y in zip(texts, self.paths(texts, window, shared, batch), strict=True)]

    def paths(self, texts: Sequence[str], window: int = WINDOW, shared: int = SHARED, batch: int = BATCH) -> list[np.ndarray | None]:
        """Tags of the characters of each text; None where all are outside. Characters that are read as nothing get the tag before them.

        Texts longer than a window are cut into equal windows that overlap; emissions in overlaps are averaged, weighed by their
        distance from the window's edge, and one Viterbi path is found over the whole text."""
        whole = self.codes[code_points("".join(texts))]
        long_ = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        read = whole != DROP
        flat = whole[read]
        size = np.bincount(np.repeat(np.arange(len(texts)), long_)[read], minlength=len(texts)) if len(flat) < len(whole) else long_
        first = np.cumsum(size) - size
        many = np.maximum(1, -(-(size - shared) // (window - shared))) * (size > 0)
        of = np.repeat(np.arange(len(texts)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        step = np.where(many > 1, -(-(size - shared) // np.maximum(many, 1)), size)
        start = nth * step[of]
        length = np.minimum(np.where(many[of] > 1, step[of] + shared, size[of]), size[of] - start)
        place = first[of] + start
        # Averaged emissions lie between those of the windows, so the larger excess is a bound.
        bound = np.full(len(flat), -np.inf, np.float32)
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        kept = np.zeros(len(of), dtype=bool)
        for rows, e in self._emitted(flat, place, length, np.arange(len(of)), batch):
            excess = np.ascontiguousarray((np.maximum.reduce(list(e[1:])) - e[0]).T)
            for x, p, n in zip(excess, place[rows].tolist(), length[rows].tolist(), strict=True):
                own = bound[p : p + n]
                np.maximum(own, x[:n], out=own)
            # Emissions that are likely to be needed are kept.
            excess[np.arange(excess.shape[1]) >= length[rows][:, None]] = -np.inf
            for j in np.nonzero(excess.max(axis=1) > 0)[0].tolist():
                w = int(rows[j])
                kept[w] = True
                held.setdefault(int(of[w]), []).append((int(start[w]), e[:, : length[w], j].copy()))
        full = np.nonzero(size > 0)[0]
        hopeful = full[self._hopeful(bound, size[full])] if len(full) else full
        # Only these need a path: what was not kept is worked out again.
        for rows, e in self._emitted(flat, place, length, np.nonzero(np.isin(of, hopeful) & ~kept)[0], batch):
            for j, w in enumerate(rows.tolist()):
                held.setdefault(int(of[w]), []).append((int(start[w]), e[:, : length[w], j].copy()))
        out: list[np.ndarray | None] = [None] * len(texts)
        todo = hopeful[np.argsort(size[hopeful], kind="stable")].tolist()
        begin = np.cumsum(long_) - long_
        for j in range(0, len(todo), 256):
            ks = todo[j : j + 256]
            e = np.zeros((int(size[ks[-1]]), TAGS, len(ks)), np.float32)
            for col, k in enumerate(ks):
                e[: size[k], :, col] = self._joined(held.pop(k), int(size[k]))
            tags = self.viterbi(e, size[ks])
            for col, k in enumerate(ks):
                y = tags[col, : size[k]]
                if y.any():
                    if size[k] < long_[k]:
                        y = np.r_[np.int8(0), y][np.cumsum(read[begin[k] : begin[k] + long_[k]])]
                    out[k] = y
        return out

    def _emitted(self, flat: np.ndarray, place: np.ndarray, length: np.ndarray, windows: np.ndarray, batch: int):
        """Batches of windows of similar length, with their emissions (tags x steps x windows)."""
        order = windows[np.argsort(length[windows], kind="stable")]
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            at = np.arange(int(length[rows[-1]]))[:, None]
            x = flat[np.minimum(place[rows] + at, len(flat) - 1)]
            x[at >= length[rows]] = PAD
            yield rows, self.emissions(x)

    @staticmethod
    def _joined(parts: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
        """Emissions (steps x tags) of a text from those of its windows."""
        if len(parts) == 1:
            return parts[0][1].T
        total, weight = np.zeros((size, TAGS), np.float32), np.zeros((size, 1), np.float32)
        for s, e in parts:
            n = e.shape[1]
            ramp = np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)).astype(np.float32)[:, None]
            total[s : s + n] += e.T * ramp
            weight[s : s + n] += ramp
        return total / weight
