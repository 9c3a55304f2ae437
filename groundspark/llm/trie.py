"""Exact token counts by prefix tries: pieces that share a prefix share the tokenization state of that prefix.

The state of a prefix is the last token of its encoding and the number of its tokens. The encoding of a prefix of length i ends
with token t exactly if t is a suffix of it and encoding (last token before t) + t alone gives those two tokens back. Tokens
that are suffixes are found by an automaton over the vocabulary; whether two tokens stay apart is worked out once per pair.
All nodes of one depth are treated together.
"""

from __future__ import annotations

from collections import deque

import numpy as np

from .tokenizers import FOLDER, KNOWN, pieces, ranks


class Vocabulary:
    def __init__(self, table: dict[bytes, int]):
        self.table = table
        self.size = max(table.values()) + 1
        self.bytes = {r: b for b, r in table.items()}
        usable = {t: r for t, r in table.items() if len(t) == 1 or self.encode(t) == [r]}
        children: list[dict[int, int]] = [{}]
        end = [-1]
        for t, r in usable.items():
            at = 0
            for b in t:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    end.append(-1)
                at = children[at][b]
            end[at] = r
        n = len(children)
        self.step = np.zeros((n, 256), dtype=np.int32)
        fail, longest = np.zeros(n, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        self.shorter = np.full(self.size, -1, dtype=np.int32)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            if at:
                self.step[at] = self.step[fail[at]]
                longest[at] = end[at] if end[at] >= 0 else longest[fail[at]]
                if end[at] >= 0:
                    self.shorter[end[at]] = longest[fail[at]]
            for b, c in children[at].items():
                fail[c] = self.step[at][b] if at else 0
                self.step[at][b] = c
                todo.append(c)
        self.longest = longest
        self.length = np.zeros(self.size, dtype=np.int32)
        for t, r in table.items():
            self.length[r] = len(t)
        self.widest = int(max(map(len, usable)))
        self.keys, self.apart = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def encode(self, piece: bytes) -> list[int]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.table.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.table[p] for p in parts]

    def separate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays two tokens."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        hit = (at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == key) if len(self.keys) else np.zeros(len(key), dtype=bool)
        if not hit.all():
            new = np.unique(key[~hit])
            told = np.array([self.encode(self.bytes[k // self.size] + self.bytes[k % self.size]) == [k // self.size, k % self.size] for k in new.tolist()], dtype=bool)
            if len(self.keys) > 5_000_000:
                self.keys, self.apart = self.keys[:0], self.apart[:0]
                return self.separate(a, b)
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys, self.apart = keys[order], np.concatenate([self.apart, told])[order]
            at = np.searchsorted(self.keys, key)
        return self.apart[at]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each piece. words: distinct, sorted, not empty."""
        n = len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        start = np.r_[0, np.cumsum(size)[:-1]]
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        out = np.zeros(n, dtype=np.int64)
        node, state = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)  # by piece
        lasts: dict[int, np.ndarray] = {0: np.full(n, -1, dtype=np.int32)}
        totals: dict[int, np.ndarray] = {0: np.zeros(n, dtype=np.int32)}
        act = np.arange(n)
        for depth in range(int(size.max(initial=0))):
            act = act[size[act] > depth]
            byte = data[start[act] + depth]
            fresh = np.ones(len(act), dtype=bool)
            fresh[1:] = (byte[1:] != byte[:-1]) | (node[act[1:]] != node[act[:-1]])
            of = np.cumsum(fresh) - 1
            rep = act[fresh]  # a piece for each node of this depth
            st = self.step[state[rep], byte[fresh]]
            token = self.longest[st].copy()
            last, total = np.full(len(rep), -1, dtype=np.int32), np.zeros(len(rep), dtype=np.int32)
            open_ = np.arange(len(rep))
            while len(open_):
                t = token[open_]
                back = depth + 1 - self.length[t]
                before, sums = np.full(len(t), -1, dtype=np.int32), np.zeros(len(t), dtype=np.int32)
                for j in np.unique(back).tolist():
                    m = back == j
                    before[m], sums[m] = lasts[j][rep[open_[m]]], totals[j][rep[open_[m]]]
                good = back == 0
                inner = np.nonzero(~good)[0]
                good[inner] = self.separate(before[inner], t[inner])
                done = open_[good]
                last[done], total[done] = t[good], sums[good] + 1
                open_ = open_[~good]
                token[open_] = self.shorter[token[open_]]
            node[act], state[act] = of, st[of]
            la, ta = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
            la[act], ta[act] = last[of], total[of]
            lasts[depth + 1], totals[depth + 1] = la, ta
            lasts.pop(depth + 1 - self.widest, None)
            totals.pop(depth + 1 - self.widest, None)
            ended = size[act] == depth + 1
            out[act[ended]] = ta[act[ended]]
        return out


class TrieCounter:
    """counts(texts): exact token counts of many texts. The distinct new pieces of a batch make one set of tries, by their bytes."""

    #: Bytes of pieces whose tries are held at once.
    AT_ONCE = 1_500_000

    def __init__(self, name: str = "byte_bpe_50k", folder: str = FOLDER):
        self.vocabulary, self.known = Vocabulary(ranks(name, folder)), {}

    def counts(self, texts: list[str | None]) -> list[int]:
        found = [pieces(t) if t else [] for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        new = sorted({p.encode("utf-8", "surrogatepass") for ps in found for p in ps if p not in known})
        at, held = 0, 0
        for i, w in enumerate(new):
            held += len(w)
            if held >= self.AT_ONCE or i == len(new) - 1:
                part = new[at : i + 1]
                known.update(zip([p.decode("utf-8", "surrogatepass") for p in part], self.vocabulary.counts(part).tolist(), strict=True))
                at, held = i + 1, 0
        return [sum(map(known.__getitem__, ps)) for ps in found]
