"""A skip-chain conditional random field over token keys.

Neighbouring labels share transition potentials; repeated tokens of a text
share skip potentials that favour one label for all of them. Inference is
exact forward-backward on texts without skip links and damped loopy message
passing on the others. Training maximises the chain likelihood (full-batch
Adam); :meth:`SkipChainCRF.fit_skip` fits the skip potentials piecewise on
linked pairs, best of texts that the chain has not seen. Texts of like length
are labelled together, linked or not; what one gets does not depend on the others.

A token takes part through its *key* (a word, or the shape of a number); the
scores a key gives to its own and to neighbouring positions are summed once
per distinct key, so a batch of texts is scored by array indexing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

OFFSETS = (-2, -1, 0, 1, 2)
EDGE = "<edge>"


class SkipChainCRF:
    """``features(key)`` names a key's features; ``labels[0]`` is the label of tokens outside any entity."""

    def __init__(self, labels: Sequence[str], features: Callable[[str], list[str]]) -> None:
        self.labels, self.features = tuple(labels), features
        n = len(self.labels)
        self.index: dict[str, int] = {}
        self.weights = np.zeros((len(OFFSETS), 0, n), np.float32)
        self.transition, self.first, self.last, self.skip = np.zeros((n, n), np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32)
        self._forget()

    def _forget(self) -> None:
        self._keys: dict[str, int] = {}
        self._rows = np.zeros((1024, len(OFFSETS), len(self.labels)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_keys", "_rows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    # ---------------------------------------------------------------- scores

    def ids(self, keys: Sequence[str], most: int = 200_000) -> list[int]:
        """Row numbers of keys; the memo is emptied when it outgrows ``most``, never between two calls of a batch."""
        known = self._keys
        out = []
        for k in keys:
            at = known.get(k)
            if at is None:
                at = known[k] = len(known)
                if at == len(self._rows):
                    self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
                if f := [i for x in self.features(k) if (i := self.index.get(x)) is not None]:
                    self._rows[at] = self.weights[:, f].sum(1)
                else:
                    self._rows[at] = 0
            out.append(at)
        return out

    def trim(self, most: int = 200_000) -> None:
        if len(self._keys) > most:
            self._forget()

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores of a batch of texts of one length: (texts, length) ids to (texts, length, labels)."""
        edge = self.ids([EDGE])[0]
        padded = np.pad(ids, ((0, 0), (2, 2)), constant_values=edge)
        n = ids.shape[1]
        # a token at distance o to the right of a position speaks to it with its weights for offset o
        return sum(self._rows[padded[:, 2 + o : 2 + o + n], i] for i, o in enumerate(OFFSETS))

    def _chain(self, e: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward and backward messages and the scales; rows of falling ``lengths``, each of its own number of tokens."""
        b, t, n = e.shape
        lengths = np.full(b, t) if lengths is None else lengths
        x = np.exp(e - e.max(2, keepdims=True))
        x[:, 0] *= np.exp(self.first)
        x[np.arange(b), lengths - 1] *= np.exp(self.last)
        rows = b - np.searchsorted(lengths[::-1], np.arange(t + 1), side="right")  # how many texts have a token there
        a, z = np.exp(self.transition), np.ones((b, t), x.dtype)
        fwd, bwd = np.zeros_like(x), np.ones_like(x)
        cur = x[:, 0]
        for i in range(t):
            k = rows[i]
            if i:
                cur = (cur[:k] @ a) * x[:k, i]
            z[:k, i] = cur.sum(1)
            fwd[:k, i] = cur = cur / z[:k, i, None]
        for i in range(t - 2, -1, -1):
            k = rows[i + 1]
            bwd[:k, i] = ((bwd[:k, i + 1] * x[:k, i + 1]) @ a.T) / z[:k, i + 1, None]
        return fwd, bwd, z

    def marginals(self, e: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        fwd, bwd, _ = self._chain(e, lengths)
        m = fwd * bwd
        return m / np.maximum(m.sum(2, keepdims=True), 1e-30)

    def loopy(self, e: np.ndarray, links: Sequence[tuple[int, int]], rounds: int = 8) -> np.ndarray:
        """Marginals of one text (length, labels) whose ``links`` join like tokens."""
        return self.loopy_batch(e[None], np.array([len(e)]), [links], rounds)[0]

    def loopy_batch(self, e: np.ndarray, lengths: np.ndarray, links: Sequence[Sequence[tuple[int, int]]], rounds: int = 8) -> np.ndarray:
        """Marginals of linked texts of falling ``lengths``.

        A chain is one region, solved exactly in each round; along links
        go damped messages: what the rest of the model says about one end, through
        the skip potential, to the other. A text stops when its own messages do.
        """
        ends = np.array([(k, *ij) for k, ls in enumerate(links) for i, j in ls for ij in ((i, j), (j, i))], np.int64).reshape(-1, 3)
        text, source, target = ends.T
        back = np.arange(len(ends)) ^ 1  # the message the other way
        pair, to = np.exp(np.diag(self.skip.astype(np.float64))), np.ones((len(ends), len(self.labels)))
        live = np.zeros(len(e), bool)
        live[text] = True
        for step in range(rounds + 1):
            extra = np.zeros(e.shape, np.float64)
            np.add.at(extra, (text, target), np.log(to))
            belief = self.marginals(e + extra.astype(np.float32), lengths)
            if step == rounds or not live.any():
                break
            m = (belief[text, source].astype(np.float64) / np.maximum(to[back], 1e-12)) @ pair
            new = np.where(live[text, None], 0.5 * to + 0.5 * m / m.mean(1, keepdims=True), to)
            change = np.zeros(len(e))
            np.maximum.at(change, text, np.abs(new - to).max(1))
            live &= change >= 1e-3
            to = new
        return belief

    def label(self, texts: Sequence[Sequence[str]], links: Sequence[Sequence[tuple[int, int]]]) -> list[np.ndarray]:
        """Most probable label number of each token of each text."""
        out: list = [None] * len(texts)
        flat = [np.array(self.ids(t), np.int64) for t in texts]
        edge = self.ids([EDGE])[0]
        for linked in (False, True):
            members = sorted((i for i in range(len(flat)) if bool(links[i]) == linked), key=lambda i: -len(flat[i]))
            at = 0
            while at < len(members) and (longest := len(flat[members[at]])):
                stop = at  # texts of like length, some 100,000 tokens at a time
                while stop < len(members) and 5 * len(flat[members[stop]]) >= 4 * longest and (stop - at) * longest <= 100_000:
                    stop += 1
                group = members[at:stop]
                lengths, ids = np.array([len(flat[i]) for i in group]), np.full((len(group), longest), edge)
                for row, i in zip(ids, group):
                    row[: len(flat[i])] = flat[i]
                e = self.emissions(ids)
                best = (self.loopy_batch(e, lengths, [links[i] for i in group]) if linked else self.marginals(e, lengths)).argmax(2)
                for row, i in zip(best, group):
                    out[i] = row[: len(flat[i])]
                at = stop
        return [np.zeros(0, np.int64) if x is None else x for x in out]

    # -------------------------------------------------------------- training

    def fit(self, texts: Sequence[Sequence[str]], labels: Sequence[Sequence[int]], links: Sequence[Sequence[tuple[int, int]]], rounds: int = 80, rate: float = 0.2, decay: float = 2.5e-5, context_decay: float = 1e-4, min_count: int = 3) -> SkipChainCRF:
        """Fit on labelled texts. ``context_decay`` holds down what neighbours say, ``decay`` what a token says itself. Features of fewer than ``min_count`` tokens are left out, so that unseen words stay possible."""
        counts: dict[str, int] = {}
        for t in texts:
            for k in t:
                counts[k] = counts.get(k, 0) + 1
        keys = {k: i for i, k in enumerate([EDGE, *counts])}
        seen: dict[str, int] = {}
        named = [self.features(k) for k in keys]
        for k, f in zip(keys, named):
            for x in f:
                seen[x] = seen.get(x, 0) + counts.get(k, min_count)
        self.index = {x: i for i, x in enumerate(x for x, c in seen.items() if c >= min_count)}
        # keys of the same features share a row
        rows: dict[tuple[int, ...], int] = {}
        keys = {k: rows.setdefault(tuple(self.index[x] for x in f if x in self.index), len(rows)) for k, f in zip(keys, named)}
        n, m, nf = len(self.labels), len(rows), len(self.index)
        owner, feat = np.array([(i, x) for f, i in rows.items() for x in f]).T
        groups: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            if t:
                groups.setdefault(len(t), []).append(i)
        data = [(np.array([[keys[k] for k in texts[i]] for i in g]), np.array([labels[i] for i in g])) for g in groups.values()]
        total = sum(len(x) for x, _ in data)
        # the key that stands at each offset from each token of the data, in one row per offset
        padded = [np.pad(x, ((0, 0), (2, 2))) for x, _ in data]
        spoken = [np.concatenate([p[:, 2 + o : 2 + o + x.shape[1]].ravel() for p, (x, _) in zip(padded, data)]) for o in OFFSETS]
        params = [np.zeros((len(OFFSETS), nf, n)), np.zeros((n, n)), np.zeros(n), np.zeros(n)]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        strength = np.array([decay if o == 0 else context_decay for o in OFFSETS])[:, None, None]
        add = lambda at, values, size: np.stack([np.bincount(at, values[:, k], size) for k in range(n)], 1)
        for step in range(1, rounds + 1):
            self._load(params)
            self._rows, self._keys = np.stack([add(owner, w[feat], m) for w in self.weights], 1).astype(np.float32), keys
            grads = [np.zeros_like(p) for p in params]
            off = []
            for x, y in data:
                e = self.emissions(x)
                fwd, bwd, _ = self._chain(e)
                p = fwd * bwd
                p /= p.sum(2, keepdims=True)
                gold = np.eye(n)[y]
                d = gold - p
                off.append(d.reshape(-1, n))
                grads[2] += d[:, 0].sum(0)
                grads[3] += d[:, -1].sum(0)
                if x.shape[1] > 1:
                    a, xs = np.exp(self.transition), np.exp(e - e.max(2, keepdims=True))
                    right = bwd[:, 1:] * xs[:, 1:]
                    right[:, -1] *= np.exp(self.last)
                    joint = np.einsum("btl,btk->btlk", fwd[:, :-1], right) * a
                    joint /= joint.sum((2, 3), keepdims=True)
                    grads[1] += np.einsum("btl,btk->lk", gold[:, :-1], gold[:, 1:]) - joint.sum((0, 1))
            off = np.concatenate(off)
            for i, at in enumerate(spoken):
                grads[0][i] = add(feat, add(at, off, m)[owner], nf)
            for i, (p, g) in enumerate(zip(params, grads)):
                g = g / total - (strength * p if i == 0 else 0)
                m1[i], m2[i] = 0.9 * m1[i] + 0.1 * g, 0.99 * m2[i] + 0.01 * g * g
                p += rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-7)
        self._load(params)
        self._forget()
        self.fit_skip(texts, labels, links)
        return self

    def _load(self, params: list[np.ndarray]) -> None:
        self.weights, self.transition, self.first, self.last = (p.astype(np.float32) for p in params)

    def fit_skip(self, texts: Sequence[Sequence[str]], labels: Sequence[Sequence[int]], links: Sequence[Sequence[tuple[int, int]]], rounds: int = 60) -> None:
        """Skip potentials that explain how often linked tokens share each label, given what the chain says of either."""
        a, b, y = [], [], []
        for t, gold, ls in zip(texts, labels, links):
            if ls:
                p = self.marginals(self.emissions(np.array([self.ids(t)])))[0]
                for i, j in ls:
                    a.append(p[i])
                    b.append(p[j])
                    y.append((gold[i], gold[j]))
        if not a:
            return
        u, v, theta = np.array(a) ** 0.5, np.array(b) ** 0.5, np.zeros(len(self.labels))
        same = np.array([i if i == j else -1 for i, j in y])
        for _ in range(rounds):
            joint = u[:, :, None] * v[:, None] * np.exp(np.diag(theta))
            joint /= joint.sum((1, 2), keepdims=True)
            expected = np.einsum("bii->bi", joint)
            observed = np.eye(len(theta))[np.maximum(same, 0)] * (same >= 0)[:, None]
            theta += 2.0 * ((observed - expected).mean(0) - 0.01 * theta)
        self.skip = np.clip(theta, 0, 4).astype(np.float32)
