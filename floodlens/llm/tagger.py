"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Windows of a fixed length run through the network in batches. Training maximises the CRF likelihood of labelled
windows by Adam on gradients written out below. Decoding blends what overlapping windows say about a character and
takes the best path over the whole stretch they cover.
"""

from __future__ import annotations

import numpy as np

NEGATIVE = -1e4
#: Characters: digits share a code, so do letters outside ASCII, white space, and everything else unknown.
DIGIT, BLANK, LETTER, OTHER, PAD = 0, 1, 2, 3, 4
CODES = 5 + 95
_ASCII = np.full(128, OTHER, np.int64)
_ASCII[33:127] = np.arange(5, 5 + 94)
_ASCII[48:58] = DIGIT
_ASCII[[9, 10, 11, 12, 13, 32]] = BLANK


def char_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], LETTER)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Embedding, forward and backward LSTM, linear emissions, CRF. ``tags`` is the number of labels."""

    def __init__(self, tags: int, hidden: int = 16, embedding: int = 12, window: int = 64, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
        self.window, self.hidden = window, hidden
        self.p = {
            "embed": rng.normal(0, 0.3, (CODES, embedding)).astype(np.float32),
            "wx": scale(2, embedding, 4 * hidden), "wh": scale(2, hidden, 4 * hidden),
            "b": np.zeros((2, 1, 4 * hidden), np.float32),
            "out": scale(2 * hidden, tags), "bias": np.zeros(tags, np.float32),
            "move": np.zeros((tags, tags), np.float32), "begin": np.zeros(tags, np.float32)}
        self.p["b"][:, :, hidden:2 * hidden] = 1  # remember at first

    def emissions(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(windows, length) codes to (windows, length, tags) scores. ``keep`` collects what the gradient needs."""
        p, h = self.p, self.hidden
        n, length = codes.shape
        x = p["embed"][codes]
        both = np.stack([x, x[:, ::-1]])                             # the second direction reads backward
        drive = np.matmul(both, p["wx"][:, None]) + p["b"][:, None]  # (2, n, length, 4h)
        state = np.zeros((2, n, h), np.float32)
        memory = np.zeros_like(state)
        states = np.empty((2, n, length, h), np.float32)
        steps = []
        for t in range(length):
            gates = drive[:, :, t] + np.matmul(state, p["wh"])
            gates[..., :3 * h] = sigmoid(gates[..., :3 * h])
            gates[..., 3 * h:] = np.tanh(gates[..., 3 * h:])
            i, f, o, g = (gates[..., k * h:(k + 1) * h] for k in range(4))
            before, old = state, memory
            memory = f * memory + i * g
            squashed = np.tanh(memory)
            state = o * squashed
            states[:, :, t] = state
            if keep is not None:
                steps.append((before, old, i, f, o, g, squashed))
        joint = np.concatenate([states[0], states[1][:, ::-1]], axis=-1)
        if keep is not None:
            keep += [both, steps, joint]
        return joint @ p["out"] + p["bias"]

    def _crf(self, scores: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Loss per window and its gradients for emissions, transitions and first tags."""
        n, length, tags = scores.shape
        move, begin = self.p["move"].astype(np.float64), self.p["begin"].astype(np.float64)
        s = scores.astype(np.float64)
        alpha, beta = np.empty((n, length, tags)), np.zeros((n, length, tags))
        alpha[:, 0] = begin + s[:, 0]

        def total(x, axis):
            most = x.max(axis=axis, keepdims=True)
            return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))

        for t in range(1, length):
            alpha[:, t] = s[:, t] + total(alpha[:, t - 1, :, None] + move, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = total(move + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        whole = total(alpha[:, -1], 1)
        rows, steps = np.arange(n)[:, None], np.arange(length)
        path = s[rows, steps, gold].sum(1) + begin[gold[:, 0]] + move[gold[:, :-1], gold[:, 1:]].sum(1)
        loss = float((whole - path).mean())
        ds = np.exp(alpha + beta - whole[:, None, None])
        pairs = np.exp(alpha[:, :-1, :, None] + move + (s[:, 1:] + beta[:, 1:])[:, :, None, :]
                       - whole[:, None, None, None]).sum((0, 1))
        np.subtract.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        ds[rows, steps, gold] -= 1
        return loss, (ds / n).astype(np.float32), (pairs / n).astype(np.float32), (ds[:, 0].sum(0) / n).astype(np.float32)

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, h = self.p, self.hidden
        keep: list = []
        loss, ds, d_move, d_begin = self._crf(self.emissions(codes, keep), gold)
        both, steps, joint = keep
        n, length, _ = both.shape[1:]
        grad = {"move": d_move, "begin": d_begin, "bias": ds.sum((0, 1)),
                "out": joint.reshape(-1, 2 * h).T @ ds.reshape(-1, ds.shape[-1])}
        d_joint = ds @ p["out"].T
        d_states = np.stack([d_joint[..., :h], d_joint[:, ::-1, h:]])
        d_gates = np.empty((2, n, length, 4 * h), np.float32)
        d_state, d_memory = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        grad["wh"] = np.zeros_like(p["wh"])
        back = p["wh"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            before, old, i, f, o, g, squashed = steps[t]
            d_state = d_state + d_states[:, :, t]
            d_memory = d_memory + d_state * o * (1 - squashed * squashed)
            d = d_gates[:, :, t]
            d[..., :h] = d_memory * g * i * (1 - i)
            d[..., h:2 * h] = d_memory * old * f * (1 - f)
            d[..., 2 * h:3 * h] = d_state * squashed * o * (1 - o)
            d[..., 3 * h:] = d_memory * i * (1 - g * g)
            grad["wh"] += np.matmul(before.transpose(0, 2, 1), d)
            d_state, d_memory = np.matmul(d, back), d_memory * f
        flat = d_gates.reshape(2, n * length, 4 * h)
        grad["wx"] = np.matmul(both.reshape(2, n * length, -1).transpose(0, 2, 1), flat)
        grad["b"] = flat.sum(1, keepdims=True)
        d_x = np.matmul(flat, p["wx"].transpose(0, 2, 1)).reshape(both.shape)
        d_x = d_x[0] + d_x[1][:, ::-1]
        grad["embed"] = np.zeros_like(p["embed"])
        np.add.at(grad["embed"], codes.ravel(), d_x.reshape(-1, d_x.shape[-1]))
        return loss, grad

    def fit(self, codes: np.ndarray, gold: np.ndarray, steps: int = 400, batch: int = 32, rate: float = 0.03,
            seed: int = 7) -> list[float]:
        """Adam with a falling rate over random batches; returns the losses."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(codes), batch)
            loss, grad = self.gradients(codes[rows], gold[rows])
            losses.append(loss)
            now = rate * (1 - step / (steps + 1))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.98 * second[k] + 0.02 * g * g
                self.p[k] -= now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.98 ** step)) + 1e-6)
        return losses

    def best_paths(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of each stretch; ``scores`` is padded to the longest, ``lengths`` says how far each one goes."""
        n, longest, tags = scores.shape
        move = self.p["move"]
        value = self.p["begin"] + scores[:, 0]
        came = np.zeros((n, longest, tags), np.int8)
        for t in range(1, longest):
            ways = value[:, :, None] + move
            came[:, t] = ways.argmax(1)
            # a stretch that has ended keeps its values
            value = np.where((t < lengths)[:, None], ways.max(1) + scores[:, t], value)
        out = np.zeros((n, longest), np.int64)
        tag = value.argmax(1)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            inside = t < lengths
            out[:, t] = np.where(inside, tag, 0)
            if t:
                tag = np.where(inside, came[rows, t, tag], tag)
        return out

    def tag(self, stretches: list[np.ndarray], batch: int = 512) -> list[np.ndarray]:
        """Tags of stretches of codes. Windows overlap by half; a character's scores are their mean, weighted by the
        distance to the window's edge, and one path is decoded over the whole stretch."""
        w, half = self.window, self.window // 2
        owner, offset = [], []
        for k, s in enumerate(stretches):
            for begin in range(0, max(1, len(s) - half), half):
                owner.append(k)
                offset.append(begin)
        if not owner:
            return []
        trust = np.minimum(np.arange(1, w + 1), np.arange(w, 0, -1)).astype(np.float32)
        tags = len(self.p["bias"])
        total = [np.zeros((len(s), tags), np.float32) for s in stretches]
        weight = [np.zeros((len(s), 1), np.float32) for s in stretches]
        for at in range(0, len(owner), batch):
            codes = np.full((min(batch, len(owner) - at), w), PAD, np.int64)
            for row, (k, begin) in enumerate(zip(owner[at:at + batch], offset[at:at + batch])):
                part = stretches[k][begin:begin + w]
                codes[row, :len(part)] = part
            for row, scores in enumerate(self.emissions(codes)):
                k, begin = owner[at + row], offset[at + row]
                part = total[k][begin:begin + w]
                part += scores[:len(part)] * trust[:len(part), None]
                weight[k][begin:begin + w] += trust[:len(part), None]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(stretches)
        order = sorted((k for k in range(len(stretches)) if len(stretches[k])), key=lambda k: len(stretches[k]))
        for at in range(0, len(order), batch):
            several = order[at:at + batch]
            # a few very long stretches go alone, so that padding stays small
            groups = [several] if len(stretches[several[-1]]) <= 4096 else [[k] for k in several]
            for group in groups:
                lengths = np.array([len(stretches[k]) for k in group])
                padded = np.zeros((len(group), lengths.max(), tags), np.float32)
                for row, k in enumerate(group):
                    padded[row, :lengths[row]] = total[k] / weight[k]
                for row, path in enumerate(self.best_paths(padded, lengths)):
                    out[group[row]] = path[:lengths[row]]
        return out
