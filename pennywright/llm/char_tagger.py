"""A character tagger in numpy: two LSTMs, one each way, under a CRF of tag transitions.

Windows of texts are arrays of character ids; tags are 0 (none) and, for kind k, 2k + 1 (first
character) and 2k + 2 (further ones).  Training is Adam on the CRF's negative log likelihood with
gradients written out; nothing here depends on Spark.
"""

from dataclasses import dataclass, field

import numpy as np

#: Ids of characters: 0 pads, ASCII 32-126 have their own, white space and the rest share some.
PAD, BREAK, LETTER, DIGIT, SPACE_LIKE, OTHER = 0, 96, 97, 98, 99, 100
SYMBOLS = 101
LOW = -1e4  # score of a transition that cannot be


def character_id(c: str) -> int:
    if " " <= c <= "~":
        return ord(c) - 31
    if c in "\n\r\t\x0b\x0c":
        return BREAK
    return LETTER if c.isalpha() else DIGIT if c.isdigit() else SPACE_LIKE if c.isspace() else OTHER


_TABLE = np.array([character_id(chr(i)) for i in range(128)], np.int16)


def _sort(i: int) -> int:
    """The id of the first character of a sort: digits, small and capital letters; others alone."""
    c = chr(i + 31) if 0 < i < BREAK else ""
    return character_id("0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c) if c else i


def character_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ids = _TABLE[np.minimum(codes, 127)]
    for at in np.flatnonzero(codes > 127):
        ids[at] = character_id(text[at])
    return ids


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def allowed(tags: int) -> np.ndarray:
    """[from, to]: 0, or LOW where a further character follows no character of its kind."""
    out = np.zeros((tags, tags), np.float32)
    for to in range(2, tags, 2):
        out[:, to] = LOW
        out[to - 1, to] = out[to, to] = 0
    return out


@dataclass
class Tagger:
    """Weights by name: inputs (2, SYMBOLS, 4H), hidden (2, H, 4H), bias, output (2H, K), moves (K, K)."""

    kinds: int
    width: int = 24
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int) -> "Tagger":
        rng = np.random.default_rng(seed)
        h, k = self.width, 2 * self.kinds + 1
        bias = np.zeros((2, 1, 4 * h))
        # characters of a sort begin alike, so that what is learnt from one digit holds for all
        sorts = np.array([_sort(i) for i in range(SYMBOLS)])
        alike = rng.normal(0, 0.5, (2, SYMBOLS, 4 * h))[:, sorts]
        bias[:, :, h: 2 * h] = 1  # remember at first
        self.weights = {n: v.astype(np.float32) for n, v in {
            "inputs": alike + rng.normal(0, 0.1, (2, SYMBOLS, 4 * h)),
            "hidden": rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)), "bias": bias,
            "output": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, k)), "shift": np.zeros(k),
            "moves": rng.normal(0, 0.1, (k, k)), "first": np.zeros(k)}.items()}
        return self

    # --- the LSTMs, both directions at once: axis 0 is the direction

    def _states(self, ids: np.ndarray, keep: bool):
        """ids (B, T) -> hidden states (T, 2, B, H), backward ones in reversed time."""
        w, h = self.weights, self.width
        b, t = ids.shape
        both = np.stack([ids, ids[:, ::-1]])  # (2, B, T)
        table = w["inputs"] + w["bias"]
        out = np.zeros((t, 2, b, h), np.float32)
        cell, hidden = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        kept = []
        for i in range(t):
            x = np.stack([table[0][both[0, :, i]], table[1][both[1, :, i]]])
            z = x + hidden @ w["hidden"]
            gates = _sigmoid(z[:, :, : 3 * h])
            new = np.tanh(z[:, :, 3 * h:])
            before = cell
            cell = gates[:, :, h: 2 * h] * cell + gates[:, :, :h] * new
            squashed = np.tanh(cell)
            last, hidden = hidden, gates[:, :, 2 * h:] * squashed
            out[i] = hidden
            if keep:
                kept.append((gates, new, before, squashed, last))
        return out, both, kept

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(T, B, K) scores of tags."""
        out, _, _ = self._states(ids, False)
        joined = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        return joined @ self.weights["output"] + self.weights["shift"]

    def moves(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of transitions, and of first tags (any kind may be cut by a window's start)."""
        return self.weights["moves"] + allowed(2 * self.kinds + 1), self.weights["first"]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (B, T) by Viterbi, and the emissions (T, B, K)."""
        e = self.emissions(ids)
        moves, first = self.moves()
        t, b, k = e.shape
        back = np.zeros((t, b, k), np.int8)
        score = e[0] + first
        for i in range(1, t):
            paths = score[:, :, None] + moves[None]
            back[i] = paths.argmax(1)
            score = paths.max(1) + e[i]
        tags = np.zeros((b, t), np.int8)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(b)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[i, rows, tags[:, i]]
        return tags, e

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood per window, and its gradient by weight."""
        w, h = self.weights, self.width
        out, both, kept = self._states(ids, True)
        joined = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        e = joined @ w["output"] + w["shift"]
        t, b, k = e.shape
        loss, de, dmoves, dfirst = self._crf(e, tags)
        grad = {"output": np.tensordot(joined, de, ((0, 1), (0, 1))), "shift": de.sum((0, 1)),
                "moves": dmoves, "first": dfirst}
        djoined = de @ w["output"].T
        dout = np.stack([djoined[:, :, :h], djoined[::-1, :, h:]], axis=1)  # (T, 2, B, H)
        dhidden = np.zeros((2, b, h), np.float32)
        dcell = np.zeros((2, b, h), np.float32)
        dweights = np.zeros_like(w["hidden"])
        dz_all = np.zeros((2, t, b, 4 * h), np.float32)
        turned = w["hidden"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            gates, new, before, squashed, last = kept[i]
            enter, stay, leave = gates[:, :, :h], gates[:, :, h: 2 * h], gates[:, :, 2 * h:]
            dh = dout[i] + dhidden
            dc = dcell + dh * leave * (1 - squashed ** 2)
            dgates = np.concatenate([dc * new, dc * before, dh * squashed], axis=2)
            dz = np.concatenate([dgates * gates * (1 - gates), dc * enter * (1 - new ** 2)], axis=2)
            dcell = dc * stay
            dhidden = dz @ turned
            dweights += last.transpose(0, 2, 1) @ dz
            dz_all[:, i] = dz
        dinputs = np.zeros_like(w["inputs"])
        for d in range(2):
            flat = both[d].T.reshape(-1)
            one_hot = np.zeros((len(flat), SYMBOLS), np.float32)
            one_hot[np.arange(len(flat)), flat] = 1
            dinputs[d] = one_hot.T @ dz_all[d].reshape(-1, 4 * h)
        grad |= {"hidden": dweights, "inputs": dinputs, "bias": dinputs.sum(1, keepdims=True)}
        return loss / b, {n: g / b for n, g in grad.items()}

    def _crf(self, e: np.ndarray, tags: np.ndarray):
        """Loss of the windows and its gradients, by the forward-backward recursions."""
        moves, first = self.moves()
        t, b, k = e.shape
        rows, steps = np.arange(b), tags.T  # (T, B)

        def log_sum(x, axis):
            m = x.max(axis, keepdims=True)
            return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)

        ahead = np.zeros_like(e)
        ahead[0] = e[0] + first
        for i in range(1, t):
            ahead[i] = log_sum(ahead[i - 1][:, :, None] + moves[None], 1) + e[i]
        whole = log_sum(ahead[-1], 1)
        behind = np.zeros_like(e)
        dmoves = np.zeros((k, k), np.float32)
        for i in range(t - 2, -1, -1):
            after = moves[None] + (e[i + 1] + behind[i + 1])[:, None, :]
            behind[i] = log_sum(after, 2)
            dmoves += np.exp(ahead[i][:, :, None] + after - whole[:, None, None]).sum(0)
        de = np.exp(ahead + behind - whole[None, :, None])
        gold = e[0, rows, steps[0]] + first[steps[0]]
        dfirst = de[0].sum(0)
        np.subtract.at(dfirst, steps[0], 1)
        for i in range(t):
            de[i, rows, steps[i]] -= 1
            if i:
                gold = gold + e[i, rows, steps[i]] + moves[steps[i - 1], steps[i]]
                np.subtract.at(dmoves, (steps[i - 1], steps[i]), 1)
        return float((whole - gold).sum()), de, dmoves, dfirst

    def fit(self, ids: np.ndarray, tags: np.ndarray, passes: int, batch: int, rate: float,
            seed: int) -> list[float]:
        """Train on windows; the mean loss of every pass."""
        rng = np.random.default_rng(seed)
        m = {n: np.zeros_like(v) for n, v in self.weights.items()}
        v = {n: np.zeros_like(x) for n, x in self.weights.items()}
        losses, step = [], 0
        total = passes * -(-len(ids) // batch)
        for _ in range(passes):
            order, seen = rng.permutation(len(ids)), []
            for i in range(0, len(ids), batch):
                some = order[i: i + batch]
                loss, grad = self.gradients(ids[some], tags[some])
                seen.append(loss)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                pace = rate * min(1.0, step / 20) * (1 - 0.95 * step / total) * min(1.0, 5 / (norm + 1e-9))
                for n, g in grad.items():
                    m[n] += 0.1 * (g - m[n])
                    v[n] += 0.01 * (g * g - v[n])
                    self.weights[n] -= (pace * (m[n] / (1 - 0.9 ** step))
                                        / (np.sqrt(v[n] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses
