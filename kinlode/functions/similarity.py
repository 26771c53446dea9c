"""String similarities from 0 to 100, Arrow batches in and out. Distinct pairs are computed once in a batch.

The functions of two strings define the results. A batch does the same for many pairs at once: a string of at most 64
letters is a lane of 64 bits, and each step takes the next letter of all pairs. Longer strings go one by one.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def places(a: str) -> dict[str, int]:
    """For each letter of a, the bits of its places."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    return at


def common_length(a: str, b: str, at: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a bit for each letter of a."""
    at = places(a) if at is None else at
    full = row = (1 << len(a)) - 1
    for ch in b:
        if hit := row & at.get(ch, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * common_length(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    one, two = (" ".join([both, *rest] if both else rest) for rest in (left, right))
    best = ratio(one, two)
    return max(best, ratio(both, one), ratio(both, two)) if both else best


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one; windows at the ends may be shorter."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    if a in b:
        return 100.0
    at, best, most = places(a), 0.0, common_length(a, b)
    for i in range(1 - n, len(b)):
        window = b[max(0, i) : i + n]
        # a window is at best as good as all that a and b have in common; one whose outer letter is strange has a better neighbour
        outer = window[0] if i + n > len(b) else window[-1]
        if outer in at and 200.0 * min(most, len(window)) / (n + len(window)) > best:
            best = max(best, 200.0 * common_length(a, window, at) / (n + len(window)))
    return best


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 100.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    score = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if score > 0.7:
        same = 0
        for x, y in zip(a[:4], b[:4], strict=False):
            if x != y:
                break
            same += 1
        score += 0.1 * same * (1 - score)
    return 100 * score


#: Letters in a lane, pairs worked on at once, windows worked on at once, and the longest string cut into windows in lanes.
LANE, PAIRS, WINDOWS, WINDOWED = 64, 512, 200_000, 100_000
_ONES = np.array([(1 << k) - 1 for k in range(LANE + 1)], dtype=np.uint64)
_ONE, _ALL = np.uint64(1), _ONES[LANE]


class Lanes:
    """Pairs (a, b) with a of at most 64 letters. masks[i * width + c] holds the places of letter c in a[i]; `codes` are the
    letters of all b, 64 fillers before, between and after them; a filler or a letter that no a has matches nothing."""

    def __init__(self, a: list[str], b: list[str]):
        flat_a, self.n_a, starts_a = self._letters(a)
        flat_b, self.n_b, starts_b = self._letters(b)
        alphabet, code_a = np.unique(flat_a, return_inverse=True)
        self.width = len(alphabet) + 1
        self.row_a = np.repeat(np.arange(len(a)), self.n_a)
        self.place_a = np.arange(len(flat_a)) - np.repeat(starts_a, self.n_a)
        self.masks = np.zeros(len(a) * self.width, dtype=np.uint64)
        np.bitwise_or.at(self.masks, self.row_a * self.width + code_a, _ONE << self.place_a.astype(np.uint64))
        code_b = np.searchsorted(alphabet, flat_b)
        code_b[np.append(alphabet, 0)[code_b] != flat_b] = self.width - 1
        code_b[code_b == len(alphabet)] = self.width - 1
        self.start = starts_b + LANE * (1 + np.arange(len(b)))
        self.codes = np.full(len(flat_b) + LANE * (len(b) + 1), self.width - 1, dtype=np.int64)
        self.codes[np.arange(len(flat_b)) + np.repeat(self.start - starts_b, self.n_b)] = code_b

    @staticmethod
    def _letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), size, np.cumsum(size) - size

    def common(self, row: np.ndarray, at: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """common_length() of a[row] and the `steps` letters from place `at` of the codes on."""
        order = np.argsort(-steps, kind="stable")
        base, at, left = row[order] * self.width, at[order], -steps[order]
        state = np.full(len(row), _ALL)
        for t, k in enumerate(np.searchsorted(left, -np.arange(-left[0] if len(left) else 0)).tolist()):
            hit = state[:k] & self.masks[base[:k] + self.codes[at[:k] + t]]
            state[:k] = (state[:k] + hit) | (state[:k] - hit)
        out = np.empty(len(row), dtype=np.int64)
        out[order] = np.bitwise_count(~state)
        return out


def _parts(pairs: list[tuple[str, str]], rows: Callable[[str, str], int], most: int) -> Iterator[list[int]]:
    """Indices of the pairs, cut after PAIRS pairs or `most` rows."""
    part, total = [], 0
    for i, (a, b) in enumerate(pairs):
        n = rows(a, b)
        if part and (len(part) == PAIRS or total + n > most):
            yield part
            part, total = [], 0
        part.append(i)
        total += n
    if part:
        yield part


def _shorter_first(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]


def ratios(pairs: list[tuple[str, str]]) -> list[float]:
    pairs = _shorter_first(pairs)
    out = [0.0 if len(a) <= LANE and b else ratio(a, b) for a, b in pairs]
    short = [i for i, (a, b) in enumerate(pairs) if len(a) <= LANE and b]
    chosen = [pairs[i] for i in short]
    for part in _parts(chosen, lambda a, b: len(b), WINDOWS):
        lanes = Lanes(*map(list, zip(*(chosen[i] for i in part), strict=True)))
        score = 200.0 * lanes.common(np.arange(len(part)), lanes.start, lanes.n_b) / (lanes.n_a + lanes.n_b)
        for i, x in zip(part, score.tolist(), strict=True):
            out[short[i]] = x
    return out


def token_sorts(pairs: list[tuple[str, str]]) -> list[float]:
    return ratios([(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) for a, b in pairs])


def token_sets(pairs: list[tuple[str, str]]) -> list[float]:
    out, asked = [], []
    for i, (a, b) in enumerate(pairs):
        x, y = set(a.split()), set(b.split())
        both, left, right = " ".join(sorted(x & y)), sorted(x - y), sorted(y - x)
        if not x or not y or (both and (not left or not right)):
            out.append(100.0 if x and y else 0.0)
            continue
        one, two = (" ".join([both, *rest] if both else rest) for rest in (left, right))
        # the common words begin both strings, so all their letters are common
        out.append(200.0 * len(both) / (len(both) + min(len(one), len(two))) if both else 0.0)
        asked.append((i, (one, two)))
    for (i, _), score in zip(asked, ratios([pair for _, pair in asked]), strict=True):
        out[i] = max(out[i], score)
    return out


def partials(pairs: list[tuple[str, str]]) -> list[float]:
    pairs = _shorter_first(pairs)
    hard = [i for i, (a, b) in enumerate(pairs) if a and len(a) <= LANE and len(b) <= WINDOWED and a not in b]
    lanes_do = set(hard)
    out = [0.0 if i in lanes_do else partial(a, b) for i, (a, b) in enumerate(pairs)]
    chosen = [pairs[i] for i in hard]
    for part in _parts(chosen, lambda a, b: len(a) + len(b), WINDOWS):
        lanes = Lanes(*map(list, zip(*(chosen[i] for i in part), strict=True)))
        count = lanes.n_a + lanes.n_b - 1
        row = np.repeat(np.arange(len(part)), count)
        first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1 - lanes.n_a[row]
        n = lanes.n_a[row]
        size = np.minimum(first + n, lanes.n_b[row]) - np.maximum(first, 0)
        score = 200.0 * lanes.common(row, lanes.start[row] + first, n) / (n + size)
        for i, x in zip(part, np.maximum.reduceat(score, np.cumsum(count) - count).tolist(), strict=True):
            out[hard[i]] = x
    return out


def jaro_winklers(pairs: list[tuple[str, str]]) -> list[float]:
    hard = [i for i, (a, b) in enumerate(pairs) if a and b and a != b and max(len(a), len(b)) <= LANE]
    lanes_do = set(hard)
    out = [0.0 if i in lanes_do else jaro_winkler(a, b) for i, (a, b) in enumerate(pairs)]
    for lo in range(0, len(hard), PAIRS):
        part = hard[lo : lo + PAIRS]
        for i, x in zip(part, _jaro_winkler_lanes([pairs[i][0] for i in part], [pairs[i][1] for i in part]).tolist(), strict=True):
            out[i] = x
    return out


def _jaro_winkler_lanes(a: list[str], b: list[str]) -> np.ndarray:
    lanes = Lanes(b, a)  # the places are b's, the letters that are walked are a's
    n_a, n_b, rows = lanes.n_b, lanes.n_a, np.arange(len(a))
    reach = np.maximum(0, np.maximum(n_a, n_b) // 2 - 1)
    used, mine = np.zeros(len(a), dtype=np.uint64), np.zeros(len(a), dtype=np.uint64)
    for t in range(int(n_a.max())):
        code = np.where(t < n_a, lanes.codes[np.minimum(lanes.start + t, len(lanes.codes) - 1)], lanes.width - 1)
        near = _ONES[np.minimum(n_b, t + reach + 1)] & ~_ONES[np.clip(t - reach, 0, LANE)]
        free = lanes.masks[rows * lanes.width + code] & near & ~used
        used |= free & (~free + _ONE)
        mine |= (free != 0).astype(np.uint64) << np.uint64(t)
    m = np.bitwise_count(mine).astype(np.int64)
    moved, x, y = np.zeros(len(a), dtype=np.int64), mine, used
    for _ in range(int(m.max())):
        i, j = (np.bitwise_count((z & (~z + _ONE)) - _ONE).astype(np.int64) for z in (x, y))
        on = x != 0
        code = lanes.codes[lanes.start + np.where(on, i, 0)]
        moved += on & ((lanes.masks[rows * lanes.width + code] >> np.where(on, j, 0).astype(np.uint64)) & _ONE == 0)
        x, y = x & (x - _ONE), y & (y - _ONE)
    some = np.maximum(m, 1)
    score = np.where(m > 0, (m / n_a + m / n_b + (m - moved // 2) / some) / 3, 0.0)
    same = np.array([next((k for k, (p, q) in enumerate(zip(s[:4], t[:4], strict=False)) if p != q), min(4, len(s), len(t))) for s, t in zip(a, b, strict=True)])
    return 100 * np.where(score > 0.7, score + 0.1 * same * (1 - score), score)


KINDS = {"ratio": ratios, "token_sort": token_sorts, "token_set": token_sets, "partial": partials, "jaro_winkler": jaro_winklers}


def _udf(kind: str):
    scores = KINDS[kind]

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], int] = {}
        at = [known.setdefault((x, y), len(known)) if x is not None and y is not None else -1 for x, y in zip(a, b, strict=True)]
        found = [*scores(list(known)), None]
        return pd.Series([found[i] for i in at], dtype=object)

    return run


def similarity(kind: str, a: Column, b: Column) -> Column:
    """Null where a side is null."""
    return _udf(kind)(a, b)
