"""The Mersenne Twister over columns of seeds: what Python's random.Random(seed) draws, for many rows at once.

The state is a numpy matrix with a column for each row of a batch, so seeding and twisting are some thousand vector operations
a batch, whatever its number of rows; each column goes on at its own pace. Draws are those of Python's random(), _randbelow()
(choice, randrange, randint) and shuffle().

Defined results: a null seed counts as 0; a negative one as its absolute value, as in Python; a bound below 1 draws nothing and
gives 0; an empty batch gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from reportloom.session import ship

# The sizes and multipliers of the published generator and of its seeding.
_N, _M = 624, 397
_UPPER, _LOWER, _TWIST = np.uint32(0x80000000), np.uint32(0x7FFFFFFF), np.uint32(0x9908B0DF)
_START, _FILL, _FIRST, _SECOND = 19650218, 1812433253, np.uint32(1664525), np.uint32(1566083941)
#: Rows whose states are held together, 2.5 KB each.
_TOGETHER = 4096


def _filled() -> np.ndarray:
    out = [_START]
    for i in range(1, _N):
        out.append((_FILL * (out[-1] ^ out[-1] >> 30) + i) & 0xFFFFFFFF)
    return np.array(out, np.uint32)


class Twister:
    """Generators of a batch, one for each seed; `who` are the numbers of those that draw."""

    def __init__(self, seeds: np.ndarray):
        seeds = np.abs(np.asarray(seeds, np.int64)).view(np.uint64)
        low, high = (seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32)
        state = np.repeat(_filled()[:, None], len(seeds), axis=1)
        long = high > 0  # a key of two words, which take turns
        i = 1
        for turn in range(_N):
            before = state[i - 1]
            key = np.where(long, high + np.uint32(1), low) if turn % 2 else low
            state[i] = (state[i] ^ ((before ^ (before >> np.uint32(30))) * _FIRST)) + key
            i += 1
            if i == _N:
                state[0], i = state[_N - 1], 1
        for _ in range(_N - 1):
            before = state[i - 1]
            state[i] = (state[i] ^ ((before ^ (before >> np.uint32(30))) * _SECOND)) - np.uint32(i)
            i += 1
            if i == _N:
                state[0], i = state[_N - 1], 1
        state[0] = 0x80000000
        self.state, self.at = state, np.full(len(seeds), _N, np.int64)

    def _twist(self, who: np.ndarray) -> None:
        s = self.state[:, who]
        for a, b in ((0, _N - _M), (_N - _M, 2 * (_N - _M)), (2 * (_N - _M), _N - 1), (_N - 1, _N)):  # each part needs those before it
            y = (s[a:b] & _UPPER) | (np.roll(s, -1, axis=0)[a:b] & _LOWER)
            far = s[(np.arange(a, b) + _M) % _N]
            s[a:b] = far ^ (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), _TWIST, np.uint32(0))
        self.state[:, who] = s
        self.at[who] = 0

    def words(self, who: np.ndarray) -> np.ndarray:
        """The next 32 bits of each."""
        if len(out := who[self.at[who] == _N]):
            self._twist(out)
        y = self.state[self.at[who], who]
        self.at[who] += 1
        y = y ^ (y >> np.uint32(11))
        y = y ^ ((y << np.uint32(7)) & np.uint32(0x9D2C5680))
        y = y ^ ((y << np.uint32(15)) & np.uint32(0xEFC60000))
        return y ^ (y >> np.uint32(18))

    def random(self, who: np.ndarray) -> np.ndarray:
        """Numbers in [0, 1) of 53 bits."""
        a, b = self.words(who) >> np.uint32(5), self.words(who) >> np.uint32(6)
        return (a * 67108864.0 + b) / 9007199254740992.0

    def below(self, n: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Whole numbers below n (up to 2**32), drawn anew where the bits give n or more."""
        n = np.asarray(n, np.int64)
        out = np.zeros(len(who), np.int64)
        bits = np.frexp(n.astype(np.float64))[1]
        left = np.flatnonzero(n > 0)
        while len(left):
            drawn = self.words(who[left]).astype(np.int64) >> (32 - bits[left])
            out[left] = drawn
            left = left[drawn >= n[left]]
        return out

    def shuffle(self, size: np.ndarray, who: np.ndarray) -> list[np.ndarray]:
        """The places of lists of these sizes in shuffled order."""
        size = np.asarray(size, np.int64)
        width = int(size.max(initial=0))
        order = np.repeat(np.arange(width)[None, :], len(who), axis=0)
        for i in range(width - 1, 0, -1):
            rows = np.flatnonzero(size > i)
            j = self.below(np.full(len(rows), i + 1), who[rows])
            order[rows, i], order[rows, j] = order[rows, j], order[rows, i].copy()
        return [x[:n] for x, n in zip(order, size.tolist(), strict=True)]


def _seeds(s: pd.Series) -> np.ndarray:
    return s.fillna(0).astype("int64").to_numpy()


def _parts(n: int):
    return (slice(k, min(n, k + _TOGETHER)) for k in range(0, n, _TOGETHER))


def coin_and_choice(seed: Column, size: Column) -> Column:
    """Struct (u, pick) of random.Random(seed): random(), then randrange(size)."""
    ship(SparkSession.active())

    @F.pandas_udf("u double, pick long")
    def drawn(seeds: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        seeds, n = _seeds(seeds), sizes.fillna(0).to_numpy(np.int64)
        u, pick = np.empty(len(n)), np.empty(len(n), np.int64)
        for p in _parts(len(n)):
            t, who = Twister(seeds[p]), np.arange(p.stop - p.start)
            u[p], pick[p] = t.random(who), t.below(n[p], who)
        return pd.DataFrame({"u": u, "pick": pick})

    return drawn(seed.cast("long"), size.cast("long"))


PLAN = "array<struct<order:array<int>,places:array<int>,merged:boolean,style:int>>"


def change_plans(seed: Column, texts: list[tuple[Column, Column, Column]], tries: int, changes: int, merged: float, styles: int) -> Column:
    """What one generator draws for `tries` changes of each of some texts, turn by turn: tries x texts plans.

    A text is (there, sentences, other): whether it has characters, how many sentences may be mixed (0: none), and for each other
    change whether it changes the text. A plan has the order in which changes are tried; where mixing (number 0) is reached, that
    is, no change before it changes the text, it has the drawn places of the sentences, whether short ones are merged, and a style.
    """
    ship(SparkSession.active())

    @F.pandas_udf(PLAN)
    def drawn(seeds: pd.Series, *columns: pd.Series) -> pd.Series:
        seeds, rows = _seeds(seeds), []
        own = [(columns[k].fillna(False).to_numpy(bool), columns[k + 1].fillna(0).to_numpy(np.int64), np.stack(columns[k + 2].to_numpy()).astype(bool) if len(seeds) else np.empty((0, changes - 1), bool)) for k in range(0, len(columns), 3)]
        for p in _parts(len(seeds)):
            t, n = Twister(seeds[p]), p.stop - p.start
            out: list[list] = [[] for _ in range(n)]
            for _ in range(tries):
                for there, sentences, other in own:
                    who = np.flatnonzero(there[p])
                    order = np.full((n, changes), -1)
                    order[who] = np.array(t.shuffle(np.full(len(who), changes), who)).reshape(len(who), changes)
                    works = np.concatenate((np.zeros((n, 1), bool), other[p]), axis=1)
                    before = np.zeros(n, bool)
                    mixing = np.full(n, -1)
                    for k in range(changes):
                        now = order[:, k]
                        mixing = np.where((now == 0) & ~before & (sentences[p] > 0), k, mixing)
                        before |= works[np.arange(n), now] & (now >= 0)
                    who = np.flatnonzero(mixing >= 0)
                    places = t.shuffle(sentences[p][who], who)
                    short, style = t.random(who) < merged, t.below(np.full(len(who), styles), who)
                    drawn_at = {w: k for k, w in enumerate(who.tolist())}
                    for row in range(n):
                        k = drawn_at.get(row)
                        plan = {"order": order[row].tolist() if order[row, 0] >= 0 else [], "places": None, "merged": None, "style": None}
                        out[row].append(plan if k is None else plan | {"places": places[k].tolist(), "merged": bool(short[k]), "style": int(style[k])})
            rows += out
        return pd.Series(rows)

    return drawn(seed.cast("long"), *[c for text in texts for c in text])
