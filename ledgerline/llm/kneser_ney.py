"""Interpolated modified Kneser-Ney bigram model: the formulas, over arrays and count tables.

p(v | u) = max(c(uv) - D(c(uv)), 0) / c(u) + gamma(u) * p1(v), where p1 is the same one level down, over the numbers of
different words before v, and is interpolated with a uniform distribution. D has a value for counts 1, 2 and 3 or more.
"""

import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

Spell = Callable[[list[str]], Iterable[Iterable[tuple[int, str]]]]
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: What a token becomes that can't be spelled in pieces that trusted texts have.
CLASSES = ("<start>", "<lower>", "<title>", "<upper>", "<number>", "<mixed>", "<sign>")


def class_of(token: str) -> int:
    if token.isalpha():
        return 1 if token.islower() else 2 if token.istitle() else 3 if token.isupper() else 5
    if token.isdigit():
        return 4
    return 5 if token[0].isalnum() or token[0] == "_" else 6


class Coding:
    """Tokens to ids: the classes, then the vocabulary, then the pieces in which all other tokens are spelled.

    `spell` gives the pieces of tokens, as (number, text) pairs; `pieces` are the numbers of those that have an id. Another
    piece, and without `spell` another token, becomes its class.
    """

    def __init__(self, vocabulary: list[str], pieces: Iterable[int], spell: Spell | None = None) -> None:
        self.ids = {w: (i,) for i, w in enumerate(vocabulary, len(CLASSES))}
        self.pieces = {p: i for i, p in enumerate(sorted(pieces), len(CLASSES) + len(vocabulary))}
        self.size = len(CLASSES) + len(vocabulary) + len(self.pieces)
        self.spell = spell

    def _spelled(self, tokens: list[str]) -> Iterable[tuple[int, ...]]:
        if self.spell is None:
            return ((class_of(t),) for t in tokens)
        get = self.pieces.get
        return (tuple([class_of(x) if (i := get(p)) is None else i for p, x in found]) for found in self.spell(tokens))

    def many(self, texts: list[str | None]) -> list[tuple[list[int], int]]:
        """Of each text its ids with `<start>` in front, and its number of tokens."""
        tokens = [TOKEN.findall(t or "") for t in texts]
        rest = list(set().union(*tokens) - self.ids.keys())
        ids = self.ids | dict(zip(rest, self._spelled(rest), strict=True)) if rest else self.ids
        return [([0, *chain.from_iterable(map(ids.__getitem__, some))], len(some)) for some in tokens]

    def __call__(self, text: str | None) -> tuple[list[int], int]:
        return self.many([text])[0]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D for counts 1, 2, 3 and more, from how many things have count 1, 2, 3 and 4; 0.5, 1, 1.5 if there are too few."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), k) for k, d in enumerate(raw, 1))


def unigram(before: np.ndarray) -> np.ndarray:
    """p1 of every id from the number of different ids seen before it."""
    total = int(before.sum())
    if not total:
        return np.full(len(before), 1 / max(1, len(before)))
    d = np.array([0.0, *discounts([int((before == k).sum()) for k in (1, 2, 3, 4)])])
    off = np.minimum(d[np.minimum(before, 3)], before)
    return (before - off) / total + off.sum() / total / len(before)


def perplexity_score(log_sum: float, n: int, prior: float, weight: float) -> float:
    """Mean negative log likelihood, drawn to `prior` as if `weight` more tokens had it: short texts say little."""
    return (log_sum + weight * prior) / (n + weight)
