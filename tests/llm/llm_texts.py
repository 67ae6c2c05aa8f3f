"""Invented prose for the tests."""

from __future__ import annotations

import random


def prose(seed: int, words: int) -> str:
    dice = random.Random(seed)
    return " ".join("".join(dice.choice("abcdeghilmnorstu") for _ in range(dice.randint(2, 9))) for _ in range(words))
