"""Invented texts."""

import random

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards mix strange potions near old stone towers".split()


def prose(seed: int, n: int) -> str:
    """Invented words, so that two seeds share no passage."""
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(n))
