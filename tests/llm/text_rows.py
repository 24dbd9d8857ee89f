"""Made-up sentences for the tests of the text operators."""

import random

STEMS = "the of and river stone market lantern copper winter orchard signal harbour violet engine meadow thunder".split()


def sentence(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(STEMS) + rng.choice(["", "a", "or", "ine", "esk", "um"]) for _ in range(words))
