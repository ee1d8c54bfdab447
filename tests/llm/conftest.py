import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "mountain", "quiet", "letter", "window", "garden", "silver", "winter", "summer", "engine", "market", "travel", "number", "figure"]


@pytest.fixture(scope="session")
def make():
    """Texts of n random words; the same for the same seed."""

    def text(seed: int, n: int, words: int = 400) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(words)) for _ in range(n))

    return text
