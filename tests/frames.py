"""Small frames shared by tests, drawn at random with a fixed seed."""

import random

GOODS = ["tea", "rice", "salt", "Soap"]
STATES = ["open", "sent", "done", "on hold"]
DEALS_SCHEMA = "id long, units long, price double, good string, state string, note string, paid boolean"


def random_deals(count=90, seed=77):
    """Each cell is drawn by itself: amounts from uneven ranges, texts built of random syllables and marks, some empty, some null."""
    rng = random.Random(seed)

    def maybe(value, share):
        return None if rng.random() < share else value

    def note():
        words = ["".join(rng.choice(["te", "Ri", "so", "al", "ap", "!"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 3))]
        return " ".join(words)

    return [
        (n, rng.choice([rng.randint(-3, 9), rng.randint(10, 99)]), maybe(rng.randint(0, 31) / 4, 0.15), rng.choice(GOODS), rng.choice(STATES), maybe(note(), 0.2), maybe(rng.random() < 0.5, 0.2))
        for n in rng.sample(range(1, count + 1), count)
    ]


def as_dicts(rows, schema):
    names = [part.split()[0] for part in schema.split(", ")]
    return [dict(zip(names, r)) for r in rows]
