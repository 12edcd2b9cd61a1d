import random


def prose(seed, n, alphabet="abcdefghijklmnop"):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(max(3, n // 3))]
    return " ".join(rng.choice(words) for _ in range(n))


def rows_of(frame, *columns):
    """Rows as tuples in order, nulls of the first column first."""
    rows = [tuple(r) for r in frame.select(*columns).collect()]
    return ordered(rows)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, str(type(r[0])), r if r[0] is not None else r[1:]))
