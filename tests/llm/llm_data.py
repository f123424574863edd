"""Texts that every operator must cope with."""

WORDS = "amber basil cedar delta ember fjord grove heron inlet jasper kelp linden maple nectar opal pine quartz raven sable tulip".split()


def prose(seed: int, n: int) -> str:
    """Words in an order that depends on the seed."""
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + WORDS[(state >> 16) % len(WORDS)][:2])
    return " ".join(out)


#: Missing, empty, blank, very long, repeated and tied rows, and columns whose names clash with inner ones.
EDGE_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "short"),
    (5, prose(1, 300)),
    (6, prose(1, 300)),
    (7, prose(2, 60_000)),
    (8, prose(3, 200)),
    (8, prose(3, 200)),
    (8, prose(4, 200)),
    (None, prose(1, 300)),
    (9, "\x00  \U0001f600 ñandú\n" * 40),
    (10, "a" * 3000),
]
CLASHING = ["n", "score", "y", "fp", "a", "b", "key", "spans", "bucket", "kept", "__all", "component_id", "n_tokens", "weight"]
