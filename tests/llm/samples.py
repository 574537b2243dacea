"""Odd rows and random words for the tests of this folder."""


def words(rng, n, syllables="ba be bi bo bu ca ce ci co cu da de di do du".split()):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


#: Null id and text, empty and blank texts, a very long line, repeated rows, marks beyond the basic plane.
ODD = [(None, None), (None, "text without id"), (1, ""), (2, " \n\t "), (3, "x" * 200_000), (4, "same"), (4, "same"), (5, "\U0001f600 é \x00 z"), (6, "\n\n\n"), (7, None)]
