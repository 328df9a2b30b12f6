import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega Straße 東京 café".split()


def text(r: random.Random, n: int) -> str:
    return " ".join(r.choices(WORDS, k=n))


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))
