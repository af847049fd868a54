"""Sets of languages of any size, and with a small share of a long text."""

import random

import numpy as np

from kasumi.llm import mixture_lid


def test_sets_end_by_likelihood_alone():
    rng = random.Random(8)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)] for k in range(6)}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    model = mixture_lid.Model.fit({x: np.bincount(mixture_lid.grams([text(x, 4000)])[0], minlength=1 << mixture_lid.BITS) for x in words})
    every = " ".join(text(x, 150) for x in words)
    long = " ".join([text("l0", 6000), text("l3", 70), text("l0", 2000)])
    got = [set(np.flatnonzero(row)) for row in model.mixtures([every, long, text("l2", 400)])]
    assert got == [set(range(6)), {0, 3}, {2}]
    assert model.mixtures([long])[0, 3] < 0.02
