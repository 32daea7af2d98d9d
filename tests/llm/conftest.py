from __future__ import annotations

import random

import pytest

NAMES = ["Pascoe Haskingwick", "Vincent Ruskerez", "Zelda Wexorley", "Bram Caldan", "Ines Marvez", "Noemi Grinich"]
VERBS = ["will gladly pay for", "refuses to discuss", "has always depended on", "can hardly explain"]
THINGS = ["the winter fuel shortage", "a decade of broken promises", "its own training records", "two rival standards"]


@pytest.fixture
def sentence():
    def make(rng: random.Random) -> str:
        return f"{rng.choice(NAMES)} said that the film archive under {rng.choice(NAMES)} {rng.choice(VERBS)} {rng.choice(THINGS)} within {rng.randrange(99999)} days."

    return make
