import numpy as np
import pytest


@pytest.fixture(scope="session")
def prose():
    """A generator of texts from a few invented words a language."""
    words = {"aa": "the of and to in is that with for was on at by from".split(),
             "bb": "der die das und ist nicht mit auf für ein schön über".split(),
             "cc": "el la los que de en y por para una más niño".split()}

    def make(lang, n, seed):
        rng = np.random.default_rng(seed)
        return " ".join(rng.choice(words[lang], n).tolist())
    return make
