"""What the tests of this folder share."""

import random

WORDS = "the of and to in is that for it was on with as be at by this have from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + (rng.choice(["", "", "s", "ed"]))
        out.append(w.capitalize() if i % 9 == 0 else w)
        if i % 9 == 8:
            out[-1] += "." + ("\n" if rng.random() < 0.2 else "")
    return " ".join(out).replace("\n ", "\n")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
