"""Invented texts for the tests."""

import random

SYLLABLES = "th er in on an re ed nd ha to en es of ou ea ti at st is or le ar te".split()


def prose(seed: int, n: int) -> str:
    """Invented words with frequent function words, the same for a seed."""
    r = random.Random(seed)
    words = []
    for _ in range(n):
        words.append(r.choice(["the", "of", "and", "to"]) if r.random() < 0.3 else "".join(r.choices(SYLLABLES, k=r.randint(2, 4))))
    return " ".join(words).capitalize() + "."


ODD_TEXTS = [
    None,
    "",
    " \t\n\x0b\f\r ",
    "one",
    "MIT License",
    "the mit\nlicense and the Apache License, GNU General Public License v3",
    "Ünïcode Ñandú Kelvin İstanbul ﬁ 𝔘𝔫𝔦 é   thin\x1cspace \x85next \xa0hard",
    "x" * 5000,
    "a b c " * 400,
    "tab\tand\nnewline\n\n  double  spaces   here\n\n",
    "<|endoftext|> in a text<|endoftext|>glued",
    "don't we'll I'M she'D  it's 're",
    "1234567 89 ½ ٣ 十二",
    "### $$$ *** &&& !!!",
]
