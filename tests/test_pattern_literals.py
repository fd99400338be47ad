"""Literals that patterns require: never a missed match, and few patterns run."""

import random

import pytest
import regex

from dealweave.operators.joins import candidate_finder, required_literals


@pytest.mark.parametrize("pattern, wanted", [
    (r"\b(red|old)\b.*g", ("old", "red")), ("acme( labs)? inc", ("acme",)), ("(?:ab|cd)+e?f", ("ab", "cd")), ("(?:ab|c)+de?f", ("d",)), ("ab*cd{2}e", ("cd",)),
    ("x(yy|)z", ("x",)), ("(a(bcd|efg)|hij)k?", ("bcd", "efg", "hij")), ("[abc]+", ()), ("(abc)?", ()), ("(abc){0,2}", ()), ("ab|", ()),
    ("Acme Labs", ("acme",)), (r"\x41bc", ()), ("(?i)abc", ()), ("(?=abc)d", ()), ("(?:abc){e<=1}", ()), ("[[:alpha:]x]y", ()),
    (r"[\]a]bc", ("bc",)), ("[]a]bc", ("bc",)), (r"a\\bc", ("bc",)), (r"\(abc\)", ("abc",)), ("a+?bc", ("bc",)), ("(", ()), ("", ())])
def test_required_literals(pattern, wanted):
    assert required_literals(pattern) == wanted


def test_letters_that_fold_to_ascii():
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for letter in "abcdefghijklmnopqrstuvwxyz0123456789":
        find = candidate_finder([(letter,)])
        assert all(find(c) for c in regex.findall(letter, every, regex.IGNORECASE)), letter


def pattern_of(rng, depth=0):
    """A random pattern of short literals, choices, repeats, classes and escapes."""
    def atom():
        kind = rng.random()
        if kind < 0.2 and depth < 3:
            return rng.choice(["(", "(?:"]) + pattern_of(rng, depth + 1) + ")"
        return rng.choice("abcABk s.") if kind < 0.75 else rng.choice(["[ab]", "[^c]", r"\b", r"\w", r"\.", r"\s"])

    def branch():
        return "".join(atom() + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "{1,}", "+?"]) for _ in range(rng.randrange(1, 5)))

    return "|".join(branch() for _ in range(rng.choice([1, 1, 2])))


def test_no_match_is_missed():
    rng = random.Random(5)
    patterns = []
    while len(patterns) < 400:
        try:
            patterns.append((p := pattern_of(rng), regex.compile(p, regex.IGNORECASE | regex.DOTALL)))
        except regex.error:
            continue
    find = candidate_finder([required_literals(p) for p, _ in patterns])
    for _ in range(200):
        text = "".join(rng.choice("abcABCkK sſ.é") for _ in range(rng.randrange(12)))
        near = set(find(text))
        assert not [p for i, (p, c) in enumerate(patterns) if i not in near and c.search(text)], text


def test_few_patterns_are_run():
    rng = random.Random(6)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(2000)]
    find = candidate_finder([required_literals(rf"(\bex[- ]?({n})\b|\b({n})\b\s*(alum|alumni)\b)") for n in names])
    texts = [f"{rng.choice(names)} alum, formerly ex-{rng.choice(names)}" for _ in range(300)]
    calls = sum(len(find(t)) for t in texts)
    assert 300 <= calls <= 3 * 300
