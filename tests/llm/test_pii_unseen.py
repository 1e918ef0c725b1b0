"""Recall and precision of the added kinds in contexts whose words no list holds and no training text had."""

import random

import pytest

from tidemark.llm import pii

PEOPLE = ["Harriet Quill", "Omar Benítez", "Dr. Wójcik", "Mrs Okafor", "Jun-ho Park", "our neighbour", "grandmother", "the plumber", "patient", "el vecino", "die Nachbarin"]
PLACES = ["Brooklyn", "near the river", "(evenings only)", "after six", "from Monday", "- ask for Kim", "thanks!", "y gracias", "bitte", ""]
LINKS = [" ", ": ", ", ", " is ", " -> ", " = ", "\n", " has ", " on "]


def valid(rng, kind):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "phone_local":
        a, b = rng.choice("23456789") + d(2), rng.choice("23456789") + d(2)
        return rng.choice([f"({a}) {b}-{d(4)}", f"{a}-{b}-{d(4)}", f"{a}.{b}.{d(4)}", f"{a} {b} {d(4)}", f"({a}){b}-{d(4)}"])
    if kind == "national_id":
        return f"{rng.choice([i for i in range(1, 900) if i != 666]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
    if kind == "iban":
        land, body = rng.choice(["AT", "BE", "PT", "DE", "IT"]), d(rng.choice([12, 16, 18, 20]))
        s = f"{land}{98 - int(''.join(str(int(c, 36)) for c in body + land + '00')) % 97:02d}{body}"
        return rng.choice([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))])
    if kind == "email_spelled":
        at, dot = rng.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot ")])
        return f"{rng.choice(['anna', 'j.doe', 'k_lee9', 'info'])}{at}{rng.choice(['example', 'mail-house', 'uni'])}{dot}{rng.choice(['com', 'org', 'de', 'edu'])}"
    first = rng.choice("3456")
    s = first + d(15)
    return rng.choice([" ", "-"]).join(s[i : i + 4] for i in range(0, 16, 4))


def lookalike(rng, kind):
    s = valid(rng, kind)
    if kind == "email_spelled":
        return rng.choice([f"We met (at) noon. {rng.choice(['Then', 'Nobody'])} left", "look at this dot matrix printer", "seen (at) home. yesterday", "arrive at ten dot points follow"])
    if kind == "iban":
        return s[:2] + f"{(int(s[2:4]) + rng.randrange(1, 60)) % 97:02d}" + s[4:]
    how = rng.randrange(3)
    if how == 0:
        return f"{rng.choice(['order', 'invoice', 'part', 'version', 'tracking', 'serial'])} {s}"
    if how == 1:
        return rng.choice([f"ab-{s}", f"#{s}", f"{s}-77", f"${s}"])
    return {"phone_local": "155-055-0187", "national_id": "666-45-6789", "card_like": "83520 91746 35281"}[kind]


def found(text, kind, fitted):
    return [text[a:b] for a, b, k, _ in pii.all_spans(text, *fitted)[1] if k == kind]


@pytest.mark.parametrize("kind", pii.EXTRA)
def test_unseen_contexts(kind):
    fitted, rng = pii.model(), random.Random(kind)
    hits = total = wrong = 0
    while total < 400:
        s = valid(rng, kind)
        if kind == "card_like" and pii.luhn("".join(c for c in s if c.isdigit())):
            continue  # a base span
        text = f"{rng.choice(PEOPLE)}{rng.choice(LINKS)}{s} {rng.choice(PLACES)}"
        assert not {w for w in text.lower().split()} & (pii.FOR | pii.AGAINST)
        total += 1
        hits += s in found(text, kind, fitted)
        wrong += bool(found(f"{rng.choice(PEOPLE)} said {lookalike(rng, kind)} {rng.choice(PLACES)}", kind, fitted))
    print(kind, "recall", hits / total, "look-alikes taken", wrong / total)
    assert hits / total >= 0.9 and wrong / total <= 0.05


def test_plain_sentences():
    fitted = pii.model()
    for text, kind, span in [
        ("John Smith 212-555-0187 Brooklyn", "phone_local", "212-555-0187"), ("my number is 212-555-0187", "phone_local", "212-555-0187"), ("patient id 123-45-6789", "national_id", "123-45-6789"),
        ("Ring me on (212) 555-0187", "phone_local", "(212) 555-0187"), ("anna [at] example [dot] com", "email_spelled", "anna [at] example [dot] com"),
    ]:
        assert found(text, kind, fitted) == [span]


def test_long_parts_and_contexts():
    fitted = pii.model()
    name = "n" * 300
    assert found(f"{name} [at] {name} [dot] com", "email_spelled", fitted) == [f"{name} [at] {name} [dot] com"]
    assert found(f"order {'w' * 5000} 212-555-0187", "phone_local", fitted) == found("order w 212-555-0187", "phone_local", fitted)
    for text in ("a." * 100_000, "1-" * 100_000, "ab at " * 60_000, "AB12 " * 60_000, "(at) " * 60_000, "x" * 300_000):
        pii.all_spans(text, *fitted)
