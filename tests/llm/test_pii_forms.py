"""Numbers that are no personal data, sentences that the training data did not make, long numeric texts."""

import random
import time

import numpy as np
import pytest

from doclake.llm import pii

CALLS = random.Random(3)


def lines(n, row):
    return "\n".join(row() for _ in range(n))


def integers(low, high, sep=" "):
    return lambda: sep.join(str(CALLS.randint(0, 10 ** CALLS.randint(low, high))) for _ in range(8))


NUMERIC = {
    "integers": lines(100, integers(1, 6)),
    "four digits": lines(100, lambda: " ".join(str(CALLS.randint(1000, 9999)) for _ in range(8))),
    "decimals": lines(100, lambda: " ".join(f"{CALLS.random() * 10 ** CALLS.randint(0, 4):.{CALLS.randint(1, 4)}f}" for _ in range(8))),
    "isbn": lines(50, lambda: f"ISBN 978-{CALLS.randint(0, 9)}-{CALLS.randint(10, 999)}-{CALLS.randint(10000, 99999)}-{CALLS.randint(0, 9)}"),
    "csv": lines(100, integers(4, 7, ",")),
    "tabs": lines(100, integers(1, 5, "\t")),
    "dates": lines(100, lambda: f"2024-0{CALLS.randint(1, 9)}-1{CALLS.randint(0, 9)} 12:{CALLS.randint(10, 59)}:00 {CALLS.randint(1, 500)}"),
    "ones and twos": "1 2 1 2 1 2 1",
    "zeros before": lines(50, lambda: " ".join(f"{CALLS.randint(0, 99999):06d}" for _ in range(6))),
}

#: Sentences written by hand, with what has to be found in each.
HELD_OUT = [
    ("Please wire it to DE89 3704 0044 0532 0130 00 before Friday.", "DE89 3704 0044 0532 0130 00"),
    ("Reach our desk at (020) 7946 0958 after nine.", "(020) 7946 0958"),
    ("His SSN is 078-05-1120, do not share.", "078-05-1120"),
    ("api_key=sk_live_51HqXyz99aB set in prod", "sk_live_51HqXyz99aB"),
    ("Dear Mrs Maria Gonzalez, thank you", "Maria Gonzalez"),
    ("She moved to 221 Baker Street last year", "221 Baker Street"),
    ("Tel: 555-867-5309", "555-867-5309"),
    ("password: Tr0ub4dor&3 is weak", "Tr0ub4dor&3"),
    ("In 1998 the town had 12 345 people and 3 schools.", None),
    ("The ratio 3.14159 to 2.71828 holds for n = 1000.", None),
    ("Chapter 4, pages 112-118, table 12.3", None),
    ("Order 4711 was shipped on 2023-11-05 at 14:30.", None),
    ("The password policy was changed in 2019.", None),
    ("Matches ended 3-2, 1-0 and 4-4.", None),
    ("The name of the rose has 512 pages.", None),
    ("version 10.15.7 build 19H2", None),
]


@pytest.fixture(scope="module")
def model():
    return pii.train(())


def added(text, model):
    return [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), model)]


@pytest.mark.parametrize("kind", sorted(NUMERIC))
def test_plain_numbers_are_left_alone(kind, model):
    assert added(NUMERIC[kind], model) == []


def test_sentences_not_made_by_the_trainer(model):
    for text, wanted in HELD_OUT:
        got = added(text, model)
        assert [v for _, v in got if wanted and v in wanted or wanted and wanted in v] if wanted else got == [], text


def test_spans_stay_on_their_line(model):
    text = "call 555\n867 5309 and 4111 1111\n1111 1111, DE89 3704 0044\n0532 0130 00"
    got = added(text, model)
    assert all("\n" not in v for _, v in got) and not {k for k, _ in got} & {"card", "iban"}
    assert added("x 4111 1111\n1111 1111 y", model) == []


@pytest.mark.parametrize("text", [
    "\n".join([NUMERIC["integers"]] * 300)[:1_000_000],
    " ".join(str(i * 7919 % 100_000) for i in range(170_000)),
    "call 555-867-5309 " * 20_000,
])
def test_a_megabyte_of_numbers(text, model):
    began = time.time()
    got = pii.added_spans(text, pii.base_spans(text), model)
    assert time.time() - began < 30
    assert len(got) == text.count("867-5309")


def test_parts_of_a_site_are_decoded_as_the_whole_site(model):
    """Words that no segment covers part a site: same spans, same score."""
    rng = random.Random(2)
    for _ in range(60):
        text = " ".join(pii._made_up(rng)[0].replace("\n", " ") for _ in range(3))
        lat = pii.lattice(text, pii.words_of(text), forms=True)
        scores = pii._scores(lat, model)
        whole = pii.decode(lat, scores, model.moves)
        parts = [(k, first + i, first + j) for first, part, which in pii.runs_of(lat) for k, i, j in pii.decode(part, scores[which], model.moves)]
        assert parts == whole
        assert all(np.isfinite(scores[s]).any() for s in range(len(lat.i)))
