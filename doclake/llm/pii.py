"""Personal data: exact patterns, and a semi-Markov CRF that adds spans.

The base patterns (email, ip, card, phone) are matched over whole texts.  The
CRF reads *sites*: the words around each word that holds a digit or ``@`` or is a
cue (``CUES``), in texts of any length; no text or word is shortened.  A segment
is an entity of up to ``MAX_WORDS`` words of one line and one kind, scored by
features of the whole span, or a single other word; neighbouring segments are
scored by their kinds.  A span can only be of a kind whose form it has (``_forms``):
plain numbers, decimals, dates or ISBNs have none.  Dynamic programming chooses
borders and kinds jointly, over runs of words that spans cover together: words that
no span covers part a site exactly, so numbers by the megabyte make no lattice.

Training maximises the likelihood of labelled sites (forward-backward over all
segmentations): a bounded sample of the corpus (``sample`` sites of least hash),
labelled by the base patterns and a pattern for written-out secrets, and
``MADE_UP`` sentences with values made up by rule, as no given table labels the
kinds without a base pattern.  Spans that the CRF adds don't overlap base ones.

Nulls: a null text is empty and stays null when masked; a null id is kept.
Offsets are in code points, ends exclusive.  Repeated rows give the same spans;
of equally good segmentations the one with the shorter last entity is taken.  An
empty table gives no rows; extra columns are ignored (``mask_pii`` keeps them).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import common

KINDS = ("email", "ip", "card", "phone", "secret", "id", "iban", "name", "address")
BASE = KINDS[:4]
#: Words of an entity, words of context on each side, words from a cue to what it announces.
MAX_WORDS, CONTEXT, REACH = 8, 4, 4
#: Sites of the corpus, made-up sentences, passes over both, step size and weight decay of the training.
SAMPLE, MADE_UP, EPOCHS, RATE, DECAY = 600, 900, 6, 0.25, 2e-4
CUES = {
    "secret": "password passwd pwd passphrase passwort secret token api_key apikey api-key credential",
    "id": "ssn passport reisepass taxid tax-id dni nif security",
    "iban": "iban account konto cuenta compte",
    "phone": "phone tel telephone telefon mobile call fax cell",
    "name": "name mr mrs ms dr prof dear herr frau madame monsieur señor señora signed",
    "address": "address adresse lives",
}
_CUE_OF = {w: kind for kind, words in CUES.items() for w in words.split()}
_STREETS = frozenset("street st road rd avenue ave lane ln drive dr boulevard blvd straße strasse platz".split())

# A match can only begin where a run begins, or where the last match ended.
_EMAIL = regex.compile(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_SITE = re.compile("[0-9@]")
_SECRET = re.compile(r"(?i)\b(?:password|passwd|secret|token|api_?key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_\-+/]{8,})")
_SMALL = re.compile("[^\\W\\d_A-Z]")
_MARKS = "\"'=:,;()<>[]{}|"
_WORD = re.compile(r"[^\s\"'=:,;()<>\[\]{}|]+=*|[\"'=:,;()<>\[\]{}|]")
_APART = str.maketrans(_MARKS + ".", " " * (len(_MARKS) + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind and start."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        small = lambda part: len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def words_of(text: str) -> list[tuple[int, int]]:
    """Start and end of each word or mark."""
    return [m.span() for m in _WORD.finditer(text)]


def _cue(word: str) -> str | None:
    return _CUE_OF.get(word.lower().strip(".#=_"))


def has_sites(text: str) -> bool:
    return bool(_SITE.search(text)) or not _CUE_OF.keys().isdisjoint(text.lower().translate(_APART).split())


def sites(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words around those that hold a digit or @ or are cues."""
    out: list[tuple[int, int]] = []
    for k, (a, b) in enumerate(words):
        if _SITE.search(text, a, b):
            low, high = k - CONTEXT, k + CONTEXT + 1
        elif b - a < 12 and _cue(text[a:b]):
            low, high = k - 1, k + REACH + CONTEXT + 1
        else:
            continue
        low, high = max(0, low), min(len(words), high)
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def _shape(span: str) -> str:
    """Runs of capitals, small letters and digits as one letter each, the first 24 of them (a feature, not a text)."""
    return re.sub("[0-9]+", "9", re.sub("[^\\W\\d_A-Z]+", "a", re.sub("[A-Z]+", "A", span[:400])))[:24]


def _mod97(span: str) -> bool:
    """Whether letters and digits could be an international account number."""
    s = "".join(c for c in span if c.isalnum()).upper()
    if not (15 <= len(s) <= 34 and s.isascii() and s[:2].isalpha() and s[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Lattice(NamedTuple):
    """The segments of a site that may be entities, with the features of each."""

    n: int
    i: list[int]  # first word
    j: list[int]  # word after the last
    features: list[list[str]]
    kinds: list[list[int]] = []  # what each can be; all kinds without forms


_GROUPS = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}")
_LOCAL = re.compile(r"\([0-9]{2,5}\) ?[0-9]{2,4}(?:[ .-]?[0-9]{2,5}){0,2}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|0[0-9]{1,5}[ /-][0-9]{3,8}(?:[ -][0-9]{2,5}){0,2}")
_CALLED = re.compile(r"\+?[0-9(][0-9 ()./-]{5,}[0-9]")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)")
_NUMBER = re.compile(r"[0-9][0-9.,/%-]*")
_K = {kind: k for k, kind in enumerate(KINDS)}


def _forms(span: str, announced: str | None, street: bool, alone: bool) -> list[int]:
    """The kinds whose form a span has; ``announced`` is the kind of the cue before it, ``alone``: no plain number stands beside it on its line."""
    n, out = sum(c in "0123456789" for c in span), []
    grouped = " " not in span or alone  # spaced digits inside a row of numbers are numbers
    if "@" in span and _EMAIL.fullmatch(span):
        out.append("email")
    if 13 <= n <= 19 and grouped and _GROUPS.fullmatch(span) and luhn("".join(c for c in span if c.isdigit())):
        out.append("card")
    if 7 <= n <= 15 and ((grouped and _LOCAL.fullmatch(span)) or (announced == "phone" and _CALLED.fullmatch(span)) or (span[0] == "+" and n >= 9 and _PHONE.fullmatch(span))):
        out.append("phone")
    if n >= 2 and _ACCOUNT.fullmatch(span) and _mod97(span):
        out.append("iban")
    if announced == "secret":
        out.append("secret")
    if n and (announced == "id" or re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", span)):
        out.append("id")
    if not n and announced == "name":
        out.append("name")
    if n and (street or announced == "address"):
        out.append("address")
    return [_K[k] for k in out]


def lattice(text: str, words: list[tuple[int, int]], forms: bool = False) -> Lattice:
    """All segments that may be entities; with ``forms``, those that have the form of some kind."""
    parts = [text[a:b] for a, b in words]
    digit = [bool(_SITE.search(p)) for p in parts]
    mark = [p in _MARKS for p in parts]
    cue = [None if d or m else _cue(p) for p, d, m in zip(parts, digit, mark, strict=True)]
    last: list[tuple[str, int] | None] = []  # the cue before each word, and how far
    for k in range(len(parts)):
        last.append((cue[k - 1], 1) if k and cue[k - 1] else (last[-1][0], last[-1][1] + 1) if k and last[-1] and last[-1][1] < REACH else None)
    out = Lattice(len(words), [], [], [], [])
    starts_line = [k == 0 or "\n" in text[words[k - 1][1] : words[k][0]] for k in range(len(parts))] + [True]
    number = [d and bool(_NUMBER.fullmatch(p)) for d, p in zip(digit, parts, strict=True)] if forms else []
    for i in range(len(parts)):
        opens = digit[i] or (parts[i] == "(" and i + 1 < len(parts) and digit[i + 1])
        announced = last[i] is not None and not mark[i] and cue[i] is None
        if not opens and not announced:
            continue
        beside = forms and i > 0 and not starts_line[i] and number[i - 1]
        if forms and not announced and number[i] and len(parts[i]) < 10 and beside:
            continue  # inside a row of numbers nothing begins that is not announced
        plain = True  # no small letters after the first word
        for j in range(i + 1, min(len(parts), i + MAX_WORDS) + 1):
            k = j - 1
            street = parts[k].lower().strip(".") in _STREETS
            if (mark[k] and parts[k] not in "()") or (cue[k] and not street) or (k > i and starts_line[k]):
                break
            plain = plain and (k == i or not _SMALL.search(parts[k]))
            if mark[k] or not (street or (announced and j - i <= 3) or (digit[k] and plain)):
                continue
            if forms:
                kinds = _forms(text[words[i][0] : words[k][1]].rstrip(".!?"), last[i][0] if last[i] else None, street, not beside and (starts_line[j] or not number[j]))
                if not kinds:
                    continue
                out.kinds.append(kinds)
            out.i.append(i)
            out.j.append(j)
            out.features.append(_features(text[words[i][0] : words[k][1]], j - i, last[i], street, parts[i - 1] if i else "^", parts[j] if j < len(parts) else "$"))
    return out


def _features(span: str, n_words: int, cue: tuple[str, int] | None, street: bool, before: str, after: str) -> list[str]:
    digits = _DIGIT.findall(span)
    n, letters, size = len(digits), sum(map(str.isalpha, span)), len(span)
    announced = cue[0] if cue else "no"
    capital = all(w[:1].isupper() for w in span.split())
    dense = n > 0 and letters > 0 and n_words == 1
    many = min(size, 48) // 4
    joined = "".join(digits)
    out = [
        "any", f"words{n_words}", f"shape{_shape(span)}", f"digits{min(n, 20)}|{letters > 0}",
        f"marks{''.join(sorted({c for c in span if not c.isalnum()}))[:8]}", f"size{many}|{dense}",
        f"cue{announced}|{n > 0}|{letters > 0}", f"cue{announced}|words{n_words}|{capital}", f"cue{announced}|size{many}",
        f"luhn{13 <= n <= 19 and luhn(joined)}|{letters > 0}", f"iban{_mod97(span)}", f"dots{min(span.count('.'), 4)}at{min(span.count('@'), 2)}plus{span[0] == '+'}",
        f"street{street}|{n_words > 1}|{capital}", f"ends{span[-1] if not span[-1].isalnum() else 'x'}", f"split{n_words > 1 and ' ' not in span}",
        f"before{before if before in _MARKS else 'w'}|{announced}|{letters > 0}|{n > 0}", f"after{after if after in _MARKS else 'w'}|{bool(_SITE.search(after))}", f"kinds{len(set(span[:64])) // 4}|{dense}",
    ]
    if announced == "secret" and n_words == 1:
        out.append(f"secret{n > 0}|{span.islower()}|{min(size, 24) // 3}|{before if before in _MARKS else 'w'}")
    return out


class Model(NamedTuple):
    """Weights of span features for each kind, and of neighbouring kinds (0 is no entity)."""

    row: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray


def _barred(lat: Lattice) -> np.ndarray:
    """0 where a segment can be of a kind, else minus infinity."""
    out = np.full((len(lat.i), len(KINDS)), -np.inf)
    for s, kinds in enumerate(lat.kinds):
        out[s, kinds] = 0.0
    return out


def _scores(lat: Lattice, model: Model) -> np.ndarray:
    row = model.row
    return np.array([model.weights[[row[f] for f in fs if f in row]].sum(0) for fs in lat.features]).reshape(len(lat.features), len(KINDS)) + _barred(lat)


def runs_of(lat: Lattice) -> Iterator[tuple[int, Lattice, list[int]]]:
    """Runs of words that segments cover together (first word, their lattice, their segments); a word that none covers is behind each, and no entity can be there."""
    at = 0
    while at < len(lat.i):
        first, end, to = lat.i[at], lat.j[at], at
        while to < len(lat.i) and lat.i[to] <= end:  # segments are in order of their first words
            end, to = max(end, lat.j[to]), to + 1
        which = list(range(at, to))
        yield first, Lattice(min(end + 1, lat.n) - first, [lat.i[s] - first for s in which], [lat.j[s] - first for s in which], [lat.features[s] for s in which], [lat.kinds[s] for s in which]), which
        at = to


def decode(lat: Lattice, scores: np.ndarray, moves: np.ndarray) -> list[tuple[str, int, int]]:
    """The best segmentation: entities as (kind, first word, word after the last)."""
    ends: dict[int, list[int]] = {}
    for s in range(len(lat.i)):
        ends.setdefault(lat.j[s], []).append(s)
    best = np.full((lat.n + 1, len(KINDS) + 1), -np.inf)
    best[0, 0] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}  # (end, state) -> (begin, state before)
    into: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for t in range(1, lat.n + 1):
        step = best[t - 1] + moves[:, 0]
        p = int(step.argmax())
        best[t, 0], back[t, 0] = step[p], (t - 1, p)
        for s in sorted(ends.get(t, ()), key=lambda s: -lat.i[s]):
            i = lat.i[s]
            if i not in into:
                reach = best[i][:, None] + moves[:, 1:]
                into[i] = reach.max(0), reach.argmax(0)
            value = into[i][0] + scores[s]
            for k in np.flatnonzero(value > best[t, 1:]).tolist():
                best[t, k + 1], back[t, k + 1] = value[k], (i, int(into[i][1][k]))
    out, t, state = [], lat.n, int(best[lat.n].argmax())
    while t:
        i, p = back[t, state]
        if state:
            out.append((KINDS[state - 1], i, t))
        t, state = i, p
    return out[::-1]


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exp."""
    top = np.maximum(x.max(axis), -1e300)
    with np.errstate(divide="ignore"):  # nothing leads there: minus infinity
        return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def likelihood(lat: Lattice, scores: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """log of the sum over all segmentations, and how often segments and moves are expected."""
    n, k = lat.n, len(KINDS)
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for s in range(len(lat.i)):
        ends.setdefault(lat.j[s], []).append(s)
        starts.setdefault(lat.i[s], []).append(s)
    a = np.full((n + 1, k + 1), -np.inf)
    a[0, 0] = 0.0
    into = {}
    for t in range(1, n + 1):
        if t - 1 in starts:
            into[t - 1] = _sum(a[t - 1][:, None] + moves[:, 1:], 0)
        a[t, 0] = _sum(a[t - 1] + moves[:, 0], 0)
        if t in ends:
            a[t, 1:] = _sum(np.array([into[lat.i[s]] + scores[s] for s in ends[t]]), 0)
    b = np.zeros((n + 1, k + 1))
    gone = np.full((n + 1, k), -np.inf)  # entities that begin here
    for t in range(n - 1, -1, -1):
        step = moves[:, :1] + b[t + 1, 0]
        if t in starts:
            gone[t] = _sum(np.array([scores[s] + b[lat.j[s], 1:] for s in starts[t]]), 0)
            step = np.concatenate([step, moves[:, 1:] + gone[t]], axis=1)
        b[t] = _sum(step, 1)
    total = float(b[0, 0])
    segments = np.exp(np.array([into[i] + s + b[j, 1:] for i, j, s in zip(lat.i, lat.j, scores, strict=True)]).reshape(-1, k) - total)
    moved = np.zeros_like(moves)
    moved[:, 0] = np.exp(a[:-1] + moves[:, 0] + b[1:, :1] - total).sum(0)
    moved[:, 1:] = np.exp(a[:-1, :, None] + moves[None, :, 1:] + gone[:-1, None, :] - total).sum(0)
    return total, segments, moved


def _gold(text: str, words: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> set[tuple[str, int, int]]:
    """Entities on word borders; the first of overlapping ones counts."""
    out, used = set(), 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        inside = [k for k, (s, e) in enumerate(words) if s < b and e > a]
        if inside and inside[0] >= used:
            out.add((kind, inside[0], inside[-1] + 1))
            used = inside[-1] + 1
    return out


def _made_up(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with a value of one kind, or with none."""
    draw, pick = rng.randint, rng.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    syllables = "an ber con del en for ga ham in jo kal li mon nor os per qui ran sol ter un vel wes yor zan".split()
    word = lambda: "".join(pick(syllables) for _ in range(draw(1, 3)))
    run = lambda n, of: "".join(pick(of) for _ in range(n))
    small, big = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    proper = lambda: word().capitalize()

    def card() -> str:
        d = pick("3456") + digits(pick((14, 14, 14, 13, 12)))
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick((d, "-".join(d[k : k + 4] for k in range(0, len(d), 4)), " ".join(d[k : k + 4] for k in range(0, len(d), 4))))

    def iban() -> str:
        body = digits(draw(12, 20))
        for check in range(2, 99):
            s = f"{pick(('DE', 'FR', 'ES', 'GB', 'NL', 'IT'))}{check:02d}{body}"
            if _mod97(s):
                return pick((s, " ".join(s[k : k + 4] for k in range(0, len(s), 4))))
        return iban()

    secret = lambda: pick((run(draw(8, 24), small), run(draw(8, 24), small + big), run(draw(8, 20), small + big + "0123456789"), run(pick((32, 40)), "0123456789abcdef"), run(draw(10, 60), small + big + "0123456789+/_-"), word() + pick("!#$%&*") + digits(3), run(draw(200, 1500), small + big + "0123456789")))
    join = lambda: pick((": ", " = ", "=", ":", " is ", ' = "', ': "', '="'))
    cue = lambda kind: pick((str.lower, str.capitalize, str.upper))(pick(CUES[kind].split()))
    local = lambda: pick((f"{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(3)} {digits(7)}", f"{digits(3)}.{digits(3)}.{digits(4)}"))
    number = lambda: pick((digits(draw(1, 8)), f"{digits(1)}.{digits(1)}", f"20{digits(2)}-0{draw(1, 9)}-{draw(10, 28)}", f"{digits(2)}:{digits(2)}", f"${digits(2)}.{digits(2)}", f"{draw(1, 99)},{digits(3)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(4)}-{digits(4)}", digits(16), f"{digits(3)}%", f"{word()}{digits(2)}", f"{digits(1)}/{digits(2)}/20{digits(2)}", f"Version {digits(1)}.0"))
    kind = pick((*KINDS, *KINDS, None, None, None, None, None))
    lead, value = "", ""
    if kind == "email":
        value = f"{word()}{pick(('.', '_', ''))}{word()}{digits(draw(0, 2))}@{word()}.{pick(('com', 'org', 'de'))}"
    elif kind == "ip":
        value = ".".join(str(draw(0, 255)) for _ in range(4))
    elif kind == "card":
        value = card()
    elif kind == "phone":
        lead, value = pick(("", cue("phone") + pick((" ", ": ", " me at ", " us on ")))), pick((f"+{draw(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", local(), local()))
    elif kind == "secret":
        lead, value = cue("secret") + join(), secret()
    elif kind == "id":
        lead, value = cue("id") + pick((": ", " ", " is ", " no ", " number ", " number is ")), pick((f"{digits(3)}-{digits(2)}-{digits(4)}", run(1, big) + digits(8), digits(8) + run(1, big), digits(9)))
    elif kind == "iban":
        lead, value = pick(("", cue("iban") + pick((": ", " ", " is ", " number ")))), iban()
    elif kind == "name":
        lead = pick((pick(("Name", "name", "Full name", "My name")) + pick((": ", " is ", " = ")), pick(("Mr", "Mrs", "Ms", "Dr", "Prof", "Dear", "Herr", "Frau", "Madame", "Monsieur")) + pick((" ", ". "))))
        value = " ".join(proper() for _ in range(draw(1, 3)))
    elif kind == "address":
        lead = pick(("", "lives at ", "Address: "))
        value = f"{draw(1, 999)} {' '.join(proper() for _ in range(draw(1, 2)))} {pick(('Street', 'St', 'Road', 'Rd', 'Avenue', 'Ave', 'Lane', 'Drive'))}"
    elif rng.random() < 0.5:
        lead = pick((f"{cue(pick(list(CUES)))} of {word()}", f"the {cue('secret')} {word()} {word()}", f"a {cue('name').lower()} for {word()}", f"{cue('id')} {word()} and {word()}", f"{cue('phone')} {word()}", f"{cue('name').lower()} {word()} {word()}", f"{cue('iban')} of {number()} {word()}"))
    else:
        lead = pick((number(), f"{number()} {number()}", f"{word()} {number()}, {number()}", f"{word()} ({number()})"))
    start = f"{' '.join(word() for _ in range(draw(0, 4)))} ".lstrip() + lead
    end = pick((" ", ". ", ", ", "; ", ") ", "\n", " | ")) if not start.endswith('"') else '" '
    text = start + value + end + " ".join(word() for _ in range(draw(0, 5)))
    return text, [(kind, len(start), len(start) + len(value))] if kind else []


@lru_cache(maxsize=4)
def train(texts: tuple[str, ...], epochs: int = EPOCHS, made_up: int = MADE_UP) -> Model:
    """Weights of greatest likelihood on site texts and made-up sentences, by steps of falling size."""
    rng = random.Random(20240117)
    given = [(t, base_spans(t) + [("secret", *m.span(1)) for m in _SECRET.finditer(t)]) for t in texts] + [_made_up(rng) for _ in range(made_up)]
    row: dict[str, int] = {}
    seen: dict[str, int] = {}
    sets = []
    for text, spans in given:
        words = words_of(text)
        lat = lattice(text, words, forms=True)
        sets.append((lat, _gold(text, words, spans)))
        for fs in lat.features:
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
    for f, n in seen.items():
        if n > 1:
            row[f] = len(row)
    k = len(KINDS)
    weights, moves = np.zeros((len(row), k)), np.zeros((k + 1, k + 1))
    w2, m2 = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    at = [[[row[f] for f in fs if f in row] for fs in lat.features] for lat, _ in sets]
    for _ in range(epochs):
        order = list(range(len(sets)))
        rng.shuffle(order)
        for x in order:
            lat, gold = sets[x]
            if not lat.i:
                continue
            scores = np.array([weights[r].sum(0) for r in at[x]]) + _barred(lat)
            _, expected, moved = likelihood(lat, scores, moves)
            have = {(i, j): s for s, (i, j) in enumerate(zip(lat.i, lat.j, strict=True))}
            gold = {g for g in gold if (g[1], g[2]) in have and KINDS.index(g[0]) in lat.kinds[have[g[1], g[2]]]}  # what no segment can be is out of reach
            expected = -expected
            for kind, i, j in gold:
                expected[have[i, j], KINDS.index(kind)] += 1
            state, word = 0, 0
            begin = {i: (KINDS.index(kind) + 1, j) for kind, i, j in gold}
            moved = -moved
            while word < lat.n:
                nxt, word = begin.get(word, (0, word + 1))
                moved[state, nxt] += 1
                state = nxt
            rows = np.array([r for rs in at[x] for r in rs])
            change = np.repeat(expected, [len(rs) for rs in at[x]], axis=0)
            unique, back = np.unique(rows, return_inverse=True)
            g = np.zeros((len(unique), k))
            np.add.at(g, back, change)
            g -= DECAY * weights[unique]
            w2[unique] += g * g
            weights[unique] += RATE * g / np.sqrt(w2[unique])
            m2 += moved * moved
            moves += RATE * (moved - DECAY * moves) / np.sqrt(m2)
    return Model(row, weights, moves)


def added_spans(text: str, base: list[tuple[str, int, int]], model: Model) -> list[tuple[str, int, int]]:
    """What the CRF finds beside the base spans."""
    out, words = [], words_of(text)
    taken, near = sorted((a, b) for _, a, b in base), 0
    for low, high in sites(text, words):
        site = lattice(text, words[low:high], forms=True)
        found = [(kind, first + i, first + j) for first, lat, _ in runs_of(site) for kind, i, j in decode(lat, _scores(lat, model), model.moves)]
        for kind, i, j in found:
            a, b = words[low + i][0], words[low + j - 1][1]
            while b > a + 1 and text[b - 1] in ".!?":
                b -= 1
            while near < len(taken) and taken[near][1] <= a:
                near += 1
            # Base spans of several kinds may overlap; those from ``near`` on that begin before the end decide.
            k = near
            while k < len(taken) and taken[k][0] < b and taken[k][1] <= a:
                k += 1
            if k == len(taken) or taken[k][0] >= b:
                out.append((kind, a, b))
    return out


def sample_sites(docs: DataFrame, text: str, sample: int) -> list[str]:
    """The texts of the ``sample`` sites of least hash (each at most 400 characters, to bound what is sent)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                if t and has_sites(t):
                    words = words_of(t)
                    found += [t[words[a][0] : words[b - 1][1]][:400] for a, b in sites(t, words)]
            yield pa.record_batch({"site": pa.array(found, pa.string())})

    some = common.thinned(docs.select(text), text, 40 * sample)
    found = some.mapInArrow(find, "site string").dropDuplicates(["site"])
    return [r.site for r in found.orderBy(F.xxhash64("site"), "site").limit(sample).collect()]


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, spans, base): arrays of (kind, start, end) of all spans and of the base ones, sorted."""
    model = docs.sparkSession.sparkContext.broadcast(train(tuple(sample_sites(docs, text, sample))))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            every, base = [], []
            for t in batch.column(1).to_pylist():
                own = base_spans(t or "")
                more = added_spans(t, own, model.value) if t and has_sites(t) else []
                base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in own])
                every.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in sorted(own + more, key=lambda x: (order[x[0]], x[1]))])
            yield pa.record_batch({key: batch.column(0), "spans": pa.array(every, kind), "base": pa.array(base, kind)})

    of = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(find, f"{key} long, spans {of}, base {of}")


def mask_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents with each span's text replaced by its kind in brackets; other columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(tuple(sample_sites(docs, text, sample))))

    @F.pandas_udf("string")
    def mask(texts):
        def one(t):
            if t is None or not has_sites(t):
                return t
            own = base_spans(t)
            out, at = [], 0
            for k, a, b in sorted(own + added_spans(t, own, model.value), key=lambda x: (x[1], -x[2])):
                if a >= at:
                    out += [t[at:a], f"[{k}]"]
                    at = b
            return "".join([*out, t[at:]])

        return texts.map(one)

    return docs.withColumn(text, mask(text))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    found = find_pii(common.table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
