"""Personal data and secrets by a semi-Markov conditional random field.

A text is cut into tokens: key-like runs (20 characters or more of letters, digits and _ - + / = . with a letter and a digit, no part of an
address), other runs of letters and digits, and single other characters. A segmentation gives each token to a segment: a span of a type
(EMAIL, PHONE, IP, CARD, SSN, SECRET), at most `LONGEST[type]` tokens long, or one token outside any. Whole-span features (the span's shape,
its number of digits, check sums, octet ranges, how mixed a key is, what touches it, cue words before it) score each candidate; dynamic
programming over the ends picks boundaries and types jointly. Weights are fitted by gradient ascent on the conditional likelihood, with
forward and backward sums over all segmentations, of sentences that are composed here from patterns with random fillers. Of segmentations
with equal scores the one with fewer spans is taken, then the one whose last span begins first.

What can be a span at all is fixed, and so bounds the search: it has 7 characters at least; it holds a digit, an @ (one at most) or a value
that `password=` or the like stands before; a space is inside it only in the ways that phone, card and social security numbers are written
with spaces (`SPACED`), never a line's end. So the best segmentation of a text is that of its chunks (what white space that can't be inside
cuts), chunks without such a trigger need no search, and a text of any length takes time in proportion, numbers upon numbers included.

Null and empty texts hold nothing. Texts may be of any length and are searched whole. Rows with a null doc_id can't be named: the query leaves them out, and redaction treats them like any
other. A repeated row repeats its spans. Extra columns are ignored (redaction keeps them). An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vec

TYPES = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "SECRET")
LONGEST = {"EMAIL": 21, "PHONE": 13, "IP": 15, "CARD": 9, "SSN": 5, "SECRET": 1}
MOST = max(LONGEST.values())
MOST_PLAIN = max(n for t, n in LONGEST.items() if t != "EMAIL")
CUES = set("email mail contact write reach phone tel telephone call fax mobile ip host server address card visa credit payment ssn social security password passwd pwd token key secret api version license licensed page chapter year since in cc order invoice room section".split())
#: How keys of known makes begin.
PREFIXES = {"ghp", "gho", "gla", "npm", "hf_", "pyp", "sk-", "sk_", "pk_", "xox", "eyJ"}
SENTENCES, EPOCHS, SEED = 1200, 4, 11

TOKEN = re.compile(r"(?<![\w+/.@-])(?=[0-9_+/.-]*[A-Za-z])(?=[A-Za-z_+/.-]*[0-9])(?:[A-Za-z0-9_+/-]|\.(?=[A-Za-z0-9_-])){20,}+={0,2}(?!@)|[^\W_]+|[^\s]", re.UNICODE)
KEY = re.compile(r"[A-Za-z0-9]+[_+/=.-][A-Za-z0-9_+/=.-]*\Z|[_+/=.-][A-Za-z0-9_+/=.-]{8,}\Z")
_VALUES = "|".join(f"(?<=(?i:{w})=)" for w in ("password", "passwd", "pwd", "secret", "token", "key"))
TRIGGER = re.compile(rf"[0-9@]|=(?:{_VALUES})(?=[\"']?[A-Za-z])")
#: How numbers are written with spaces.
_SP = "[ \u00a0]"
_D = r"\d(?<!\w\d)"  # a first digit; alternatives that begin with a character let the search skip letters
SPACED = re.compile("|".join((r"\+\d{1,3}(?:[ \u00a0./-]{0,2}\(?\d{1,8}\)?){2,6}", r"\(\d{2,4}\)(?:[ \u00a0./-]{0,2}\(?\d{1,8}\)?){2,6}", rf"0(?<!\w0)\d{{1,3}}(?:{_SP}\d{{2,4}}){{2,4}}\b", rf"{_D}\d{{3}}(?:{_SP}\d{{4}}){{3,}}\b", rf"{_D}\d\d{_SP}\d{{2}}{_SP}\d{{4}}\b", rf"{_D}\d\d[ \u00a0-]\d{{3}}[ \u00a0-]\d{{4}}\b")))
LEAST = 7
_TRIGGERS = np.array([48 <= b <= 57 or b == 64 or b == 61 for b in range(256)])
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_SWITCH = re.compile(r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


@functools.lru_cache(100_000)
def kind(token: str) -> str:
    """A token's class: digits by number, letters, and mixtures by length and alphabet."""
    if len(token) >= 20 and KEY.match(token):  # by how mixed it is
        return f"k{min(7, 24 * len(_SWITCH.findall(token)) // len(token))}"
    if token.isdigit() and token.isascii():
        return f"d{len(token)}" if len(token) < 20 else "d+"
    if token.isalpha():
        return ("U" if token.isupper() else "w") if token.isascii() else "W"
    if token.isalnum():
        n = len(token)
        size = "s" if n < 6 else "m" if n < 16 else "l" if n < 28 else "x"
        return ("h" if _HEX.match(token) else "u" if token.upper() == token else "m") + size
    return token if token.isascii() else "?"


def triggers(text: str, start: int = 0, end: int | None = None) -> Iterator[int]:
    """Digits, @ and where a value after `password=` and the like begins."""
    for m in TRIGGER.finditer(text, start, len(text) if end is None else end):
        at = m.start()
        yield at if text[at] != "=" else at + 1 + (text[at + 1] in "\"'")


class Chunk:
    """Tokens with their places in the text, and the words before them."""

    def __init__(self, text: str, start: int, end: int):
        self.tokens, self.at = [], []
        for m in TOKEN.finditer(text, start, end):
            self.tokens.append(m.group())
            self.at.append(m.span())
        self.kinds = [kind(t) for t in self.tokens]
        self.before = [w.lower() for w in TOKEN.findall(text[max(0, start - 40) : start]) if w.isalpha()][-3:]
        marks = list(triggers(text, start, end))
        ends = np.searchsorted(marks, [b for _, b in self.at])
        self.trigger = [0, *ends.tolist()]
        self.ats = [0, *itertools.accumulate(t == "@" for t in self.tokens)]
        self.colons = [0, *itertools.accumulate(t == ":" for t in self.tokens)]
        self.double = [0, *itertools.accumulate(a == b == ":" for a, b in itertools.pairwise(["", *self.tokens]))]
        self.digits = [0, *itertools.accumulate(len(t) if k[0] == "d" else 0 for t, k in zip(self.tokens, self.kinds, strict=True))]
        self.gap = [False] + [self.at[k][0] > self.at[k - 1][1] for k in range(1, len(self.at))] + [True]

    def cue(self, i: int) -> str:
        near = [t.lower() for t in self.tokens[max(0, i - 4) : i] if t.isalpha()] or self.before
        return next((w for w in reversed(near) if w in CUES), "")

    def starts(self, j: int) -> Iterator[int]:
        """The first tokens of the candidates that end before token j: any with an @ and single tokens; else numbers in groups and addresses."""
        kinds, numeric = self.kinds, self.kinds[j - 1][0] == "d"
        for i in range(j - 1, max(-1, j - 1 - MOST), -1):
            ats, n = self.ats[j] - self.ats[i], j - i
            if ats > 1 or (not ats and n > MOST_PLAIN):
                break
            if self.trigger[j] == self.trigger[i] or self.at[j - 1][1] - self.at[i][0] < LEAST:
                continue
            if ats or n == 1:
                yield i
            elif numeric and kinds[i][0] in "d+(" and (self.digits[j] - self.digits[i] >= LEAST or (n == 7 and kinds[i + 1] == kinds[i + 3] == kinds[i + 5] == ".")):
                yield i
            elif self.colons[j] - self.colons[i] > 1 and (n == 15 or self.double[j] - self.double[i + 1] == 1):
                yield i

    def spans(self) -> Iterator[tuple[int, int]]:
        for j in range(1, len(self.tokens) + 1):
            for i in self.starts(j):
                yield i, j

    def features(self, i: int, j: int) -> tuple[str, ...]:
        """Whole-span features of tokens i to j - 1."""
        kinds, n = self.kinds[i:j], j - i
        shape = "".join(("_" if k and self.gap[i + k] else "") + c for k, c in enumerate(kinds))
        digits = "".join(t for t, c in zip(self.tokens[i:j], kinds, strict=True) if c[0] == "d")
        left = "" if i == 0 or self.gap[i] else self.kinds[i - 1][:1]
        right = "" if self.gap[j] else self.kinds[j][:1] + ("" if j + 1 >= len(self.tokens) or self.gap[j + 1] else self.kinds[j + 1][:1])
        out = [f"left {left}", f"right {right}", f"cue {self.cue(i)}", f"first {kinds[0][:1]}", f"last {kinds[-1][:1]}", f"n {min(n, 8)}", f"digits {min(len(digits), 20)}"]
        if n <= 13:
            out.append(f"shape {shape}")
        at = [k for k, c in enumerate(kinds) if c == "@"]
        if at:
            ok = len(at) == 1 and 0 < at[0] < n - 3 and not any(self.gap[i + 1 : j]) and kinds[-1] in "wU" and kinds[-2] == "." and len(self.tokens[j - 1]) > 1
            ok = ok and all(c.isalnum() or c in ".-" for c in kinds[at[0] + 1 :]) and all(c.isalnum() or c in ".-_+%" for c in kinds[: at[0]])
            out.append(f"address {ok}")
            if ok:  # as much as belongs to it
                out.append(f"address {left in ('.', '-', '_', '+', '%')} {right[:1] in ('-', '.', '_') and len(right) > 1}")
        elif kinds[1::2] == [".", ".", "."] and n == 7 and all(c[0] == "d" for c in kinds[::2]):
            out.append(f"octets {all(len(t) < 4 and int(t) < 256 for t in self.tokens[i:j:2])}")
        elif ":" in kinds and all(c == ":" or (len(t) < 5 and _HEX.match(t)) for c, t in zip(kinds, self.tokens[i:j], strict=True)):
            groups, text = sum(c != ":" for c in kinds), "".join(self.tokens[i:j])
            out.append(f"groups {groups == 8 and n == 15} {text.count('::') == 1 and ':::' not in text and groups < 8} {left == ':' or right[:1] == ':'}")
        elif digits and all(c[0] == "d" or c in "+()-./" for c in kinds):
            plain = all(c[0] == "d" or c == "-" for c in kinds)
            out.append(f"card {plain and 13 <= len(digits) <= 19} {luhn(digits) if plain and 13 <= len(digits) <= 19 else ''}")
            out.append(f"dial {kinds[0] in '+('} {7 <= len(digits) <= 15}")
        if n == 1:
            t = self.tokens[i]
            out += [f"token {kinds[0]} {len(t)}", f"token {kinds[0]} {self.cue(i)}", f"token {t[:4] if t[:4] in ('AKIA', 'ASIA') else ''} {len(t)}", f"token {t[:3] if t[:3] in PREFIXES else ''} {kinds[0][:1]}", f"quoted {left == chr(34) and right[:1] == chr(34)}"]
        return tuple(out)


class Model:
    def __init__(self, weights: dict[str, np.ndarray], fixed: np.ndarray):
        self.weights, self.fixed, self.cache = weights, fixed, {}

    def __reduce__(self):
        return Model, (self.weights, self.fixed)

    def score(self, features: tuple[str, ...]) -> np.ndarray:
        got = self.cache.get(features)
        if got is None:
            got = self.fixed.copy()
            for f in features:
                w = self.weights.get(f)
                if w is not None:
                    got += w
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[features] = got
        return got

    def best(self, chunk: Chunk) -> list[tuple[int, int, str]]:
        """The best segmentation's spans: first token, end and type. Of equal ones, the one with fewer spans."""
        n = len(chunk.tokens)
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for i in sorted(chunk.starts(j)):
                s = self.score(chunk.features(i, j))
                for k, kind_ in enumerate(TYPES):
                    if j - i <= LONGEST[kind_] and value[i] + s[k] > value[j] + 1e-9:
                        value[j], back[j] = value[i] + s[k], (i, kind_)
        out, j = [], n
        while j:
            if back[j]:
                out.append((back[j][0], j, back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]


def chunks(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the chunks that hold a trigger, of LEAST characters or more."""
    done, n, spaced = 0, len(text), SPACED.finditer(text)
    near = next(spaced, None)
    for at in triggers(text):
        if at < done:
            continue
        start, end = _bounds(text, at, done, n)
        while near is not None and near.end() <= start:
            near = next(spaced, None)
        # what is written with spaces is held together, with what touches it
        while near is not None and near.start() < end:
            if near.end() > end or near.start() < start:
                start, end = min(start, _bounds(text, near.start(), done, n)[0]), max(end, _bounds(text, near.end() - 1, done, n)[1])
            if near.end() > end:
                break
            near = next(spaced, None)
        done = end
        if end - start >= LEAST:
            yield start, end


_BREAK = re.compile(r"\s")


def _bounds(text: str, at: int, least: int, n: int) -> tuple[int, int]:
    """The run without white space that holds `at`, as far as it is after `least`."""
    start = at
    while start > least and not text[start - 1].isspace():
        start -= 1
    stop = _BREAK.search(text, at)
    return start, stop.start() if stop else n


def found(model: Model, text: str) -> list[tuple[int, int, str]]:
    """Start, end and type of the spans of a text, in order."""
    out = []
    for start, end in chunks(text):
        chunk = Chunk(text, start, end)
        out += [(chunk.at[i][0], chunk.at[j - 1][1], t) for i, j, t in model.best(chunk)]
    return out


def sentences(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their spans, from patterns and random fillers."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pick = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    letters, hexa, upper = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    word = lambda: pick(letters + "éüñ" * r.randint(0, 1), 1, 9)

    def email() -> str:
        local = r.choice([f"{pick(letters, 2, 8)}.{digits(r.randint(1, 3))}", f"{pick(letters, 2, 8)}.{pick(letters, 2, 8)}", pick(letters, 3, 9), f"{pick(letters, 2, 6)}_{pick(letters, 2, 6)}{digits(2)}", f"{pick(letters, 2, 6)}+{pick(letters, 2, 5)}", f"{pick(letters, 2, 6)}-{pick(letters, 2, 6)}"])
        host = ".".join([r.choice([pick(letters, 2, 7), f"mail{digits(1)}", f"{pick(letters, 2, 5)}-{pick(letters, 2, 5)}"]), *[pick(letters, 3, 8) for _ in range(r.randint(0, 2))]])
        return f"{local}@{host}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'io', 'co.uk', 'example.com'])}"

    def phone() -> str:
        return r.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(2)} {digits(8)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])

    def card() -> str:
        d = r.choice("3456") + digits(14)
        whole = next(d + c for c in "0123456789" if luhn(d + c)) if r.random() < 0.5 else r.choice("45") + digits(15)
        return r.choice([whole, whole, whole, " ".join(whole[k : k + 4] for k in range(0, 16, 4)), "-".join(whole[k : k + 4] for k in range(0, 16, 4))])

    def secret() -> tuple[str, str, str]:
        return r.choice([("", "AKIA" + pick(upper, 16, 16), ""), ("password=", pick(hexa, 12, 24), ""), ('token = "', pick(hexa, 40, 40), '"'), ("api_key: ", pick(letters + "0123456789" + upper, 24, 40), ""), ('secret = "', pick(hexa, 32, 32), '"'), ("key=", pick(hexa, 32, 64), ""), ("", pick(hexa, 40, 40), ""), *keys()])

    def keys() -> list[tuple[str, str, str]]:
        mixed = letters + letters.upper() + "0123456789"
        return [
            ("", r.choice(["ghp_", "gho_", "glpat-", "npm_", "hf_", "pypi-"]) + pick(mixed, 24, 40), ""),
            (r.choice(["", "api_key=", "key: "]), r.choice(["sk-", "sk-proj-", "sk_live_", "pk_test_", "xoxb-"]) + pick(r.choice([mixed, letters + "0123456789"]), 20, 48), ""),
            (r.choice(["", "secret=", 'secret = "', "aws_secret_access_key="]), f"{pick(mixed, 8, 16)}/{pick(mixed, 6, 12)}{r.choice('/+')}{pick(mixed, 12, 18)}", ""),
            (r.choice(["", "token=", "Bearer "]), f"eyJ{pick(mixed, 16, 30)}.{pick(mixed, 20, 60)}.{pick(mixed + '-_', 20, 43)}", ""),
            ("password=", pick(letters, 8, 16), ""), (r.choice(["pwd=", "secret=", "passwd="]), pick(letters + letters.upper(), 8, 20), ""), (r.choice(["password=", "key="]), pick(mixed, 40, 44) + "==", ""),
        ]

    def address() -> str:
        if r.random() < 0.75:
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        groups = [pick(hexa, 1, 4) for _ in range(8)]
        if r.random() < 0.5:
            a = r.randint(1, 4)
            return f"{':'.join(groups[:a])}::{':'.join(groups[a : a + r.randint(1, 3)])}"
        return ":".join(groups)

    def slug() -> str:
        words = "-".join(pick(letters, 2, 8) for _ in range(r.randint(3, 6)))
        year = f"{r.randint(1990, 2030)}"
        return r.choice([f"https://{pick(letters, 3, 9)}.com/{year}/{digits(2)}/{words}", f"www.{pick(letters, 3, 9)}.org/{words}/{digits(3)}", f"{words}-{year}.pdf", f"{words.replace('-', '_')}_{digits(2)}.tar.gz", f"/usr/lib/{pick(letters, 3, 7)}{digits(1)}/{words}", f"{pick(letters, 4, 8)}-{digits(1)}.{digits(2)}.{digits(1)}-{pick(letters, 4, 9)}-{pick(letters, 3, 6)}"])

    def numbers() -> str:
        width = r.randint(1, 4)
        return r.choice([" ".join(digits(width) for _ in range(r.randint(3, 9))), " ".join(digits(r.randint(1, 5)) for _ in range(r.randint(3, 9))), f"0{digits(1)} " + " ".join(digits(2) for _ in range(2)), ", ".join(digits(r.randint(1, 3)) for _ in range(5)), "-".join(digits(1) for _ in range(r.randint(7, 12)))])

    def ident() -> str:
        isbn = f"97{r.choice('89')}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"
        uuid = "-".join(pick(hexa, k, k) for k in (8, 4, 4, 4, 12))
        return r.choice([isbn, f"ISBN {isbn}", f"ISBN {digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", uuid, ":".join(pick(hexa, 2, 2) for _ in range(6)), f"{digits(4)}-{digits(4)}", f"20{digits(2)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(3)}-{digits(2)}-{digits(2)}"])

    def entity() -> tuple[str, str, str, str]:
        t = r.choice(TYPES)
        if t == "SECRET":
            return (t, *secret())
        make = {"EMAIL": email, "PHONE": phone, "IP": address, "CARD": card, "SSN": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"}[t]
        return t, r.choice(["", "", "", "", {"EMAIL": "email ", "PHONE": "call ", "IP": "ip ", "CARD": "card ", "SSN": "ssn "}[t]]), make(), ""

    def other() -> str:
        if r.random() < 0.35:
            return r.choice([slug, numbers, ident])()
        return r.choice([f"version {r.randint(1, 9)}.{digits(1)}", f"CC BY-NC {r.randint(1, 4)}.0", f"in {r.randint(1900, 2030)}", f"page {digits(3)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"@{pick(letters, 3, 8)}", f"{digits(5)}", f"{digits(8)}", f"{digits(2)}%", f"{pick(letters, 2, 5)}{digits(2)}", f"section {digits(1)}.{digits(1)}.{digits(2)}", f"{digits(3)}.{digits(3)}.{r.randint(256, 999)}.{digits(3)}", f"{digits(2)} {digits(2)} {digits(3)}"])

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 4))), []
        for _ in range(r.randint(1, 3)):
            text += " " if text else ""
            if r.random() < 0.65:
                t, pre, body, post = entity()
                spans.append((len(text) + len(pre), len(text) + len(pre) + len(body), t))
                text += pre + body + post
            else:
                text += other()
            text += r.choice(["", "", "", ".", ",", ")", "###", ":", " |"]) + "".join(" " + word() for _ in range(r.randint(0 if r.random() < 0.3 else 1, 4)))
        out.append((text, spans))
    return out


@functools.lru_cache(2)
def train(n: int = SENTENCES, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Gradient ascent (AdaGrad) on the conditional log likelihood."""
    names: dict[str, int] = {}
    cases = []
    for text, gold in sentences(n, seed):
        for start, end in chunks(text):
            chunk = Chunk(text, start, end)
            true = {(a, b): t for a, b, t in gold}
            spans, want = [], []
            for i, j in chunk.spans():
                f = np.array([names.setdefault(x, len(names)) for x in chunk.features(i, j)])
                t = true.get((chunk.at[i][0], chunk.at[j - 1][1]))
                spans.append((i, j, f))
                want.append(TYPES.index(t) if t else -1)
            if spans:
                cases.append((len(chunk.tokens), spans, want))
    width = len(TYPES)
    w, fixed = np.zeros((len(names), width)), np.zeros(width)
    square, square_fixed = np.full((len(names), width), 1e-2), np.full(width, 1e-2)
    allowed = np.array([[k <= LONGEST[t] for t in TYPES] for k in range(MOST + 1)])
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(cases)
        for size, spans, want in cases:
            scores = np.array([np.where(allowed[j - i], w[f].sum(0) + fixed, -1e9) for i, j, f in spans])
            total = np.logaddexp.reduce(scores, 1)
            forward, backward = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
            forward[0] = backward[size] = 0
            ending: list[list[int]] = [[] for _ in range(size + 1)]
            starting: list[list[int]] = [[] for _ in range(size + 1)]
            for k, (i, j, _) in enumerate(spans):
                ending[j].append(k)
                starting[i].append(k)
            for j in range(1, size + 1):
                forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[spans[k][0]] + total[k] for k in ending[j])])
            for i in range(size - 1, -1, -1):
                backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[spans[k][1]] + total[k] for k in starting[i])])
            for k, (i, j, f) in enumerate(spans):
                g = -np.exp(np.minimum(0, forward[i] + backward[j] - forward[size] + scores[k]))
                if want[k] >= 0:
                    g[want[k]] += 1
                if np.abs(g).max() < 1e-4:
                    continue
                square[f] += g * g
                w[f] += 0.3 * g / np.sqrt(square[f])
                square_fixed += g * g
                fixed += 0.3 * g / np.sqrt(square_fixed)
        w *= 0.995
    return Model({f: w[k] for f, k in names.items() if np.abs(w[k]).max() > 1e-3}, fixed)


def _texts(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Row and text of those that may hold a trigger."""
    data, offsets = vec.text_bytes(column)
    rows = np.unique(np.searchsorted(offsets, np.flatnonzero(_TRIGGERS[data]), side="right") - 1)
    for r in rows.tolist():
        yield r, column[r].as_py()


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (characters, end excluded) and type of each span."""
    held = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part in vec.slices(batch, "text"):
                ids = part.column(0)
                rows = [(ids[r].as_py(), *span) for r, text in _texts(part.column(1)) for span in found(model, text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == 3 else pa.int64()) for n, x in enumerate(zip(*rows, strict=True))], ["doc_id", "start", "end", "type"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return named.mapInArrow(run, "doc_id long, start long, end long, type string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, t in spans:
        out += [text[at:start], f"[{t}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its type in brackets; all columns and rows stay."""
    held = docs.sparkSession.sparkContext.broadcast(train())

    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        column = pa.array(texts, pa.string(), from_pandas=True)
        out = texts.copy()
        for part in vec.slices(pa.RecordBatch.from_arrays([column, pa.array(np.arange(len(column)))], ["text", "n"]), "text"):
            first = part.column(1)[0].as_py()
            for r, text in _texts(part.column(0)):
                if spans := found(held.value, text):
                    out.iloc[first + r] = redact(text, spans)
        return pd.Series(out)

    return docs.withColumn("text", clean(F.col("text").cast("string")))
