"""Personal data: base patterns, and spans that boosted trees select from high-recall candidates.

The base patterns (email, ip, card, phone) always count. Around digits and key words, generators propose
further, overlapping spans; trees trained here on generated examples score each by its format and context, a
logistic curve fitted on examples of other templates turns scores into probabilities, and each kind's threshold is
the lowest that keeps the wanted precision there. Of overlapping accepted spans the likelier one stays, and none
that overlaps a base span.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import BoostedTrees, logistic
from .common import bounded_batches, slices, texts_of, tidied

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "local_phone", "national_id", "iban", "spelled_email")
KINDS = BASE + ADDED

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Numbers joined by single dots; every four of them from the left are one match of the ip pattern.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of the email pattern. A match holds exactly one @, so each @ is tried once: the local
    part reaches back to the last match at most, which keeps the search linear in the text."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
        last = domain.end() if domain else at + 1
        at = text.find("@", last)
    return found


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans by kind, then start; offsets are code points, ends exclusive."""
    found = emails(text)
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _DOTTED.finditer(text):
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[i : i + 4])) + 3
                if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in parts[i : i + 4]):
                    found.append(("ip", at, end))
                at = end + 1
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def written(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start, joined by commas."""
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


# --- candidates -------------------------------------------------------------------------------------------

_KEYED = re.compile(r"(?i)(?:password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key|auth)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{4,})")
#: Longer keyed secrets are judged by their first so many characters.
HEAD = 200
_RUN = re.compile(r"[A-Za-z0-9_+/=-]+")
_RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-")
_NUMBER = re.compile(r"\(?[0-9][0-9 ().\-/]{5,28}[0-9]")
_ID = re.compile(r"(?<![0-9A-Za-z])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_SPELLED = re.compile(r"(?i)[a-z0-9._%+-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[a-z0-9-]{1,63}(?:\s?[\[({]\s?dot\s?[\])}]\s?[a-z0-9-]{1,63}|\.[a-z0-9-]{1,63}){1,4}")


def candidates(text: str) -> list[Span]:
    """Spans that could be personal data or secrets; they may overlap and most of them may be wrong."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("secret", m.start(1), m.end(1)) for m in _KEYED.finditer(text)]
    if "(at)" in text.lower() or any(f"{a}at{b}" in text for a, b in ("[]", "{}")) or re.search(r"[\[({]\s?at\s?[\])}]", text):
        found += [("spelled_email", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    first = _DIGIT.search(text)
    if not first:
        return found
    done = 0
    for m in re.finditer("[0-9]+", text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] in _RUN_CHARS:
            start -= 1
        done = _RUN.match(text, start).end()
        if done - start >= 12:
            inner = text.find("=", start, done - 4) + 1
            found.append(("secret", inner if inner > start else start, done))
    found += [("local_phone", m.start(), m.end()) for m in _NUMBER.finditer(text) if 7 <= sum(c.isdigit() for c in m[0]) <= 12]
    found += [("national_id", m.start(), m.end()) for m in _ID.finditer(text)]
    found += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text)]
    return found


# --- features ---------------------------------------------------------------------------------------------

_CONTEXT = (
    re.compile(r"(?i)passw|passphrase|pwd"),
    re.compile(r"(?i)token|secret|key|auth|bearer"),
    re.compile(r"(?i)phone|tel\b|call|mobile|fax|dial|ring|my number"),
    re.compile(r"(?i)ssn|social|national|\bid\b"),
    re.compile(r"(?i)iban|bank|account"),
    re.compile(r"(?i)mail|contact|reach"),
    re.compile(r"(?i)isbn|issn|doi|version|page|price|order|part|item|chapter|figure|year|date|sku|serial"),
)


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34 or not s.isascii() or not s.isalnum():
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, start, end = span
    s = text[start:end]
    n = len(s)
    digits = sum("0" <= c <= "9" for c in s)
    upper = sum("A" <= c <= "Z" for c in s)
    lower = sum("a" <= c <= "z" for c in s)
    counts = [s.count(c) / n for c in set(s)]
    before, after = text[max(0, start - 24) : start], text[end : end + 8]
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    return [
        KINDS.index(kind), n, digits / n, upper / n, lower / n, -sum(c * math.log2(c) for c in counts), switches / n,
        float(all(c in "0123456789abcdefABCDEF" for c in s)), s.count("-"), s.count("."), s.count(" "), s.count("("), s.count("/"),
        len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, digits, float(_iban_valid(s)), float(s[:3] in ("000", "666") or s[:1] == "9"),
        float(re.match(r"(?:19|20)[0-9]{2}[-/. ]", s) is not None or re.search(r"[-/. ](?:19|20)[0-9]{2}$", s) is not None),
        float(before[-1:] in ("=", '"', "'", ":")), float(before[-1:].isspace() or not before), float(after[:1].isspace() or after[:1] in ("", ".", ",", '"', "'")), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        *(float(p.search(before) is not None) for p in _CONTEXT),
    ]


# --- training on generated examples -----------------------------------------------------------------------

_SYLLABLES = "an the re in on er ti sh or ed is at es en of ea it hi ar te se ha ou nd le ve co me de".split()


def _example(r: random.Random) -> tuple[str, tuple[int, int] | None]:
    """A short text, and where in it a wanted span is (None: it holds none)."""
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kind = r.randrange(21)
    lead, value, good = "", "", True
    if kind == 0:
        lead, value = r.choice(["password=", "passwd: ", "pwd=", "password: "]), some(low + up + "0123456789", r.randint(8, 24))
    elif kind == 1:
        lead, value = r.choice(["token = ", "secret=", "api_key: ", "token: ", "auth="]), some("0123456789abcdef", r.choice([32, 40, 64]))
        lead += r.choice(['"', "", "'"])
    elif kind == 2:
        value = r.choice(["AKIA", "ASIA", "ghp_", "sk-", "xoxb-"]) + some(up + r.choice(["0123456789", "234567"]), r.randint(16, 32))
    elif kind == 3:
        value = some("0123456789abcdef", r.choice([18, 32, 40]))
        lead = r.choice(["password=", "key=", "token="])
    elif kind in (4, 5):
        a, b, c = digits(3), digits(3), digits(4)
        value = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{digits(2)} {digits(4)} {digits(4)}"])
        lead = r.choice(["call ", "phone: ", "tel ", "", "mobile "])
        if r.random() < 0.5:  # groups of any sizes, where a word before them says that it is a phone
            groups = [r.choice(["0", ""]) + digits(r.randint(2, 5)), *(digits(r.randint(2, 6)) for _ in range(r.randint(1, 3)))]
            groups[0] = f"({groups[0]})" if r.random() < 0.3 else groups[0]
            value, lead = r.choice([" ", "-", ".", "/"]).join(groups), lead or "phone "
            if not 8 <= sum(map(str.isdigit, value)) <= 12:
                value = f"{a} {b} {c}"
    elif kind == 6:
        value, lead = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", r.choice(["SSN ", "ssn: ", "", "id "])
    elif kind == 7:
        value = _iban(r.choice(up) + r.choice(up), digits(r.randint(4, 6)) + some("0123456789" + r.choice(["", up]), r.randint(7, 20)), r.random() < 0.5)
    elif kind in (8, 9):
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", ".")])
        value, lead = word() + at + word() + dot + r.choice(["com", "org", "net"]), r.choice(["mail ", "contact ", ""])
    else:
        good = False
        value = [
            lambda: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1900, 2099)}",
            lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2099)}", lambda: f"{r.randint(1, 9)}.{digits(2)}.{digits(3)}.{digits(4)}", lambda: digits(r.randint(7, 12)), lambda: digits(r.randint(12, 20)), lambda: digits(16), lambda: f"{word()}{word()}{word()}{r.choice('_.=/')}{digits(r.randint(2, 4))}", lambda: f"{r.randint(1900, 2020)}-{r.randint(1900, 2099)}",
            lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{digits(3)} {digits(3)}", lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 99)}", lambda: f"{word()}{word()}{word()}{r.randint(1, 9)}",
            lambda: f"{r.randint(1, 9)},{digits(3)},{digits(3)}.{digits(2)}", lambda: f"{digits(2)} {digits(3)} {digits(3)}", lambda: _iban("XX", digits(r.randint(11, 24)), r.random() < 0.5).replace("XX", r.choice(["DK", "SE", "LU"])), lambda: f"{digits(2)}-{digits(5)}", lambda: f"{digits(4)}-{digits(4)}-{digits(2)}", lambda: f"{up[r.randrange(26)]}{up[r.randrange(26)]}{digits(2)} {some(up, 4)} {some(up, 4)} {digits(2)}", lambda: f"{digits(6)}/{digits(4)}", lambda: f"9{digits(2)}-{digits(2)}-{digits(4)}",
        ][r.randrange(21)]()
        lead = r.choice(["", "", "page ", "order ", "ISBN ", "version ", "part ", "year ", "key: ", "total "])
    if kind in (1, 3) and r.random() < 0.3:
        value, lead = value.upper(), r.choice([lead, lead.upper()])
    head = words(r.randint(2, 5)) + " " + lead
    return head + value + r.choice([" ", ". ", ", ", "\n"]) + words(r.randint(1, 4)), (len(head), len(head) + len(value)) if good else None


def _other_example(r: random.Random) -> tuple[str, tuple[int, int] | None]:
    """As _example(), from templates, key words and formats that it doesn't have: what thresholds are set on."""
    low, up, ten = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    word = lambda: some(low, r.randint(2, 9))
    wanted = {
        "secret": [
            lambda: ("passphrase: ", some(low + ten, r.randint(10, 20))), lambda: ("export API_KEY='", some(up + low + ten, r.randint(20, 48))), lambda: ('"access_key": "', some(up + ten, 20)),
            lambda: ("Authorization Bearer ", some(up + low + ten + "-_", r.randint(30, 60)) + some(ten, 3)), lambda: ("auth: ", some(ten + "abcdef", 48)), lambda: ("secret key ", some(up + low + ten + "+/", 40) + some(ten, 2)),
        ],
        "local_phone": [
            lambda: (r.choice(["ring us on ", "fax: ", "Tel. ", "dial ", "my number: "]), r.choice([f"0{some(ten, 3)} {some(ten, 6)}", f"({some(ten, 4)}) {some(ten, 6)}", f"{some(ten, 3)}-{some(ten, 4)}-{some(ten, 4)}", f"{some(ten, 3)}/{some(ten, 3)}-{some(ten, 4)}"])),
        ],
        "national_id": [lambda: (r.choice(["social security number ", "National ID: ", "soc. sec. "]), f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}")],
        "iban": [lambda: (r.choice(["pay into ", "account ", "IBAN: "]), _iban(r.choice(["NL", "IT", "AT", "PL"]), some(ten, r.choice([14, 16, 20])), r.random() < 0.5))],
        "spelled_email": [lambda: (r.choice(["reach me: ", "e-mail ", "", "write "]), word() + r.choice([".", "_", ""]) + word() + (dots := r.choice([("{at}", "{dot}"), (" [at] ", " [dot] "), ("(AT)", "(DOT)"), ("[at]", ".")]))[0] + word() + dots[1] + r.choice(["de", "io", "edu"]))],
    }
    unwanted = [
        lambda: f"{r.randint(1, 12):02d}-{r.randint(1, 28):02d}-{r.randint(1950, 2030)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}-rc{r.randint(1, 9)}", lambda: f"{some(ten, 16)}", lambda: f"pp. {r.randint(100, 400)}-{r.randint(401, 999)}",
        lambda: f"{some(ten, 4)}-{some(ten, 3)}X", lambda: f"{r.randint(1, 999)} {some(ten, 3)} {some(ten, 3)}", lambda: f"img_{some(ten, 8)}_{r.randint(1, 99)}", lambda: f"{word()}{word()}{word()}-{r.randint(1950, 2030)}", lambda: f"{some(ten, 2)}:{some(ten, 2)}:{some(ten, 2)}.{some(ten, 3)}",
        lambda: f"{some(up, 2)}{some(ten, 2)} {some(up + ten, 4)} {some(up + ten, 4)} {some(up + ten, 4)}", lambda: f"{r.choice(['000', '666', '9' + some(ten, 2)])}-{some(ten, 2)}-{some(ten, 4)}", lambda: f"key: {word()}", lambda: f"{some(ten, 5)}-{some(ten, 4)}",
    ]
    kind = r.choice([*wanted, *[None] * 5])
    lead, value = r.choice(wanted[kind])() if kind else (r.choice(["", "no. ", "see ", "ref ", "edition "]), r.choice(unwanted)())
    head = " ".join(word() for _ in range(r.randint(1, 6))) + " " + lead
    tail = r.choice(["'", '"', " ", ".", ";", ")"]) if lead[-1:] not in ("'", '"') else lead[-1]
    return head + value + tail + " " + word(), (len(head), len(head) + len(value)) if kind else None


def _iban(country: str, body: str, spaced: bool) -> str:
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    value = f"{country}{check:02d}{body}"
    return " ".join(value[i : i + 4] for i in range(0, len(value), 4)) if spaced else value


def _is_wanted(span: Span, wanted: tuple[int, int] | None) -> bool:
    return wanted is not None and span[1] >= wanted[0] - 1 and span[2] <= wanted[1] + 1 and span[2] - span[1] >= 0.8 * (wanted[1] - wanted[0])


#: Generated examples that the trees are fitted on, and of the other family that calibration and thresholds are.
EXAMPLES = 8000
#: Precision that a kind's threshold keeps on the other family's examples; of the thresholds that do, the lowest
#: counts, but no span is taken that is likelier to be none.
PRECISION = 0.95


def _described(make, r: random.Random, examples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, kinds = [], [], []
    for _ in range(examples):
        text, wanted = make(r)
        for span in candidates(text):
            x.append(features(text, span))
            y.append(float(_is_wanted(span, wanted)))
            kinds.append(span[0])
    return np.array(x), np.array(y), np.array(kinds)


@functools.lru_cache(maxsize=2)
def trained(seed: int = 7, examples: int = EXAMPLES) -> tuple[BoostedTrees, np.ndarray, dict[str, float]]:
    """Trees of one family of examples; calibration and each added kind's threshold of the other."""
    r = random.Random(seed)
    a, b, _ = _described(_example, r, examples)
    trees = BoostedTrees().fit(a, b)
    x, y, k = _described(_other_example, r, examples)
    scores = trees.raw(x)
    curve = logistic(scores[:, None], y)
    probability = 1 / (1 + np.exp(-(scores * curve[0] + curve[1])))
    thresholds = {}
    for kind in ADDED:
        own = k == kind
        order = np.argsort(-probability[own], kind="stable")
        p, t = probability[own][order], y[own][order]
        last = np.append(p[1:] < p[:-1], True)  # equal scores stand or fall together
        good = np.flatnonzero(last & (np.cumsum(t) / np.arange(1, len(t) + 1) >= PRECISION))
        thresholds[kind] = max(0.5, float(p[good[-1]])) if len(good) else 2.0
    return trees, curve, thresholds


class Finder:
    """Base spans and accepted candidates of a text."""

    def __init__(self, model=None):
        self.trees, self.curve, self.thresholds = model or trained()

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        proposed = candidates(text)
        if not proposed:
            return base, []
        taken = _joined((s, e) for _, s, e in base)
        free = [(c, c) for c in dict.fromkeys(proposed) if not _overlaps(taken, c)]
        if any(kind == "secret" and end - start > HEAD for kind, start, end in proposed):
            for start, end in (m.span(1) for m in _KEYED.finditer(text) if m.end(1) - m.start(1) > HEAD):
                head = ("secret", start, start + HEAD)
                if not _overlaps(taken, head):
                    free += [(("secret", a, b), head) for a, b in _around(taken, start, end)]
        if not free:
            return base, []
        raw = self.trees.raw(np.array([features(text, judged) for _, judged in free]))
        probability = 1 / (1 + np.exp(-(raw * self.curve[0] + self.curve[1])))
        added: list[Span] = []
        used: list[tuple[int, int]] = []
        for p, c in sorted(zip(probability.tolist(), (c for c, _ in free), strict=True), key=lambda x: (-x[0], x[1][1], -x[1][2], x[1][0])):
            if p >= self.thresholds[c[0]] and not _overlaps(used, c):
                added.append(c)
                bisect.insort(used, c[1:])
        return base, added


def _joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places that spans cover, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _overlaps(taken: list[tuple[int, int]], span: Span) -> bool:
    """Whether a span overlaps one of the disjoint, ordered ones."""
    at = bisect.bisect_left(taken, (span[2],))  # those before it begin before the span's end
    return at > 0 and taken[at - 1][1] > span[1]


def _around(taken: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The parts from start to end that no taken span (disjoint, in order) covers."""
    parts = []
    at = max(0, bisect.bisect_left(taken, (start,)) - 1)
    while at < len(taken) and taken[at][0] < end:
        s, e = taken[at]
        if start < s:
            parts.append((start, s))
        start, at = max(start, e), at + 1
    return [*parts, (start, end)] if start < end else parts


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones joined) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


FOUND = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "redacted"]


def find(df: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """df's rows with counts by base kind, base_sha256, spans, their number and, if asked for, the redacted text.

    Columns of these names are replaced; the text column itself is dropped unless redact. Null counts as empty:
    no spans (and a redacted text of null stays null). Repeated rows are judged each; whole texts of any length
    are searched; an empty table gives an empty result.
    """
    added = FOUND if redact else FOUND[:-1]
    kept = [c for c in df.columns if c not in added]
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    carried = [c for c in kept if redact or c != text]
    schema = T.StructType([rows.schema[c] for c in carried])
    for name in added:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    bounded_batches(df.sparkSession)
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in slices(batches, text):
            out: list[list] = [[] for _ in added]
            given = batch.column(text).to_pylist()
            for string in given:
                base, more = finder.spans(string or "")
                for i, kind in enumerate(BASE):
                    out[i].append(sum(s[0] == kind for s in base))
                out[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                out[5].append(written(base + more))
                out[6].append(len(base) + len(more))
                if redact:
                    out[7].append(None if string is None else redacted(string, base + more))
            types = [pa.int64() if name.startswith("n_") else pa.string() for name in added]
            columns = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns], names=[*carried, *added])

    return rows.mapInArrow(tidied(run), schema)
