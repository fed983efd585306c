"""URL verdicts: host rules by longest match, and pattern rules fetched by their rarest literal token.

The regular expression of each pattern rule is parsed for the tokens that its matches hold whole. For each way that it
can match, the rule is filed under the token that the fewest URLs of the table hold; a URL's tokens fetch the rules
filed under them, and only those rules' expressions run. Rules with a way to match that holds no certain token are few
and always run. The cost of a URL follows its tokens, not the number of rules.
"""

from __future__ import annotations

import itertools
import re
import re._constants as kinds
import re._parser as parser
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, broadcast_if_small

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    """verdict for the host, its subdomains, and paths that start with the path; written like `example.com/de/`."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: Ways to match that a rule is taken apart into at most; a rule of more always runs.
WAYS = 256
#: In a way to match: characters that end tokens, and anything that may also join them.
_END, _OPEN = None, ...
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _joined(parts: Sequence[list[tuple]]) -> list[tuple]:
    """The ways of parts that follow one another."""
    out: list[tuple] = [()]
    for ways in parts:
        out = list(dict.fromkeys(a + b for a, b in itertools.product(out, ways)))
        if len(out) > WAYS:
            return [(_OPEN,)]
    return out


def _of_class(items: list) -> list[tuple]:
    """The ways of a character class: marks only, a few letters, or anything."""
    negated = items[0][0] is kinds.NEGATE
    held: set[str] = set()
    for kind, value in items[negated:]:
        if kind is kinds.LITERAL:
            held.add(chr(value))
        elif kind is kinds.RANGE and value[1] < 0x3000:
            held.update(map(chr, range(value[0], value[1] + 1)))
        elif not (negated and kind is kinds.CATEGORY):  # in a negated class, a category only takes more away
            return [(_OPEN,)]
    if negated:
        return [(_END,)] if _ALNUM <= held else [(_OPEN,)]
    letters = held & _ALNUM
    if len(letters) > 8:
        return [(_OPEN,)]
    return [(c,) for c in sorted(letters)] + ([(_END,)] if held - _ALNUM else [])


def _ways(tree) -> list[tuple]:
    """The ways of a parsed expression, each a sequence of letters, _END and _OPEN."""
    parts: list[list[tuple]] = []
    for kind, value in tree:
        if kind is kinds.LITERAL:
            parts.append([(chr(value) if chr(value) in _ALNUM else _END,)])
        elif kind is kinds.NOT_LITERAL or kind is kinds.ANY:
            parts.append([(_OPEN,)])
        elif kind is kinds.IN:
            parts.append(_of_class(value))
        elif kind is kinds.AT:
            parts.append([(_END,)] if value in (kinds.AT_BEGINNING, kinds.AT_BEGINNING_STRING, kinds.AT_END, kinds.AT_END_STRING) else [(_OPEN,)])
        elif kind is kinds.BRANCH:
            parts.append([way for branch in value[1] for way in _ways(branch)])
        elif kind is kinds.SUBPATTERN:
            parts.append(_ways(value[3]))
        elif kind is kinds.ATOMIC_GROUP:
            parts.append(_ways(value))
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = _ways(inner)
            if all(way == (_END,) for way in once):
                many = [(_END,)]
            elif most == 1:
                many = once
            elif least == most and least * len(once) <= 8:
                many = _joined([once] * least)
            else:
                many = [(_OPEN,)]
            parts.append(many if least else [(), *many])
        else:
            parts.append([(_OPEN,)])
    return _joined(parts)


def whole_tokens(regex: str) -> list[frozenset[str]] | None:
    """For each way that the expression can match, the tokens that a text with such a match holds whole.

    None if there is a way without any, or if there are too many ways: then nothing is certain.
    """
    found: set[frozenset[str]] = set()
    tree = parser.parse(regex)
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE | re.MULTILINE):
        return None
    for way in _ways(tree):
        tokens, now = set(), [_OPEN]
        for part in [*way, _OPEN, _END]:
            if part is not _END:
                now.append(part)
                continue
            if now and _OPEN not in now:
                tokens.add("".join(now))
            now = []
        if not tokens:
            return None
        found.add(frozenset(tokens))
    return sorted((way for way in found if not any(less < way for less in found)), key=sorted)  # less is held with it


@dataclass(frozen=True)
class PatternRule:
    """verdict for URLs (A-Z lower-cased) that match the regex."""

    name: str
    regex: str
    verdict: str = "block"

    @cached_property
    def tokens(self) -> list[frozenset[str]] | None:
        """Of each way to match, the tokens that it is sure to hold; None if one holds none."""
        return whole_tokens(self.regex)


HOST_RULES = (HostRule("net/", "block"), HostRule("example.net/en/", "allow"), HostRule("example.com/de/", "block"), HostRule("org/fr/", "allow"))

_B, _E = r"(?:^|[^a-z0-9])", r"(?:[^a-z0-9]|$)"
PATTERN_RULES = (
    PatternRule("casino", rf"{_B}(?:online|play|win)?[^a-z0-9]*casino[^a-z0-9]+(?:win|online|bonus|slots?){_E}"),
    PatternRule("bets", rf"{_B}free[^a-z0-9]+bets{_E}"),
    PatternRule("pills", rf"{_B}cheap[^a-z0-9]+pills{_E}"),
    PatternRule("tracker", rf"{_B}ads[^a-z0-9]+track{_E}"),
    PatternRule("adult", rf"{_B}xxx[^a-z0-9]+(?:videos?|cams?){_E}"),
    PatternRule("payday", rf"{_B}payday[^a-z0-9]+loans?{_E}"),
)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


class HostIndex:
    """Host rules by host, so that a URL looks up only its own suffixes."""

    def __init__(self, rules: Sequence[HostRule]):
        self.by_host: dict[str, list[HostRule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule.host, []).append(rule)

    def match(self, host: str, path: str) -> HostRule | None:
        """The longest fitting rule; of equally long ones the one with the longer host."""
        best, labels = None, host.split(".")
        for i in range(len(labels)):
            for rule in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(rule.path) and (best is None or (len(rule.text), len(rule.host)) > (len(best.text), len(best.host))):
                    best = rule
        return best


class PatternIndex:
    """Pattern rules filed under the rarest token of each way to match, given how many URLs hold each token."""

    def __init__(self, rules: Sequence[PatternRule], frequency: dict[str, int]):
        self.rules = rules
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.compiled: dict[int, re.Pattern] = {}
        for i, rule in enumerate(rules):
            if rule.tokens is None:
                self.always.append(i)
                continue
            for token in {min(way, key=lambda t: (frequency.get(t, 0), t)) for way in rule.tokens}:
                self.by_token.setdefault(token, []).append(i)

    def match(self, url: str | None) -> PatternRule | None:
        """The first of the rules, in their given order, that matches."""
        lower = (url or "").translate(LOWER)
        fetched = {i for token in set(TOKEN.findall(lower)) for i in self.by_token.get(token, ())}
        for i in sorted(fetched.union(self.always)):
            regex = self.compiled.get(i) or self.compiled.setdefault(i, re.compile(self.rules[i].regex))
            if regex.search(lower):
                return self.rules[i]
        return None


def literal_frequency(df: DataFrame, url: str, rules: Sequence[PatternRule]) -> dict[str, int]:
    """Over all rows, how many URLs hold each of the rules' tokens; as many numbers as there are of them.

    Tokens that only one rule could be filed under aren't counted.
    """
    wanted = sorted({t for rule in rules for way in rule.tokens or () if len(way) > 1 for t in way})
    if not wanted:
        return {}
    small = df.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
    small = broadcast_if_small(small, len(wanted), 32 + max(map(len, wanted)))
    lower = F.translate(F.col(f"`{url}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = df.select(F.explode(F.array_distinct(F.split(lower, "[^a-z0-9]+"))).alias("t")).join(small, "t")
    return {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}


def judge(df: DataFrame, url: str = "url", host_rules: Sequence[HostRule] = HOST_RULES, pattern_rules: Sequence[PatternRule] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """df's rows with host, path, rule, pattern and verdict added; columns of these names are replaced.

    A fitting host rule decides, else the first matching pattern rule, else the default. A null URL or one
    without :// has an empty host and path and fits no host rule. URLs are judged whole, whatever their length.
    Repeated rows are judged each; an empty table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    added = ["host", "path", "rule", "pattern", "verdict"]
    kept = [c for c in df.columns if c not in added]
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    frequency = literal_frequency(rows, url, pattern_rules)
    schema = T.StructType(list(rows.schema.fields))
    for name in added:
        schema = schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, patterns = HostIndex(host_rules), PatternIndex(pattern_rules, frequency)
        for batch in batches:
            out: list[tuple] = []
            for address in batch.column(url).to_pylist():
                host, path = host_and_path(address)
                rule = hosts.match(host, path)
                pattern = None if rule else patterns.match(address)
                out.append((host, path, rule and rule.text, pattern and pattern.name, (rule or pattern).verdict if rule or pattern else default))
            columns = [pa.array([x[i] for x in out], pa.string()) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return rows.mapInArrow(run, schema)
