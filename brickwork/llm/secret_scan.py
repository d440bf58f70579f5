"""Secret scans: base patterns, and password guess costs for credential contexts.

``scan_secrets`` finds three kinds of base spans in the whole text (assign,
access, hex) and a fourth one, guess, by the method: every value in a
credential context is cut into words, dates, repeats, keyboard walks, joins
and brute-force spans at the least total guess cost, by dynamic programming; a
value that would take at least ``min_log10_guesses`` guesses is a secret.

Defined results. Null text: no spans, like the empty text. Texts of any length
are scanned whole. Repeated rows give repeated results. An empty table gives
an empty table. Other columns of the input are left out by ``scan_secrets``
and pass through ``with_secret_spans``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import math
import re

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import long, string, with_text_columns

ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Names of credentials: words, and keys of something, written together, with a dash, an underscore or a space.
KEY = r"(?:api|access|private|auth|secret|client|account|encryption|signing|shared|master|licen[cs]e)[_\x20-]?key"
NAME = rf"(?:{KEY}|password|passwd|passphrase|pwd|pass|secret|token|credentials?|authorization|auth)"
#: Words that say how the value behind them is to be read (HTTP authentication schemes).
SCHEME = r"(?:bearer|basic|digest|negotiate|ntlm|oauth|dpop|gnap|hoba|hawk|jwt|mutual|vapid|token|api-?key|privatetoken|concealed|scram-sha-1|scram-sha-256|aws4-hmac-sha256|ssws)"
#: A credential context: a name that ends in such a word, a sign, schemes; a value follows.
CONTEXT = re.compile(rf"(?P<name>{NAME})(?:[\"']?\x20*[:=]\x20*|\x20+is\x20+)[\"']?(?P<schemes>(?:{SCHEME}\x20+)*+)", re.I | re.A)
VALUE = re.compile(r"[^\s\"'<>,;]*")
#: A value that is no value: a scheme (with version or quality) without one, or the name of a nested context (whose value is looked at in its turn).
NO_VALUE = re.compile(rf"{SCHEME}(?:[\d.]+(?:-[a-z]+)?)?\Z|[\w.-]*{NAME}[:=]\Z|{NAME}[:=]", re.I | re.A)
#: A value that stands for another one: a variable, an address without a password in it.
REFERENCE = re.compile(r"\$[{(]|\{\{|%[A-Za-z_]\w*%|\$[A-Z_]{2}[A-Z0-9_]*\Z|(?i:[a-z][a-z0-9+.-]*)://(?![^/]*:[^/]*@)", re.A)
#: A value that is code: a name, perhaps of several parts, that is called, indexed or read.
CODE = re.compile(r"([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)(?:[(\[]|\Z)", re.A)
#: In RE2's syntax, matching wherever one of the above can match.
MAYBE = r"(?i)(password|passwd|passphrase|pwd|pass|secret|token|key|credentials?|auth|authorization)[\"']?( *[:=]| +is )"
MAYBE_CODE = r"AKIA|[0-9a-f]{32}"
KINDS = ("assign", "access", "hex", "guess")

#: The commonest words and passwords, most common first; ``common_words`` has the others.
WORDS = (
    "password the 123456 and qwerty you that admin for welcome login letmein this with have dragon monkey master shadow "
    "sunshine princess football baseball superman michael secret love hello freedom whatever trustno1 test user root "
    "default changeme guest example sample demo temp pass access server system public private key token home work "
    "summer winter spring autumn january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday computer internet service company office london paris "
    "database oracle mysql postgres redis backup staging production prod dev local host none null true false string value "
    "your here from there about change name time year good"
).split()
#: The rows of a keyboard, and the letters and digits in order.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qazwsxedcrfvtgbyhnujm", "abcdefghijklmnopqrstuvwxyz")
#: Signs that join words (case-sensitive, and/or).
JOINS = "-_/."
LEET = str.maketrans("@4301$5!7", "aaeoissit")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
#: A run of so many letters, to so many, whose pairs are on average as likely as this (log10) is a word of some language, if not a listed one, and as hard to guess as one of so many.
COINED_LETTERS, COINED_MOST, COINED_PAIRS, COINED_WORDS = 8, 40, -1.36, 500_000
#: Values are looked at in stretches of this length, then twice as long, until it is sure that they are hard to guess.
STRETCH = 256
NEXT_KEY = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}


@functools.lru_cache(1)
def common_words() -> dict[str, int]:
    """Ranks of WORDS, and after them of the whole words of three public vocabularies.

    The vocabularies list pieces of large text collections, commonest first: pieces
    after a space of two byte vocabularies, and pieces that end a word of a third.
    A word has its best rank in any of the three.
    """
    lists: list[list[str]] = []
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        with open(public_tokenizers.path(name), "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        lists.append([p[1:].decode(errors="replace").lower() for p in pieces if p[:1] == b" "])
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    lists.append([p[:-4] for p in sorted(vocabulary, key=vocabulary.get) if p.endswith("</w>") and p.isascii()])
    best: dict[str, int] = {}
    for words in lists:
        for rank, w in enumerate(dict.fromkeys(w for w in words if len(w) >= 3 and w.isalpha()), 1):
            best[w] = min(rank, best.get(w, rank))
    ordered = dict.fromkeys([*WORDS, *sorted(best, key=lambda w: (best[w], w))])
    return {w: i for i, w in enumerate(ordered, 1)}


@functools.lru_cache(1)
def letter_pairs() -> tuple[dict[str, float], float]:
    """log10 of how likely a letter (or the end, "$") follows another (or the start, "^") in the listed words of all languages; and that of a pair that never occurs."""
    pairs: dict[str, int] = {}
    firsts: dict[str, int] = {}
    for w in common_words():
        if w.isalpha():
            for pair in map("".join, zip("^" + w, w + "$")):
                pairs[pair] = pairs.get(pair, 0) + 1
                firsts[pair[0]] = firsts.get(pair[0], 0) + 1
    extra = 0.1 * len({p[1] for p in pairs})
    return {p: math.log10((n + 0.1) / (firsts[p[0]] + extra)) for p, n in pairs.items()}, math.log10(0.1 / (max(firsts.values()) + extra))


def coined(run: str) -> bool:
    """Whether letters are put together as words are."""
    known, never = letter_pairs()
    lower = run.lower()
    return COINED_LETTERS <= len(run) <= COINED_MOST and sum(known.get(a + b, never) for a, b in zip("^" + lower, lower + "$")) / (len(lower) + 1) >= COINED_PAIRS


class GuessCost:
    """The least log10 of guesses over all ways to cut a value into known parts.

    For each end the best cut before it is kept, so time is linear in the
    value's length times the longest word, run or period looked at there.
    """

    def __init__(self, words=None, max_period: int = 8, coins: bool = True):
        self.ranks = common_words() if words is None else {w: i for i, w in reversed(list(enumerate(words, 1)))}
        self.longest = max(map(len, self.ranks), default=0)
        self.max_period = max_period
        self.coins = coins

    def known(self, run: str) -> bool:
        """Whether letters are a listed word or one that could be."""
        return len(run) <= 2 or run.lower() in self.ranks or coined(run)

    def parts(self, value: str) -> list[tuple[int, int, str, float]]:
        """Every known part as start, end, kind, log10 guesses."""
        lower, out, n = value.lower(), [], len(value)
        plain = lower.translate(LEET)
        for start in range(n):
            for end in range(start + 3, min(n, start + self.longest) + 1):
                rank = self.ranks.get(lower[start:end])
                changed = 0
                if rank is None:
                    rank, changed = self.ranks.get(plain[start:end]), 1
                if rank:
                    mixed = value[start:end] not in (lower[start:end], value[start:end].capitalize())
                    out.append((start, end, "word", math.log10(rank * 2 ** (changed + 2 * mixed + (value[start] != lower[start])))))
            if value[start] in JOINS and 0 < start < n - 1 and value[start - 1].isalpha() and value[start + 1].isalpha():
                out.append((start, start + 1, "join", math.log10(len(JOINS))))
            if lower[start].isdigit() and (m := DATE.match(value, start)):
                out.append((start, m.end(), "date", math.log10(365 * 120 if m.end() - start > 4 else 120)))
        for m in re.finditer(r"[^\W\d_]+", value) if self.coins else ():  # words that no list has
            if coined(run := m[0]):
                shaped = run in (lower[m.start() : m.end()], run.capitalize(), run.upper())
                out.append((m.start(), m.end(), "word", math.log10(COINED_WORDS) + (run[0] != lower[m.start()] if shaped else len(run)) * math.log10(2)))
        start = 0
        while start < n - 2:  # keyboard walks: maximal runs of neighbouring keys
            end = start + 1
            while end < n and (lower[end - 1], lower[end]) in NEXT_KEY:
                end += 1
            if end - start >= 3:
                out.append((start, end, "walk", math.log10(len(ROWS) * 20 * 2 * (end - start))))
            start = max(end - 1, start + 1)
        for period in range(1, self.max_period + 1):  # repeats: maximal runs of each period
            start = 0
            for at in range(period, n + 1):
                if at == n or value[at] != value[at - period]:
                    if at - start >= max(3, 2 * period):
                        base = value[start : start + period]
                        out.append((start, at, "repeat", min(self._brute(base), self._word(base)) + math.log10((at - start) / period)))
                    start = at - period + 1
        return out

    def _word(self, part: str) -> float:
        rank = self.ranks.get(part.lower())
        return math.log10(rank) if rank else math.inf

    def _brute(self, part: str) -> float:
        kinds = {0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in part}
        each = math.log10(sum((10, 26, 26, 33)[k] for k in kinds))
        return each * len(part)

    def least(self, value: str, enough: float) -> float:
        """The cost of a value, or of a beginning that costs ``enough`` whatever follows.

        A part that goes on beyond the beginning is cut short there: a repeat, walk or
        brute-force span then costs no more than the whole, a word or date is left out
        whole. So no cut of the whole costs less than the least of the states that are
        at most the longest such part before the beginning's end.
        """
        size, reach = STRETCH, max(self.longest, 2 * self.max_period, COINED_MOST)
        while size < len(value):
            bound = min(s[0] for s in self._states(value[:size])[size - reach :])
            if bound >= enough:
                return bound
            size *= 2
        return self._states(value)[len(value)][0]

    def _states(self, value: str) -> list[tuple]:
        """For every end the best cut up to there: cost, number of parts, start and kind of the last one."""
        n = len(value)
        by_end: list[list] = [[] for _ in range(n + 1)]
        for start, end, kind, cost in self.parts(value):
            by_end[end].append((start, kind, cost))
        kinds = {0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value}
        each = math.log10(max(10, sum((10, 26, 26, 33)[k] for k in kinds)))
        best = [(0.0, 0, 0, "")] + [None] * n  # cost, parts, start, kind
        for end in range(1, n + 1):
            cost, count, start, kind = best[end - 1]  # one more brute-force character, in the same span or a new one
            options = [(cost + each, count, start, kind) if kind == "brute" else (cost + each + 0.3, count + 1, end - 1, "brute")]
            for start, kind, more in by_end[end]:
                options.append((best[start][0] + more + 0.3, best[start][1] + 1, start, kind))
            best[end] = min(options)
        return best

    def cut(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """The least cost, and the parts of that cut; ties go to the fewer parts, then the longer last part."""
        best, n = self._states(value), len(value)
        out, end = [], n
        while end:
            _, _, start, kind = best[end]
            out.append((start, end, kind))
            end = start
        return best[n][0], out[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three base kinds, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def _is_context(text: str, m: re.Match, costs: GuessCost) -> bool:
    """Whether a matched name is one: "pass" may be the end of another word (compass, bypass)."""
    start = m.start()
    if m["name"].lower() != "pass" or start == 0 or not text[start - 1].isalpha() or text[start] == "P" and text[start - 1].islower():
        return True
    if " is " in m[0].lower():
        return False
    while start and text[start - 1].isalpha():
        start -= 1
    return text[start : m.start() + 4].lower() not in costs.ranks


def _stands_for_another(value: str, costs: GuessCost) -> bool:
    """Whether a value is a variable, an address, a call or a path of names made of words."""
    if REFERENCE.match(value):
        return True
    m = CODE.match(value)
    if not m or m.end() == len(value) and value[-1] not in "([" and "." not in m[1]:
        return False
    runs = re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[1]))
    return any(len(r) >= 4 for r in runs) and all(map(costs.known, runs))


def guess_spans(text: str, base: list, costs: GuessCost, least: float) -> tuple[list, float]:
    """Values in credential contexts that are hard to guess and not whole in a base or guess span, and the highest cost of any (of a long value: what was enough).

    Contexts may lie in the values of others: each is looked at, from its sign on.
    """
    out, most = [], 0.0
    m, stop, covered = CONTEXT.search(text), 0, 0
    while m:
        start = m.end()
        if start >= stop:  # else the value ends with that of the context around it
            stop = VALUE.match(text, start).end()
        value = text[start:stop] if stop - start >= 6 and stop > covered else ""
        value = value.rstrip(".!?)") if not value.endswith("()") else value
        if len(value) >= 6 and not NO_VALUE.match(value) and _is_context(text, m, costs) and not _stands_for_another(value, costs):
            cost = costs.least(value, least)
            most = max(most, cost)
            end = start + len(value)
            if cost >= least:
                covered = stop
                if not any(s <= start and end <= e for s, _, e in base):
                    out.append((start, 3, end))
        m = CONTEXT.search(text, m.start("schemes"))
    return out, most


def spans_text(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPAN_FIELDS = [long("n_assign"), long("n_access"), long("n_hex"), string("base_sha256"), string("spans"), long("n_guess"), T.StructField("max_log10_guesses", T.DoubleType())]


def _scanner(min_log10_guesses: float, words):
    def make():
        costs = GuessCost(words)
        nothing = hashlib.sha256(b"").hexdigest()

        def work(texts):
            n = len(texts)
            column = pa.array(texts, type=pa.large_string())
            maybe = pc.fill_null(pc.or_(pc.match_substring_regex(column, MAYBE), pc.match_substring_regex(column, MAYBE_CODE)), False)
            out = [[0] * n, [0] * n, [0] * n, [nothing] * n, [""] * n, [0] * n, [0.0] * n]
            for i in pc.indices_nonzero(maybe).to_pylist():
                base = base_spans(texts[i])
                more, most = guess_spans(texts[i], base, costs, min_log10_guesses)
                for k in range(3):
                    out[k][i] = sum(s[1] == k for s in base)
                out[3][i] = hashlib.sha256(spans_text(base).encode()).hexdigest()
                out[4][i] = spans_text(sorted(base + more))
                out[5][i], out[6][i] = len(more), most
            return out

        return work

    return make


def with_secret_spans(df: DataFrame, text_col: str = "text", min_log10_guesses: float = 10.0, words=None, prefix: str = "") -> DataFrame:
    """``df`` with counts, digest and list of the secret spans of its text."""
    fields = [T.StructField(prefix + f.name, f.dataType) for f in SPAN_FIELDS]
    return with_text_columns(df, text_col, fields, _scanner(min_log10_guesses, words))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10_guesses: float = 10.0) -> DataFrame:
    """One row per row of ``df``: id, counts, digest of base spans, all spans."""
    from pyspark.sql import functions as F

    out = with_secret_spans(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", min_log10_guesses)
    return out.withColumnRenamed("__id", id_col).drop("__text")


def redact(text: str | None, spans: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every listed span replaced; overlapping spans become one mark."""
    if not text or not spans:
        return text
    cuts = sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(","))
    out, at = [], 0
    for start, end in cuts:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(df: DataFrame, text_col: str = "text", min_log10_guesses: float = 10.0, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with the secrets in its text replaced by a mark; null stays null."""
    from .common import free_name

    schema, index, name = df.schema, df.columns.index(text_col), text_col
    field = free_name(df, "redacted")

    def make():
        scan = _scanner(min_log10_guesses, None)()

        def work(texts):
            return [[redact(t, s, mark) for t, s in zip(texts, scan(texts)[4])]]

        return work

    out = with_text_columns(df, text_col, [string(field)], make)
    return out.select(*[out[field].alias(name) if i == index else out[c] for i, c in enumerate(schema.names)])
