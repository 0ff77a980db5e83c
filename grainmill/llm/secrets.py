"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Maximal runs of token characters, less the base patterns' spans, are cut at ``=``; pieces of
20 or more are candidates.  A piece that no one alphabet holds is cut at ``-`` and ``_``, at
``+`` and ``/``, and at all of these, and all these pieces are candidates.  An encoding is
inferred as the smallest alphabet that holds all its characters.  Three tests ask
whether its symbols look drawn uniformly from that alphabet: chi-squared uniformity,
Wald-Wolfowitz runs about the middle of the alphabet, and lag-one serial correlation;
Fisher's method joins them.  A piece carries an e-value: the likelihood ratio of uniform
symbols against a model of ordinary wording (letter frequencies, few changes of character
class), times a factor of at most 1 that falls steeply with the tests' joint p-value once it is
below ``UNIFORM_LEVEL``.  The ratio's mean is at most 1 for ordinary tokens, and so is the
product's, so the weighted e-BH procedure over a document's candidates holds the expected share
of false discoveries at ``fdr`` whatever their dependence; longer tokens weigh more and earn
more evidence.

Defined cases: null text counts as empty and has no spans; texts of any length are scanned
whole; empty tables give empty results; repeated rows and rows with equal doc_id are scanned
each on its own; spans of one start are listed by kind; other columns, whatever their names,
are ignored.
Positions are code points, ends exclusive, over the whole text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import islice, takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import DOCUMENT_COLUMNS, map_rows

QUERY = "op1_secret_scan"
ORACLE_SQL = None

#: Kinds of spans in the order in which they are listed at the same start.
KINDS = ("assign", "access", "hex", "random")

#: Share of false discoveries that the battery may expect; the joint p-value under which symbols that are not uniform
#: lose evidence, and the power of their ratio by which they do.
FDR, UNIFORM_LEVEL, UNIFORM_POWER = 1e-6, 0.02, 6

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Pieces of a run; of one that no alphabet holds, by each pair of signs and by all.
PIECES = tuple(re.compile(rf"[A-Za-z0-9{signs}]{{20,}}") for signs in ("+/_-", "+/", "_-", ""))
#: The base patterns.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets from small to large; digits alone are numbers, not secrets.
ALPHABETS = {
    "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER, "base32": UPPER + "234567",
    "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER, "letters": UPPER + LOWER, "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: Letters per thousand in ordinary Latin-script wording.
LETTERS = dict(zip(LOWER, (84, 14, 30, 42, 130, 18, 19, 38, 72, 3, 6, 43, 25, 71, 72, 25, 4, 66, 66, 78, 33, 10, 14, 2, 13, 4), strict=True))
STAY, MOVE = math.log2(0.85), math.log2(0.15 / 3)


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


_SUM = sum(LETTERS.values())
WORDING = {c: math.log2(n / _SUM) for c, n in LETTERS.items()}
WORDING |= {c.upper(): v for c, v in WORDING.items()} | {c: math.log2(0.1) for c in DIGITS} | {c: -2.0 for c in "+/_-"}


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(token: str) -> str | None:
    """Smallest alphabet that holds the token; None for digits alone or mixed symbols."""
    own = set(token)
    if own <= set(DIGITS):
        return None
    return next((name for name, alphabet in ALPHABETS.items() if own <= set(alphabet)), None)


def battery(token: str, name: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation, for symbols drawn from the alphabet."""
    alphabet = ALPHABETS[name]
    at = [alphabet.index(c) for c in token]
    n, k = len(at), len(alphabet)
    counts: dict[int, int] = {}
    for x in at:
        counts[x] = counts.get(x, 0) + 1
    chi = sum(c * c for c in counts.values()) * k / n - n
    mean, sd = k - 1, math.sqrt(2 * (k - 1) * (n - 1) / n)
    degrees = 2 * mean * mean / (sd * sd)  # scaled chi-squared of the same mean and variance
    cube = (max(chi, 0) / mean) ** (1 / 3)
    uniform = _normal_tail((cube - (1 - 2 / (9 * degrees))) / math.sqrt(2 / (9 * degrees)))
    above = [x >= k / 2 for x in at]
    ones = sum(above)
    zeros = n - ones
    runs = 1 + sum(a != b for a, b in zip(above, above[1:], strict=False))
    expected = 2 * ones * zeros / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs_p = 2 * _normal_tail(abs(runs - expected) / math.sqrt(spread)) if spread > 0 else 2.0 ** (1 - n)
    middle = sum(at) / n
    square = sum((x - middle) ** 2 for x in at)
    lag = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:], strict=False))
    serial = 2 * _normal_tail(abs(lag / square + 1 / n) * math.sqrt(n)) if square else 0.0
    return uniform, runs_p, serial


def fisher(p: tuple[float, ...]) -> float:
    """Joint p-value of independent p-values: upper tail of chi-squared of 2k degrees."""
    half = -sum(math.log(min(1.0, max(x, 1e-300))) for x in p)
    term = total = math.exp(-half)
    for i in range(1, len(p)):
        term *= half / i
        total += term
    return total


def evidence(token: str, name: str) -> float:
    """Bits by which uniform symbols explain the token better than ordinary wording."""
    wording, before = -2.0, _class(token[0])
    for i, c in enumerate(token):
        now = _class(c)
        wording += WORDING[c] + (0 if i == 0 else STAY if now == before else MOVE)
        before = now
    return -math.log2(len(ALPHABETS[name])) * len(token) - wording


def e_bits(token: str) -> float:
    """Logarithm of a token's e-value: evidence, less what the battery takes."""
    if (name := encoding(token)) is None:
        return -math.inf
    return evidence(token, name) + UNIFORM_POWER * min(0.0, math.log2(max(fisher(battery(token, name)), 1e-300) / UNIFORM_LEVEL))


def discoveries(tokens: list[str], fdr: float = FDR) -> list[bool]:
    """Which tokens of one document are random: weighted e-BH with weights by length."""
    bits = list(map(e_bits, tokens))
    if not tokens:
        return []
    mean = sum(map(len, tokens)) / len(tokens)
    weighed = [b + math.log2(len(t) / mean) for b, t in zip(bits, tokens, strict=True)]
    ordered = sorted(weighed, reverse=True)
    bar = math.log2(len(tokens) / fdr)
    kept = max((i for i, b in enumerate(ordered, 1) if b >= bar - math.log2(i)), default=0)
    return [b >= ordered[kept - 1] if kept else False for b in weighed]


def candidates(text: str, runs: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pieces of runs outside the spans, of 20 characters or more, that are tested."""
    found: dict[tuple[int, int], None] = {}
    spans, at = sorted(spans), 0

    def cut(a: int, b: int, signs: re.Pattern) -> Iterator[tuple[int, int]]:
        for m in signs.finditer(text, a, b):
            c, d = m.span()
            while d - c >= 20 and text[c] in "+/_-":
                c += 1
            while d - c >= 20 and text[d - 1] in "+/_-":
                d -= 1
            if d - c >= 20:
                yield c, d

    for a, b in runs:
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        free = []
        for s, e in takewhile(lambda x: x[0] < b, islice(spans, at, None)):
            free.append((a, s))
            a = max(a, e)
        for x in [*free, (a, b)]:
            for c, d in cut(*x, PIECES[0]) if x[1] - x[0] >= 20 else ():
                if encoding(text[c:d]) is None:
                    found.update(dict.fromkeys(piece for signs in PIECES[1:] for piece in cut(c, d, signs)))
                else:
                    found[c, d] = None
    return list(found)


def scan(text: str | None, fdr: float = FDR) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start and then kind as listed."""
    if not text:
        return []
    spans: list[tuple[str, int, int]] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if "passw" in low or "secret" in low or "token" in low or "api" in low or not text.isascii():
            spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    runs = [run.span() for run in CANDIDATE.finditer(text)]
    for a, b in runs:  # hexadecimal and access spans lie within such runs
        if "AKIA" in text[a:b]:
            spans += [("access", a + m.start(), a + m.end()) for m in ACCESS.finditer(text[a:b]) if m.end() - m.start() >= 20]
        spans += [("hex", a + m.start(), a + m.end()) for m in HEX.finditer(text[a:b])]
    if rest := candidates(text, runs, [(s, e) for _, s, e in spans]):
        random = [x for x, found in zip(rest, discoveries([text[a:b] for a, b in rest], fdr), strict=True) if found]
        end = -1
        for a, b in sorted(random, key=lambda x: (x[0], -x[1])):  # those within others go
            if b > end:
                spans.append(("random", a, b))
                end = b
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            spans = scan(text, fdr)
            n = [sum(s[0] == kind for s in spans) for kind in KINDS]
            base = _joined([s for s in spans if s[0] != "random"])
            yield doc_id, *n, hashlib.sha256(base.encode()).hexdigest(), _joined(spans)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """Documents with every span (overlapping ones joined) replaced by ``mark``; n_chars follows the text.

    No row goes: rows without spans, and null texts, stay as they are.
    """

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, lang, source, n_chars in rows:
            spans = scan(text, fdr)
            if spans:
                parts, done = [], 0
                for _, a, b in spans:
                    if a >= done:
                        parts += [text[done:a], mark]
                    done = max(done, b)
                text = "".join(parts) + text[done:]
                n_chars = len(text)
            yield doc_id, text, lang, source, n_chars

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return map_rows(docs.select(*DOCUMENT_COLUMNS), work, schema, chunk=64)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
