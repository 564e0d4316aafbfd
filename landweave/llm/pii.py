"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field segments each run of candidate tokens into entities and other tokens. A segment is up to
``LONGEST`` tokens; its score is a weight vector per type times features of the whole span (digit
groups, character classes, Luhn sum, shape, what stands before it), and each pair of neighbouring
segments adds a weight of their two types (other tokens are a type too). One dynamic program over the
run chooses boundaries and types together. Tokens without a digit or '@' can't begin or end an
entity, so the score of a text is the sum over its runs, and runs are solved alone.

The weights are fitted here, by the gradient of the conditional likelihood, on ``SAMPLES`` lines made
from templates by a seeded generator: entities of each type in several forms, alone or side by side, and
numbers that are none. Spans of the base patterns always stay; a span of the field is added where it
overlaps none. Ties of segmentations go to fewer entities, then to the type that KINDS names first.

* Every whole text is read once, in one pass without a shuffle; all scans take linear time.
* A null or empty text has no spans. Repeated rows are treated alike. Other columns are untouched. A very long text
  costs time by its length, as a run's segments are ``LONGEST`` tokens at most, and memory of some 30 bytes a token besides the text. Bytes that aren't UTF-8 are read, and
  by ``redacted`` written, as U+FFFD.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.llm.common import lean, plain, slices, utf8

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LONGEST = 5
SAMPLES = 1500
SEED = 7

Span = tuple[str, int, int]

# --- base patterns -------------------------------------------------------------------------

# The patterns of the base kinds. Email and ip are matched by their parts, in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")


def emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, end := m.end()))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    found = []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """By kind in the order of KINDS, then by start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    out += [("ip", a, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(only_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- the field -------------------------------------------------------------------------------

EDGE = ".,;:!?*$#%&|\"'<>[]{}=`"
HEX = frozenset("0123456789abcdefABCDEF")
SECRET_WORDS = frozenset("token secret password passwd pwd key apikey api_key api-key access_token auth bearer credential".split())
PHONE_WORDS = frozenset("tel tel. phone call fax mobile cell telefon teléfono téléphone".split())
COUNT_WORDS = frozenset("version v release section page chapter no nr figure table by-nc by-sa by gpl cc in year isbn order".split())
GROUPS = re.compile(r"[0-9]+")
MAIL = re.compile(r"[^@\s]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Names of the span features, in the order of ``features``.
N_FEATURES = 40


def features(span: str, tokens: int, before: str, mark: str) -> np.ndarray:
    """Features of a whole span; ``before``: the word before it, ``mark``: the last character before it."""
    x = np.zeros(N_FEATURES)
    digits = only_digits(span)
    n, letters = len(digits), sum(c.isalpha() for c in span)
    x[0] = 1
    x[tokens] = 1  # 1 to 5
    x[6 + (0 if n < 4 else 1 if n < 7 else 2 if n < 8 else 3 if n < 10 else 4 if n < 13 else 5 if n < 16 else 6 if n < 20 else 7)] = 1
    x[14] = letters == 0
    x[15] = 0 < letters < 6
    x[16] = letters > 5
    x[17] = "@" in span
    x[18] = MAIL.fullmatch(span) is not None
    groups = GROUPS.findall(span)
    dotted = span.count(".") == 3 and len(groups) == 4 and n + 3 == len(span)
    x[19] = dotted and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    x[20] = dotted and not x[19]
    x[21] = span[:1] == "+"
    x[22] = "(" in span and ")" in span
    x[23] = "-" in span
    x[24] = n == len(span)
    x[25] = 13 <= n <= 19 and letters == 0 and luhn(digits)
    x[26] = 13 <= n <= 19 and letters == 0 and not x[25]
    sizes = [len(g) for g in groups]
    x[27] = letters == 0 and sizes[-3:] == [3, 3, 4]
    x[28] = sizes in ([4, 4, 4, 4], [4, 6, 5], [16])
    plain = span.strip(EDGE)
    x[29] = len(plain) >= 16 and letters > 0 and n > 0 and all(c in HEX for c in plain)
    x[30] = len(plain) >= 16 and letters > 2 and n > 2 and plain.replace("_", "").replace("-", "").isalnum()
    x[31] = mark in "=:"
    x[32] = before in SECRET_WORDS
    x[33] = before in PHONE_WORDS
    x[34] = before in COUNT_WORDS
    x[35] = n == 4 and len(span) == 4
    x[36] = len(groups) == 2 and "." in span and n + 1 == len(span)
    x[37] = len(set(plain)) >= 10 and tokens == 1
    x[38] = "/" in span or ":" in span
    x[39] = "." in span and not dotted
    return x


class Run:
    """Starts and ends of neighbouring tokens, 16 bytes each."""

    def __init__(self, a: int | None = None, b: int | None = None):
        self.starts, self.ends = array("q"), array("q")
        if a is not None:
            self.append((a, b))

    def append(self, token: tuple[int, int]) -> None:
        self.starts.append(token[0])
        self.ends.append(token[1])

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, k: int) -> tuple[int, int]:
        return self.starts[k], self.ends[k]


def runs(text: str) -> Iterator[tuple[Run, str]]:
    """Runs of neighbouring tokens on one line that each hold a digit or '@', and the text before.

    A token ends at white space or '='.
    """
    run = Run()
    at = 0
    while m := ANY.search(text, at):
        a, b = m.start(), m.end()
        while a > at and not text[a - 1].isspace() and text[a - 1] != "=":
            a -= 1
        while b < len(text) and not text[b].isspace() and text[b] != "=":
            b += 1
        if run and text[run[-1][1] : a].strip(" ") == "":
            run.append((a, b))
        else:
            if run:
                yield run, text[max(0, run[0][0] - 40) : run[0][0]]
            run = Run(a, b)
        at = b
    if run:
        yield run, text[max(0, run[0][0] - 40) : run[0][0]]


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in EDGE:
        a += 1
    while b > a and text[b - 1] in EDGE:
        b -= 1
    return a, b


def lead(text: str, run: Run, i: int, left: str) -> tuple[str, str]:
    """(the word, the last character) before token ``i``."""
    before = text[max(0, run[i][0] - 40) : run[i][0]] if i else left
    ahead = before.rstrip(" \"'")
    words = ahead.rstrip("=: ").split()
    return words[-1].strip(EDGE + "()").lower() if words else "", ahead[-1:] or " "


def segments(text: str, run: Run, left: str) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """Candidates (first token, one past the last, start, end) of a run, and a row of features each."""
    out, rows = [], []
    for i in range(len(run)):
        word, mark = lead(text, run, i, left)
        for j in range(i + 1, min(len(run), i + LONGEST) + 1):
            a, b = trimmed(text, run[i][0], run[j - 1][1])
            if a < b:
                out.append((i, j, a, b))
                rows.append(features(text[a:b], j - i, word, mark))
    return out, np.array(rows) if rows else np.zeros((0, N_FEATURES))


Segment = tuple[int, int, int, int]
Weights = tuple[np.ndarray, np.ndarray]  # (types x features, types and other x types and other)


def forward(size: int, found: list[Segment], scores: np.ndarray, trans: np.ndarray, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, enter): by position and type the log mass (or best score) of what ends there, and of what a segment may follow."""
    fold = np.maximum if best else np.logaddexp
    other = len(trans) - 1
    ends: list[list[int]] = [[] for _ in range(size + 1)]
    for k, f in enumerate(found):
        ends[f[1]].append(k)
    alpha, enter = np.full((size + 1, other + 1), -np.inf), np.full((size + 1, other + 1), -np.inf)
    alpha[0, other] = 0.0
    for j in range(size + 1):
        if j:
            alpha[j, other] = enter[j - 1, other]
            for k in ends[j]:
                alpha[j, :other] = fold(alpha[j, :other], scores[k] + enter[found[k][0], :other])
        enter[j] = fold.reduce(alpha[j][:, None] + trans, axis=0)
    return alpha, enter


def expected(size: int, found: list[Segment], scores: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log partition function, posterior of each segment and type, expected number of each pair of neighbouring types)."""
    other = len(trans) - 1
    alpha, enter = forward(size, found, scores, trans)
    total = float(np.logaddexp.reduce(alpha[size]))
    begins: list[list[int]] = [[] for _ in range(size + 1)]
    for k, f in enumerate(found):
        begins[f[0]].append(k)
    beta = np.zeros((size + 1, other + 1))
    pairs = np.zeros_like(trans)
    for i in range(size - 1, -1, -1):
        start = np.full(other + 1, -np.inf)  # what a segment of each type that begins here may lead to
        start[other] = beta[i + 1, other]
        for k in begins[i]:
            start[:other] = np.logaddexp(start[:other], scores[k] + beta[found[k][1], :other])
        beta[i] = np.logaddexp.reduce(trans + start, axis=1)
        pairs += np.exp(alpha[i][:, None] + trans + start - total)
    posterior = np.array([np.exp(scores[k] + enter[i, :other] + beta[j, :other] - total) for k, (i, j, *_) in enumerate(found)])
    return total, posterior.reshape(len(found), other), pairs


def decode(size: int, found: list[Segment], scores: np.ndarray, trans: np.ndarray) -> list[tuple[int, int]]:
    """(segment, type) of the best segmentation."""
    other = len(trans) - 1
    alpha, enter = forward(size, found, scores, trans, best=True)
    ends: list[list[int]] = [[] for _ in range(size + 1)]
    for k, f in enumerate(found):
        ends[f[1]].append(k)

    def top(values: np.ndarray) -> int:  # "other" wins ties, then the first type
        first = int(values.argmax())
        return other if values[other] >= values[first] - 1e-12 else first

    out, j, kind = [], size, top(alpha[size])
    while j:
        at = j - 1
        if kind != other:
            k = next(k for k in ends[j] if scores[k, kind] + enter[found[k][0], kind] == alpha[j, kind])
            out.append((k, kind))
            at = found[k][0]
        j, kind = at, top(alpha[at] + trans[:, kind])
    return out[::-1]


def entity(rng: random.Random, kind: str) -> tuple[str, str]:
    """(what leads to it, a made entity of some form, or a number that is none)."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        return "", f"{word()}{rng.choice(['', '.', '_'])}{rng.choice(['', d(2), word()])}@{word()}{rng.choice(['', d(1)])}.{rng.choice(['com', 'org', 'example.com', 'de'])}"
    if kind == "ip":
        return "", ".".join(str(rng.randint(0, 255)) for _ in range(4))
    head = d(15)
    if kind == "card":
        s = next(head + c for c in "0123456789" if luhn(head + c))
        return "", rng.choice(" -").join(s[k : k + 4] for k in range(0, 16, 4)) if rng.random() < 0.5 else s
    if kind == "phone":
        s = rng.choice(["+{c} ({a}) {b}-{e}", "+{c} {a} {b} {e}", "+{c}-{a}-{b}-{e}", "({a}) {b}-{e}", "{a}-{b}-{e}"]).format(c=rng.randint(1, 99), a=d(3), b=d(3), e=d(4))
        return "" if s[0] == "+" else rng.choice(["phone ", "tel. ", "call ", "phone: "]), s
    if kind == "secret":
        s = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 40, 64])))
        if rng.random() < 0.3:
            s = "".join(rng.choice("0123456789" + letters + letters.upper()) for _ in range(rng.choice([24, 36, 40])))
        return rng.choice(["token = ", "key: ", "api_key=", "secret = ", "password: "]) + rng.choice(['"', ""]) if rng.random() < 0.8 else "", s
    s = rng.choice([
        str(rng.randint(1900, 2030)), d(1) + "." + d(1), d(1) + ".", d(2), d(3), d(4), d(5), d(6), d(8), d(7), d(10), d(12),
        next(head + c for c in "0123456789" if not luhn(head + c)), word() + d(1), word() + d(2), word() + d(4), f"{d(2)}:{d(2)}", f"{d(2)}/{d(2)}/{d(4)}",
        f"{d(4)}-{d(2)}-{d(2)}", f"${d(3)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(3)}-{d(4)}", f"{d(1)}-{d(2)}", f"@{word()}", f"{d(2)} {d(2)}", f"{d(3)} {d(3)} {d(4)}", f"{d(4)} {d(4)} {d(4)}",
        f"{word()}-{d(3)}-{word()}", f"http://{word()}.com/{d(5)}", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}9",
    ])
    return rng.choice(["version ", "page ", "no ", "in ", "section "]) if rng.random() < 0.3 else "", s


def templates(rng: random.Random) -> tuple[str, list[Span]]:
    """One line of made-up words around one to three entities, side by side, or around a number that is none."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    kinds = [rng.choice([*KINDS, "none", "none", "none"])]
    while kinds[0] != "none" and len(kinds) < 3 and rng.random() < 0.25:
        kinds.append(rng.choice([kinds[0], "email", "ip", "card", "none"]))
    line, spans = " ".join(word() for _ in range(rng.randint(1, 4))) + " ", []
    for n, kind in enumerate(kinds):
        lead, s = entity(rng, kind)
        line += "" if n else lead
        spans += [(kind, len(line), len(line) + len(s))] if kind != "none" else []
        line += s + (" " if n < len(kinds) - 1 else "")
    return line + rng.choice(["", ".", ",", '"', "!!", "***", ""]) + " " + word(), spans


def observed(size: int, found: list[Segment], want: np.ndarray) -> np.ndarray:
    """How often each pair of types is neighbours in the segmentation that ``want`` marks."""
    other = want.shape[1]
    pairs, last, at = np.zeros((other + 1, other + 1)), other, 0
    chosen = {found[k][0]: (found[k][1], int(kind)) for k, kind in zip(*np.nonzero(want), strict=True)}
    while at < size:
        at, kind = chosen.get(at, (at + 1, other))
        pairs[last, kind] += 1
        last = kind
    return pairs


@functools.lru_cache(maxsize=2)
def trained(samples: int = SAMPLES, seed: int = SEED, rounds: int = 25, rate: float = 0.5, decay: float = 1e-4) -> Weights:
    """Weights by stochastic ascent of the conditional likelihood."""
    rng = random.Random(seed)
    cases = []
    for _ in range(samples):
        text, gold = templates(rng)
        for run, left in runs(text):
            found, rows = segments(text, run, left)
            want = np.zeros((len(found), len(KINDS)))
            for k, (_, _, a, b) in enumerate(found):
                for kind, c, e in gold:
                    if (a, b) == trimmed(text, c, e):
                        want[k, KINDS.index(kind)] = 1
            if found:
                cases.append((len(run), found, rows, want, observed(len(run), found, want)))
    w, trans = np.zeros((len(KINDS), N_FEATURES)), np.zeros((len(KINDS) + 1, len(KINDS) + 1))
    for r in range(rounds):
        rng.shuffle(cases)
        for k in range(0, len(cases), 20):
            step, turn = np.zeros_like(w), np.zeros_like(trans)
            for size, found, rows, want, seen in cases[k : k + 20]:
                _, posterior, pairs = expected(size, found, rows @ w.T, trans)
                step += (want - posterior).T @ rows
                turn += seen - pairs
            pace = rate / (1 + 0.2 * r)
            w += pace * (step / 20 - decay * w)
            trans += pace * (turn / 20 - decay * trans)
    return w, trans


class Field:
    """The trained weights, and the scores of the spans seen last."""

    def __init__(self, weights: Weights, memo: int = 1 << 14):
        self.w, self.trans = weights
        self.memo, self.limit = {}, memo

    def scores(self, span: str, tokens: int, word: str, mark: str) -> np.ndarray:
        key = span, tokens, word, mark
        if (found := self.memo.get(key)) is None:
            found = self.w @ features(*key)
            if len(self.memo) >= self.limit:
                self.memo.clear()
            if len(span) <= 200:
                self.memo[key] = found
        return found

    def spans(self, text: str) -> list[Span]:
        """The best segmentation of every run.

        The dynamic program looks back ``LONGEST`` tokens, so only so many of its rows are held; of the rest of a run there are
        two bytes for each token and type: how many tokens the best segment that ends there has, and the type before it.
        """
        out = []
        for run, left in runs(text):
            out += self._best(text, run, left)
        return out

    def _best(self, text: str, run: Run, left: str) -> list[Span]:
        size, other = len(run), len(self.trans) - 1
        taken, before = np.zeros((size + 1, other + 1), np.int8), np.zeros((size + 1, other + 1), np.int8)
        none = np.full(other + 1, -np.inf)
        alpha = none.copy()
        alpha[other] = 0.0
        enter = {0: self._enter(alpha, before[0])}
        leads: dict[int, tuple[str, str]] = {}
        for j in range(1, size + 1):
            leads[j - 1] = lead(text, run, j - 1, left)
            alpha = none.copy()
            for i in range(max(0, j - LONGEST), j):
                a, b = trimmed(text, run[i][0], run[j - 1][1])
                if a < b:
                    got = self.scores(text[a:b], j - i, *leads[i]) + enter[i][:other]
                    better = got > alpha[:other]
                    alpha[:other][better] = got[better]
                    taken[j, :other][better] = j - i
            alpha[other], taken[j, other] = enter[j - 1][other], 1
            enter[j] = self._enter(alpha, before[j])
            enter.pop(j - LONGEST, None)
            leads.pop(j - LONGEST, None)
        out, j, kind = [], size, self._top(alpha)
        while j:
            at = j - int(taken[j, kind])
            if kind != other:
                out.append((KINDS[kind], *trimmed(text, run[at][0], run[j - 1][1])))
            j, kind = at, int(before[at, kind])
        return out[::-1]

    def _enter(self, alpha: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The best score that a segment of each type may follow; ``before`` gets the types that have it."""
        both = alpha[:, None] + self.trans
        best = both.max(0)
        # "other" wins ties, then the first type
        before[:] = np.where(both[-1] >= best - 1e-12, len(alpha) - 1, both.argmax(0))
        return best

    def _top(self, alpha: np.ndarray) -> int:
        first = int(alpha.argmax())
        return len(alpha) - 1 if alpha[-1] >= alpha[first] - 1e-12 else first


def field_spans(text: str, weights: Weights | Field) -> list[Span]:
    return (weights if isinstance(weights, Field) else Field(weights)).spans(text)


def all_spans(text: str, w: Weights | Field) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), both by kind and start."""
    if not ANY.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more, k = [], 0
    for kind, a, b in sorted(field_spans(text, w), key=lambda s: s[1]):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        # base spans of several kinds may overlap, so look at all that begin before b
        if not any(x < b and a < y for x, y in taken[max(0, k - 3) : k + 4]):
            more.append((kind, a, b))
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def text_of(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping ones together."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Field(shared.value)
        for b in slices(batches, "text"):
            rows = []
            for t in b.column("text").to_pylist():
                base, every = all_spans(t.decode("utf-8", "replace"), w)
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(every), len(every) - len(base)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(lean(run), SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, the text masked (a null text stays null)."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    rows = plain(docs)
    names, text = rows.columns, rows.columns[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Field(shared.value)
        for b in slices(batches, text):
            texts = [None if t is None else t.decode("utf-8", "replace") for t in b.column(text).to_pylist()]
            cols = b.columns
            cols[names.index(text)] = pa.array([None if t is None else masked(t, all_spans(t, w)[1]) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.withColumn(text, F.col(text).cast("binary")).mapInArrow(lean(run), rows.schema).toDF(*docs.columns)
