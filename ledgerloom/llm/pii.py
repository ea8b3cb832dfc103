"""Personal data by candidate generation and gradient boosting.

Method: high-recall generators propose spans that may overlap: the four base kinds, and values
after an assignment, key-like tokens, national account and identity numbers and local telephone
numbers. Boosted trees score each candidate of an added kind from its format and its context. For
each of these kinds the threshold is calibrated on a held-out part of the training candidates: the
least score from which on PRECISION of them are right. Base spans always stay; of added spans all
that are selected count, those that overlap as one span of the best one's kind.

A value after an assignment reaches to its closing quote on the line, or else to white space or a quote.

Training needs no labels from outside and no rows: a fixed number of texts is made by rule (PLANTED a
rule), with values of each kind on the one hand, most of them where no validator confirms them, and
ordinary values on the other: dates, times, versions, paths, file names, numbers of orders and books, and
the like, under the same names and between the same sorts of words. Each candidate of an added kind in such
a text is right if it lies in a value made as one, and wrong elsewhere. Three quarters train; on the last
quarter each kind's threshold is the least score from which on PRECISION of the candidates are right. A kind
with fewer than LEAST_EXAMPLES right or wrong ones there has the threshold UNCALIBRATED. So every table, of
any size, gets the same detector, and a text the same spans. Spans that a validator confirms are always
taken; the trees decide on all others.

Defined results: null and empty texts have no spans; null ids pass through; repeated rows get a
row each; a detector without examples finds base spans and confirmed ones; ``redact_documents`` keeps all columns and a null text stays null.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import BoostedTrees
from .common import slices, texts_of

#: Kinds in the order of ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "key", "iban", "ssn", "tel")
BASE, ADDED = KINDS[:4], KINDS[4:]
#: Made-up texts of each rule.
PLANTED = 240
PRECISION = 0.97
LEAST_SCORE = 0.9
LEAST_EXAMPLES = 20
UNCALIBRATED = 0.999

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*\.[0-9.]*[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ASSIGNS = re.compile("[=:]")
_ASSIGNED = re.compile(r"[=:][ \t]{0,3}(?:\"((?:[^\"\\\r\n]|\\.){6,}+)\"|'((?:[^'\\\r\n]|\\.){6,}+)'|[\"']?([^\s\"']{6,}))")
_SECRET_NAME = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|token|secret|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth)[\"']?[ \t]{0,3}$")
_TOKEN = re.compile(r"[A-Za-z0-9_+/-]+")
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")
_KNOWN_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9-])")
_HINTS = tuple(re.compile(p) for p in (r"(?i)\b(?:tel|phone|call|fax|mobile|cell)\b", r"(?i)\b(?:ssn|social security)\b", r"(?i)\b(?:iban|account|konto|bank)\b", r"(?i)\b(?:card|visa|credit)\b"))
#: Nouns before a number or code of no one's.
_ORDINARY = re.compile(r"(?i)\b(?:order|ref(?:erence)?|no|nr|number|part|item|serial|model|sku|isbn|issn|invoice|ticket|case|version|build|date|time|page|size|id|commit|file|path|room|batch|lot)\b[^A-Za-z0-9]{0,3}$")
_DIGIT = re.compile("[0-9]")
_RUNS = re.compile("[A-Za-z]+|[0-9]+")
_CASES = re.compile("[A-Z]+|[a-z]+")
_ALNUM = re.compile("[A-Za-z0-9]+")
_WORDLIKE = re.compile("(?i)^[a-z]*[aeiouy][a-z]*$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches; an address holds one @, so each @ is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = at
        at = text.find("@", max(at + 1, free))


def dotted_quads(text: str) -> Iterator[tuple[int, int, bool]]:
    """Leftmost non-overlapping runs of four digit groups, and whether every part is at most 255."""
    for m in _DOTTED.finditer(text):
        at, row = m.start(), []
        for part in m.group().split("."):
            if part:
                row.append((at, part))
                if len(row) == 4:
                    yield row[0][0], at + len(part), all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for _, q in row)
                    row = []
            else:
                row = []
            at += len(part) + 1


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Kind, start, end and whether it is valid, of every match of the base patterns."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end, True
    if _DIGIT.search(text):
        for start, end, fine in dotted_quads(text):
            yield "ip", start, end, fine
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            yield "card", m.start(), m.end(), 14 <= len(digits) <= 19 and luhn(digits)
        if "+" in text:
            for m in _PHONE.finditer(text):
                yield "phone", m.start(), m.end(), 10 <= sum(map(str.isdigit, m.group())) <= 15


def _iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def assignments(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start and end of the values after = or :, and whether a telling name stands before. Of either sort, named or not, none begins inside another."""
    free = [0, 0]
    for sign in _ASSIGNS.finditer(text):
        at = sign.start()
        if at < min(free):
            continue
        named = bool(_SECRET_NAME.search(text, max(0, at - 24), at))
        if at >= free[named] and (m := _ASSIGNED.match(text, at)):
            yield *m.span(m.lastindex), named
            free[named] = m.end()


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """Kind, start, end and what strict validators say (1 or 0), of every candidate. Spans may overlap."""
    out = [(kind, start, end, 1) for kind, start, end, fine in base_matches(text) if fine]
    if "=" in text or ":" in text:
        for start, end, named in assignments(text):
            if named or _DIGIT.search(text, start, end):
                out.append(("secret", start, end, int(named and end - start >= 8)))
    if _DIGIT.search(text):
        done = 0
        for m in _DIGIT.finditer(text):
            if m.start() < done:
                continue
            start = m.start()
            while start > done and text[start - 1] in _TOKEN_CHARS:
                start -= 1
            done = _TOKEN.match(text, start).end()
            token = text[start:done]
            if len(token) >= 12 and any(map(str.isalpha, token)):
                out.append(("key", start, done, int(bool(_KNOWN_KEY.fullmatch(token)) or (len(token) >= 32 and entropy(token) >= 3 and random_like(token)))))
        for kind, pattern in (("iban", _IBAN), ("ssn", _SSN), ("tel", _TEL)):
            for m in pattern.finditer(text):
                before = text[max(0, m.start() - 40) : m.start()]
                fine = _iban_valid(m.group()) if kind == "iban" else bool(_HINTS[1].search(before)) if kind == "ssn" else bool(_HINTS[0].search(before))
                out.append((kind, m.start(), m.end(), int(fine)))
    return out


def added_candidates(text: str) -> list[tuple[str, int, int, int]]:
    """Those of an added kind that lie in no base span."""
    found = candidates(text)
    base = [c for c in found if c[0] in BASE]
    return [c for c in found if c[0] in ADDED and not any(a <= c[1] and c[2] <= b for _, a, b, _ in base)]


def random_like(token: str) -> bool:
    """Whether letters and digits alternate within one long run, as in no slug, path or numbered identifier."""
    return any(len(run) >= 20 and len(_RUNS.findall(run)) >= 5 for run in _ALNUM.findall(token))


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    own, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    n, digits = end - start, sum(map(str.isdigit, own))
    return [
        *(float(kind == k) for k in ADDED),
        n,
        digits,
        digits / n,
        sum(map(str.isupper, own)) / n,
        sum(map(str.islower, own)) / n,
        sum(c in "0123456789abcdefABCDEF" for c in own) / n,
        sum(not c.isalnum() for c in own),
        own.count("."),
        own.count("-") + own.count(" "),
        entropy(own),
        float(14 <= digits <= 19 and luhn("".join(c for c in own if "0" <= c <= "9"))),
        float(bool(_KNOWN_KEY.fullmatch(own))),
        float(bool(_SECRET_NAME.search(before.rstrip("\"' \t").rstrip("=:")))),
        float(before.rstrip("\"' \t")[-1:] in ("=", ":") and before != ""),
        *(float(bool(h.search(before))) for h in _HINTS),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float("@" in own),
        *_shape(own),
        float(bool(_ORDINARY.search(before.rstrip("\"' \t")))),
        float(own.lstrip("(")[:1] in ("0", "1")),
    ]


def _shape(own: str) -> tuple[float, ...]:
    """How letters and digits alternate, how long their runs are, and how much of them reads like words."""
    runs, parts = _RUNS.findall(own), _ALNUM.findall(own)
    letters = [r for r in runs if r[0].isalpha()]
    some = lambda group: float(max(map(len, group), default=0))
    words = sum(len(r) for r in letters if len(r) >= 3 and _WORDLIKE.match(r) and (r.islower() or r.isupper() or r.istitle()))
    mixed = sum(len(p) for p in parts if len(_RUNS.findall(p)) >= 3)
    return float(len(runs)), float(len(_CASES.findall(own))), some(letters), some([r for r in runs if r[0].isdigit()]), some(parts), words / len(own), mixed / len(own), float(own.count("/")), float(own.count(":")), float(own.count("_"))


def united(spans: list[tuple[int, int, float, str]]) -> Iterator[tuple[int, str, int]]:
    """Spans (start, end, score, kind) that overlap become one, of the kind with the best score."""
    held: list = []
    for start, end, score, kind in sorted(spans):
        if held and start < held[1]:
            best = max((held[2], held[3]), (score, kind))
            held = [held[0], max(held[1], end), *best]
        else:
            if held:
                yield held[0], held[3], held[1]
            held = [start, end, score, kind]
    if held:
        yield held[0], held[3], held[1]


def _planted_value(kind: str, r: random.Random) -> str:
    """A made-up value of an added kind."""
    letters, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda of, n: "".join(r.choices(of, k=n))
    if kind == "secret":
        return r.choice((lambda: some(letters + digits, r.randint(10, 28)), lambda: some("0123456789abcdef", r.randint(16, 64)), lambda: some(letters + digits + "!#$%&*+-_", r.randint(10, 20))))() + r.choice(digits)
    if kind == "key":
        return r.choice((lambda: some("0123456789abcdef", r.choice((32, 40, 64))), lambda: some(letters + digits + "-_", r.randint(32, 64)) + "1a", lambda: r.choice(("ghp_", "sk-", "pk_")) + some(letters + digits, 36)))()
    if kind == "iban":
        country, rest = some(letters[26:], 2), some(digits, r.randint(12, 26))
        return f"{country}{98 - int(rest + ''.join(str(int(c, 36)) for c in country) + '00') % 97:02d}{rest}"
    if kind == "ssn":
        return f"{r.randint(1, 899):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
    return r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(r.randint(200, 999), r.randint(200, 999), f"{r.randint(0, 9999):04d}")


def _ordinary_value(r: random.Random) -> tuple[str, str]:
    """A name that may stand before it, and a made-up value that is no one's secret."""
    d = lambda n: "".join(r.choices("0123456789", k=n))
    word = lambda: r.choice(_SYLLABLES) + r.choice(_SYLLABLES) + r.choice(("", r.choice(_SYLLABLES)))
    date = f"{r.randint(1950, 2040)}{(s := r.choice('-/.'))}{r.randint(1, 12):02d}{s}{r.randint(1, 28):02d}"
    clock = f"{r.randint(0, 23):02d}:{d(2)}" + r.choice(("", f":{d(2)}", f":{d(2)}.{d(3)}", f":{d(2)}Z"))
    version = f"{r.randint(0, 30)}.{r.randint(0, 99)}.{r.randint(0, 999)}" + r.choice(("", f"-beta{r.randint(1, 9)}", f"-rc.{r.randint(1, 9)}", f"+build{d(3)}", f".dev{d(4)}"))
    slug = "-".join([r.choice((word(), word(), f"{word()[:3]}{d(1)}", d(2))) for _ in range(r.randint(2, 7))])
    file = r.choice("_-").join([word(), r.choice((d(4), word(), f"v{d(1)}")), r.choice((d(2), word()))]) + "." + r.choice(("pdf", "csv", "tar.gz", "jpeg", "mp4", "py"))
    path = "/" * r.randint(0, 1) + "/".join(r.choice((word(), f"{word()}{d(1)}", d(4), slug)) for _ in range(r.randint(2, 6)))
    grouped = r.choice(("-", " ", ".", "/", "")).join(d(r.randint(1, 5)) for _ in range(r.randint(2, 4)))
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    return r.choice(
        (
            ("date", date), ("on", date + r.choice("T ") + clock), ("time", clock), ("ratio", f"{r.choice(('', '-'))}{r.randint(0, 999)}.{d(r.randint(1, 9))}"), ("version", version), ("release", f"v{version}"), ("path", path), ("url", f"https://{word()}.example/{path.lstrip('/')}" + r.choice(("", f"?id={d(5)}", f"?page={d(2)}&sort={word()}"))),
            ("file", file), ("file", f"{path}/{file}"), ("isbn", f"97{r.choice('89')}-{d(1)}-{d(2)}-{d(6)}-{d(1)}"), ("isbn", f"{d(1)}-{d(3)}-{d(5)}-{r.choice((d(1), 'X'))}"), ("item", slug), ("order", grouped), ("order", d(r.randint(4, 13))), ("no", f"{word()[:2].upper()}-{d(5)}-{d(2)}"), ("size", f"{d(4)}x{d(3)}"), ("price", f"${d(1)},{d(3)}.{d(2)}"),
            ("id", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}"), ("part", f"{d(3)}-{r.choice((d(3), d(2)))}-{d(4)}"), ("part", f"{r.choice('01')}{d(2)}-{d(3)}-{d(4)}"), ("ref", f"{word()[:2].upper()}{d(2)} {d(4)} {d(4)} {d(4)} {d(2)}"), ("score", f"{d(1)}:{d(1)}"), ("lat", f"{d(2)}.{d(6)},-{d(3)}.{d(5)}"), ("name", f"{word()}{d(r.randint(1, 4))}"), ("class", f"{word().title()}{word().title()}{d(1)}"), ("short", hexes(r.randint(5, 9))),
            ("item", d(3) + word() + word()), ("key", f"{word()}_{word()}_{d(2)}"), ("doi", f"10.{d(4)}/{word()}.{d(4)}.{d(5)}"), ("when", f"{d(2)} {word().title()} {d(4)}"), ("n", d(r.randint(6, 10))), ("mixed", f"{d(r.randint(3, 6))}{word()}{r.choice(('', d(2)))}"),
        )
    )


_SYLLABLES = "an be cor del en fi gra hol in ja ka lo mer ne on par que ra so ter un va wer yo zu tion ing ent ver".split()
#: Names that tell nothing, before either sort of value.
_NEUTRAL = "value v data field x param code entry zugang clave acceso wert setting config session sid input result".split()


@lru_cache(maxsize=1)
def examples() -> list[tuple[str, list[float], int]]:
    """Kind, features and whether it is right, of the candidates of all made-up texts that no validator confirms."""
    r, out = random.Random(2718), []
    words = lambda n: " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 3))) for _ in range(n))

    def add(name: str, value: str, assigned: bool, right: bool) -> None:
        quote = r.choice(("", "", '"', "'")) if assigned else ""
        sign = r.choice(("=", ": ", " = ", ":")) if assigned else " "
        before = f"{words(r.randint(0, 6))} {name}{sign}{quote}".lstrip()
        text = f"{before}{value}{quote}{r.choice((' ', '. ', ', ', chr(10)))}{words(r.randint(0, 6))}"
        start, end = len(before), len(before) + len(value)
        for kind, s, e, fine in added_candidates(text):
            if not fine:
                out.append((kind, features(text, kind, s, e), int(right and start <= s and e <= end and 2 * (e - s) >= end - start)))

    for kind in ADDED:
        for _ in range((12 if kind == "secret" else 4) * PLANTED):
            assigned = kind == "secret" or r.random() < 0.3
            add(r.choice((r.choice(_NEUTRAL), words(1))), _planted_value(kind, r), assigned, True)
    for _ in range(40 * PLANTED):
        name, value = _ordinary_value(r)
        add(r.choice((name, name, r.choice(_NEUTRAL), words(1))), value, r.random() < 0.5, False)
    return out


class Detector:
    """A fitted model: trees and a threshold a kind."""

    def __init__(self, x: np.ndarray, kinds: list[str], y: np.ndarray):
        self.trees, self.least = None, {}
        if len(y) < LEAST_EXAMPLES or len(set(y.tolist())) < 2:
            return
        held = np.arange(len(y)) % 4 == 3
        self.trees = BoostedTrees(trees=100, depth=4).fit(x[~held], y[~held])
        score = self.trees.predict(x[held])
        kinds = np.array(kinds)
        for kind in ADDED:
            own = kinds[held] == kind
            right, n = int(y[held][own].sum()), int(own.sum())
            if min(right, n - right) < LEAST_EXAMPLES:
                continue
            order = np.argsort(-score[own], kind="stable")
            s, true = score[own][order], y[held][own][order].cumsum()
            good = np.flatnonzero(true >= PRECISION * np.arange(1, n + 1))
            # Halfway to the next score, but LEAST_SCORE at least.
            if len(good):
                below = float(s[good[-1] + 1]) if good[-1] + 1 < n else 0.0
                self.least[kind] = max(LEAST_SCORE, (float(s[good[-1]]) + below) / 2)

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """start, kind and end of all spans: base spans, and the added ones that are selected."""
        found = candidates(text)
        out = [(start, kind, end) for kind, start, end, _ in found if kind in BASE]
        more = [c for c in found if c[0] in ADDED]
        if more:
            score = self.trees.predict(np.array([features(text, *c[:3]) for c in more])) if self.trees else np.zeros(len(more))
            # What a validator confirms is taken whatever the sample says, and names the span that it is united into.
            score = [1.0 if fine else s for s, (*_, fine) in zip(score.tolist(), more)]
            taken = [(start, end, s, kind) for s, (kind, start, end, _) in zip(score, more) if s >= self.least.get(kind, UNCALIBRATED)]
            base = [(start, end) for start, _, end in out]
            for start, kind, end in united(taken):
                if not any(a <= start and end <= b for a, b in base):
                    out.append((start, kind, end))
        return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


@lru_cache(maxsize=1)
def fit() -> Detector:
    """The detector of the made-up examples; always the same."""
    rows = examples()
    return Detector(np.array([x for _, x, _ in rows]), [kind for kind, _, _ in rows], np.array([y for *_, y in rows]))


def _named(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans (all spans)."""
    detector = detector or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [detector.spans(t) for t in texts_of(batch)]
            base = [[s for s in own if s[1] in BASE] for own in found]
            counts = [pa.array([sum(s[1] == kind for s in own) for own in base], pa.int64()) for kind in BASE]
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), *counts, pa.array([hashlib.sha256(_named(b).encode()).hexdigest() for b in base], pa.string()), pa.array(map(_named, found), pa.string())],
                names=["doc_id", *(f"n_{kind}" for kind in BASE), "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap are replaced as one, under the first's kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """docs with all spans of the texts replaced; all columns, n_chars following the text where there is one."""
    detector = detector or fit()
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            k = names.index("text")
            texts = [None if t is None else redacted(t, detector.spans(t)) for t in batch.column(k).to_pylist()]
            columns = batch.columns
            columns[k] = pa.array(texts, batch.schema.field(k).type)
            if "n_chars" in names:
                n = names.index("n_chars")
                columns[n] = pa.array([old if t is None else len(t) for t, old in zip(texts, columns[n].to_pylist())], batch.schema.field(n).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
