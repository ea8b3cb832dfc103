"""Secrets by multipart credential linking.

Method: three kinds of base spans (assigned values, access identifiers, long hex runs) always stay.
Beside them, generators propose weak parts of credentials: identifiers (a value under a name such as
user or client_id), secrets (a value under a name such as key or pwd, or a long token of mixed
characters), and endpoints (a URL, or a value under a name such as host). Base access identifiers
count as identifiers, other base spans as secrets. Parts are interval-joined within scopes: a part
reaches REACH characters to either side, but not beyond its scope, the text between two blank lines.
A weak part is reported only where what completes it is within its reach:

* a named secret with an identifier, or, if it has letters and digits, eight at least, with an endpoint;
* a bare token with an identifier;
* an identifier with a secret; an endpoint with a secret and an identifier.

A part's partners are found by binary search for the nearest of each role to either side, so that a
text with many parts never makes pairs. A text is one row and is searched whole by the task that
reads it: nothing is shuffled.

Added kinds, in the order of ties: ident, weak, endpoint; their spans are the values alone. A part by
name that overlaps a base span or one before it is none, nor is a token that overlaps either.

Defined results: null and empty texts have no spans; null ids pass through; repeated rows get a row
each; an empty table gives none; other columns are never read but by ``redact_documents``, which
keeps them all and leaves null texts null.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

#: Kinds in the order of ties; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
BASE = KINDS[:3]
#: Characters to either side in which a part finds its partners.
REACH = 400
#: Least characters of a named secret, of a bare token, and least bits a character of a bare token.
NAMED_LENGTH, TOKEN_LENGTH, TOKEN_BITS = 6, 20, 3.5
MARK = "[secret]"

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
_HEX = re.compile("[0-9a-f]{32,}")

_SIGN = re.compile("[:=]")
_NAME = re.compile(r"([A-Za-z][A-Za-z0-9_.-]{0,62})[\"']?[ \t]{0,3}$")
_VALUE = re.compile(r"[ \t]{0,3}[\"']?([^\s\"',;]+)")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}$")
_REST = re.compile(r"://[^\s\"'<>]+")
_TOKEN = re.compile(f"[A-Za-z0-9+/_=-]{{{TOKEN_LENGTH},}}")
_BLANK = re.compile(r"\n[ \t\r]*\n")
#: Endings of names by role; an identifier's are tried first, so that key_id is no key.
_ROLES = (
    ("ident", re.compile(r"(?:user|user_?name|login|account|acct|(?:client|key|access|tenant|account|user)[_.-]?id)$", re.IGNORECASE | re.ASCII)),
    ("weak", re.compile(r"(?:key|pass|passphrase|pwd|pin|auth|creds?|credentials?|signature)$", re.IGNORECASE | re.ASCII)),
    ("endpoint", re.compile(r"(?:host|hostname|server|endpoint|url|uri|dsn)$", re.IGNORECASE | re.ASCII)),
)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    low, found = text.lower(), []
    if any(w in low for w in _ASSIGN_WORDS):
        found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _mixed(token: str) -> bool:
    """Whether a token has capitals, small letters and digits, spread as in a random one."""
    if not (re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= TOKEN_BITS


def _telling(value: str) -> bool:
    """Whether a named secret's value may stand beside an endpoint alone."""
    return len(value) >= 8 and bool(re.search("[A-Za-z]", value) and re.search("[0-9]", value))


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of the spans, by start, that overlap neither a taken one nor one before them."""
    taken = sorted(taken)
    starts, furthest, out = [s for s, _, _ in taken], [0], []
    for _, e, _ in taken:
        furthest.append(max(furthest[-1], e))
    for s in sorted(set(spans), key=_order):
        if furthest[bisect_left(starts, s[1])] <= s[0] and (not out or out[-1][1] <= s[0]):
            out.append(s)
    return out


def weak_parts(text: str) -> list[Span]:
    """Parts by names and URLs."""
    parts = []
    for sign in _SIGN.finditer(text):
        at = sign.start()
        if text.startswith("://", at):
            scheme, rest = _SCHEME.search(text, max(0, at - 16), at), _REST.match(text, at)
            if scheme and rest:
                parts.append((scheme.start(), rest.end(), "endpoint"))
            continue
        name = _NAME.search(text, max(0, at - 67), at)
        role = name and next((r for r, p in _ROLES if p.search(name[1])), None)
        value = role and _VALUE.match(text, sign.end())
        if value and (role != "weak" or value.end(1) - value.start(1) >= NAMED_LENGTH):
            parts.append((*value.span(1), role))
    return parts


def bare_tokens(text: str) -> list[Span]:
    return [(m.start(), m.end(), "weak") for m in _TOKEN.finditer(text) if _mixed(m[0])]


class _Near:
    """Whether a part has one of these, which never overlap it, within its reach and scope."""

    def __init__(self, spans: list[Span], ends: list[int]):
        self.starts, self.ends = sorted(s for s, _, _ in spans), ends

    def __call__(self, span: Span) -> bool:
        scope = bisect_right(self.ends, span[0])
        low = max(span[0] - REACH, self.ends[scope - 1] if scope else 0)
        high = min(span[1] + REACH, self.ends[scope] if scope < len(self.ends) else span[1] + REACH)
        k = bisect_left(self.starts, high)
        return k > 0 and self.starts[k - 1] >= low


def linked(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that their complements join within reach and scope; they overlap neither each other nor base spans."""
    named = _apart(weak_parts(text), base)
    known = [s for s in named if s[2] == "ident"] + [s for s in base if s[2] == "access"]
    if not named and not known:
        return []
    tokens = _apart(bare_tokens(text), base + named) if known else []
    ends = [m.end() for m in _BLANK.finditer(text)]
    secrets = [s for s in named if s[2] == "weak"] + tokens + [s for s in base if s[2] != "access"]
    ident, endpoint, secret = _Near(known, ends), _Near([s for s in named if s[2] == "endpoint"], ends), _Near(secrets, ends)
    kept = [s for s in tokens if ident(s)]
    for s in named:
        if s[2] == "weak" and (ident(s) or _telling(text[s[0] : s[1]]) and endpoint(s)) or s[2] == "ident" and secret(s) or s[2] == "endpoint" and secret(s) and ident(s):
            kept.append(s)
    return kept


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all of them with the linked weak parts."""
    base = base_spans(text)
    return base, sorted(base + linked(text, base), key=_order)


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (kind:start:end, comma-joined) and n_linked, by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [spans_of(t) for t in texts_of(batch)]
            counts = [[sum(k == kind for _, _, k in base) for base, _ in found] for kind in BASE]
            said = [_said(base).encode() for base, _ in found]
            columns = [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(b).hexdigest() for b in said]), pa.array([_said(s) for _, s in found], pa.string()), pa.array([len(s) - len(b) for b, s in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every span of a secret replaced by MARK, overlapping spans as one; endpoints and identifiers stay."""

    def clean(text: str) -> str:
        out, at = [], 0
        for s, e, kind in spans_of(text)[1]:
            if kind in ("ident", "endpoint") or e <= at:
                continue
            if s >= at:
                out += [text[at:s], MARK]
            at = e
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            k = batch.schema.get_field_index("text")
            texts = [None if t is None else clean(t) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
