"""Secrets by fixed patterns, and weak candidates by linking the parts of a credential.

A credential has up to three parts: an identifier (who), a secret (what) and an endpoint (where). The
patterns find parts that stand for themselves (``assign``, ``access``, ``hex``): they are always reported.
Other parts are weak: a name given to ``user`` or ``client_id``, a value that looks random or is given to
``pwd``, a URL or a host. Weak parts are reported only where they complement others. Parts are intervals;
they are joined by interval with the scopes that hold them (blocks between blank lines) and with parts of
the other roles whose start is at most ``reach`` code points away in the same scope:

* ``secret``: a base identifier, or any identifier and an endpoint;
* ``identifier``: a base assignment, or any secret and an endpoint;
* ``endpoint``: an identifier and a secret.

The join needs only the nearest part of a role on either side, found by bisection in the sorted starts, so
it takes n log n steps for n parts and no pairs are listed. All patterns take linear time. A document is a
row: nothing is shuffled, memory holds the parts of one text, and a lost task reads its rows again.

A weak part that overlaps a base span or an earlier weak part is not a part. Null texts count as empty and
give zeros, the digest of the empty string and no spans; repeated rows get repeated results; ids may be
null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, only, strings

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "secret", "endpoint")
#: What a span of each kind is a part of.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# weak parts: a value after a name and one of : and =
_GIVEN = re.compile(r"""([A-Za-z_]{2,20})["']?\x20{0,8}[:=]\x20{0,8}["']?([A-Za-z0-9@+/_.=-]{3,})""")
_NAMES = {
    "identifier": {"user", "username", "login", "client_id", "clientid", "account", "access_key", "access_key_id", "accesskeyid", "key_id"},
    "secret": {"pwd", "pass", "passphrase", "credential", "credentials", "auth", "private_key", "signature"},
    "endpoint": {"host", "hostname", "endpoint", "server", "url", "bucket", "region", "database"},
}
_ROLE_OF = {name: role for role, names in _NAMES.items() for name in names}
_URL = re.compile(r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]+""")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
_BLANK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "=" in text or ":" in text:
        low = text.lower()
        if any(h in low for h in _ASSIGN_HINTS):
            out["assign"] = [m.span() for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out["access"] = [m.span() for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out["hex"] = [m.span() for m in _HEX.finditer(text)]
    return out


def looks_random(token: str, bits: float = 3.5) -> bool:
    """Lower case, upper case and digits, or hexadecimal with both, of at least ``bits`` a character
    (hexadecimal: 2.5)."""
    has = any(c.islower() for c in token), any(c.isupper() for c in token), any(c.isdigit() for c in token)
    if not (all(has) or (has[0] and has[2] and re.fullmatch("[0-9a-f]+", token))):
        return False
    n = len(token)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(token).values())
    return entropy >= (bits if all(has) else 2.5)


@dataclass(frozen=True, order=True)
class Part:
    start: int
    end: int
    kind: str

    @property
    def role(self) -> str:
        return ROLE[self.kind]


def weak_parts(text: str, base: dict[str, list[tuple[int, int]]]) -> list[Part]:
    """Weak parts in order, none overlapping a base span or another one."""
    found: list[Part] = []
    if "=" in text or ":" in text:
        for m in _GIVEN.finditer(text):
            role = _ROLE_OF.get(m[1].lower().lstrip("_"))
            if role:
                found.append(Part(*m.span(2), role))
        if "://" in text:
            found += [Part(*m.span(), "endpoint") for m in _URL.finditer(text)]
    if "AKIA" in text:
        found += [Part(*m.span(), "identifier") for m in _ACCESS.finditer(text) if 16 <= len(m[0]) < 20]
    if found or base["access"]:  # a random token means nothing without an identifier
        found += [Part(*m.span(), "secret") for m in _TOKEN.finditer(text) if looks_random(m[0])]
    taken = sorted(s for v in base.values() for s in v)
    covered: list[tuple[int, int]] = []
    for s, e in taken:
        if covered and s < covered[-1][1]:
            covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
        else:
            covered.append((s, e))
    starts = [s for s, _ in covered]
    out, done = [], 0
    for p in sorted(set(found)):
        i = bisect_left(starts, p.end) - 1  # the last base span that starts before the part ends
        if p.start >= done and (i < 0 or covered[i][1] <= p.start):
            out.append(p)
            done = p.end
    return out


def scopes(text: str) -> list[int]:
    """Where scopes start: after each blank line."""
    return [0, *(m.end() for m in _BLANK.finditer(text))] if "\n" in text else [0]


def near(starts: list[int], part: Part, low: int, high: int) -> int | None:
    """Of sorted starts the one nearest to the part's (ties: the earlier) within [low, high], or None."""
    i = bisect_right(starts, part.start)
    best = [s for s in starts[max(0, i - 1) : i + 1] if low <= s <= high]
    return min(best, key=lambda s: (abs(s - part.start), s)) if best else None


def link(base: dict[str, list[tuple[int, int]]], weak: list[Part], scope_starts: list[int], reach: int) -> list[tuple[Part, int | None, int | None]]:
    """The weak parts that complement others: (part, start of its nearest partner in each other role, in
    the order identifier, secret, endpoint)."""
    role: dict[str, list[int]] = {"identifier": [], "secret": [], "endpoint": []}
    for p in [*weak, *(Part(s, e, k) for k in BASE for s, e in base[k])]:
        role[p.role].append(p.start)
    for v in role.values():
        v.sort()
    sure = {"secret": sorted(s for s, _ in base["access"]), "identifier": sorted(s for s, _ in base["assign"])}
    out = []
    for p in weak:
        at = bisect_right(scope_starts, p.start)
        low = max(scope_starts[at - 1], p.start - reach)
        high = min(scope_starts[at] - 1 if at < len(scope_starts) else p.start + reach, p.start + reach)
        others = [near(role[r], p, low, high) for r in role if r != p.kind]
        if all(o is not None for o in others) or (p.kind in sure and near(sure[p.kind], p, low, high) is not None):
            out.append((p, *others))
    return out


def find(text: str, reach: int = 300) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[Part, int | None, int | None]]]:
    """(base spans by kind, linked weak parts with their partners)."""
    base = base_spans(text)
    weak = weak_parts(text, base)
    return base, link(base, weak, scopes(text), reach) if weak else []


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def detect(docs: DataFrame, reach: int = 300) -> DataFrame:
    """Counts, base digest, all spans and the number of linked weak parts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digest, spans, linked = [[] for _ in BASE], [], [], []
            for text in strings(b):
                base, weak = find(text, reach)
                sure = [(s, e, k) for k in BASE for s, e in base[k]]
                for c, k in zip(counts, BASE):
                    c.append(len(base[k]))
                digest.append(hashlib.sha256(_joined(sure).encode()).hexdigest())
                spans.append(_joined([*sure, *((p.start, p.end, p.kind) for p, *_ in weak)]))
                linked.append(len(weak))
            names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_linked"]
            yield pa.record_batch([col(b, "doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(linked, pa.int64())], names)

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def credentials(docs: DataFrame, reach: int = 300) -> DataFrame:
    """One row for each linked weak part with its text and its partners' starts (null: none in reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, text in zip(col(b, "doc_id").to_pylist(), strings(b)):
                for p, *others in find(text, reach)[1]:
                    at = dict(zip([r for r in ("identifier", "secret", "endpoint") if r != p.kind], others)) | {p.kind: p.start}
                    ids.append(i)
                    rows.append((p.kind, p.start, p.end, text[p.start : p.end], at["identifier"], at["secret"], at["endpoint"]))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
            yield pa.record_batch([pa.array(ids, pa.int64()), *cols], ["doc_id", "kind", "start", "end", "value", "identifier_at", "secret_at", "endpoint_at"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, kind string, start long, end long, value string, identifier_at long, secret_at long, endpoint_at long")
