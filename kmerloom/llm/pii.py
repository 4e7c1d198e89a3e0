"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, digit pairs, plus and dot before a digit,
schemes, and cues that announce an identifier.  A local parser expands each anchor to the boundaries of an
email address, network address, card number, phone number, web address or account number and validates it.

Base kinds, each leftmost and non-overlapping by itself: ``email``, ``ip`` (parts at most 255), ``card`` (12 to
19 digits that pass Luhn), ``phone`` (9 to 15 digits); a match that fails validation is dropped without retry.
Added kinds: ``address`` (a web address after a scheme) and ``account`` (the value after a cue such as ``IBAN:``,
IBANs by their check digits, others with at least five digits).  Spans are in code points, the end exclusive.

Null texts count as empty, repeated rows give repeated results, an empty table gives no rows, and other
columns are ignored (scan) or kept (redact).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "ssh://")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport", "customer id", "member id")

_EMAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`|\\^{}]+")
_ACCOUNT = re.compile(r"(?:\s?(?:no\.?|number|nr\.?|#))?\s?[:=#]?\s{0,2}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}|[A-Za-z0-9][A-Za-z0-9-]{4,33})(?![A-Za-z0-9])", re.I)
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    v = value.replace(" ", "").upper()
    if not 15 <= len(v) <= 34 or not v.isascii() or not v.isalnum():
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    digits = "0123456789"
    patterns = {"@": ("at", 1)}
    for d in digits:
        patterns["+" + d] = ("plus", 2)
        patterns["." + d] = ("dot", 2)
        for e in digits:
            for between in ("", " ", "-"):
                patterns[d + between + e] = ("pair", len(between) + 2)
    for s in SCHEMES:
        for form in {s, s.upper(), s.capitalize()}:
            patterns[form] = ("scheme", len(s))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize(), c.title()}:
            patterns[form] = ("cue", len(c))
    for p, v in patterns.items():
        a.add_word(p, v)
    a.make_automaton()
    return a


def _run_start(text: str, at: int, floor: int) -> int:
    """Start of the run ``[0-9]([ -]?[0-9])*`` that holds the digit at ``at``, not before floor."""
    i = at
    while i > floor:
        if text[i - 1] in _DIGITS:
            i -= 1
        elif i - 2 >= floor and text[i - 1] in " -" and text[i - 2] in _DIGITS:
            i -= 2
        else:
            break
    return i


def find(text: str | None) -> list[tuple[int, int, int]]:
    """All spans as (start, index of kind, end), sorted."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # up to where matches of a kind have used the text
    for last, (anchor, size) in automaton().iter(text):
        first = last - size + 1
        if anchor == "pair":
            if first >= done["card"]:
                start = _run_start(text, first, done["card"])
                end = _CARD.match(text, start).end()
                done["card"] = end
                digits = re.sub(r"[ -]", "", text[start:end])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((start, 2, end))
        elif anchor == "dot":
            if first >= done["ip"]:
                i = first
                while i > done["ip"] and text[i - 1] in _DIGITS:
                    i -= 1
                m = _IP.match(text, i) if i < first else None
                if m:
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        out.append((i, 1, m.end()))
        elif anchor == "plus":
            if first >= done["phone"] and (m := _PHONE.match(text, first)):
                done["phone"] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append((first, 3, m.end()))
        elif anchor == "at":
            i = first
            while i > done["email"] and text[i - 1] in _LOCAL:
                i -= 1
            if i < first and (m := _EMAIL.match(text, first)):
                done["email"] = m.end()
                out.append((i, 0, m.end()))
        elif anchor == "scheme":
            if first >= done["address"] and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    done["address"] = end
                    out.append((first, 4, end))
        elif first >= done["account"] and not (first and text[first - 1].isalnum()):
            m = _ACCOUNT.match(text, last + 1)
            if m:
                start, end = m.span(1)
                value = m[1]
                if " " in value and not iban_ok(value):
                    value = value.split(" ")[0]
                    end = start + len(value)
                if start > last + 1 and (iban_ok(value) or sum(c in _DIGITS for c in value) >= 5):
                    done["account"] = end
                    out.append((start, 5, end))
    return sorted(out)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None) -> str | None:
    """The text with each span, or each group of overlapping spans, replaced by ``[KIND]`` of its first."""
    spans = find(text)
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_address long, n_account long"
_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_address", pa.int64()), ("n_account", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = find(text)
            counts = [0] * len(KINDS)
            for _, k, _ in spans:
                counts[k] += 1
            base = shown([x for x in spans if x[1] < len(BASE)])
            rows.append((doc_id, *counts[:4], hashlib.sha256(base.encode()).hexdigest(), shown(spans), *counts[4:]))
        yield common.arrow(_ARROW, list(zip(*rows)) if rows else [[]] * len(_ARROW))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, digest of the base spans and all spans of every text."""
    common.prepare(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, SCHEMA)


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in text_col replaced; a null text stays null."""
    common.prepare(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield batch.set_column(at, batch.schema.field(at), pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_pii": op5_pii}
ORACLE_SQL: dict[str, str] = {}
