"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and
identifier cues. At each anchor a deterministic local parser expands to the left and right
and validates the span. The base kinds (email, ip, card, phone) give exactly the leftmost
non-overlapping matches of their definitions; the method adds url, account and secret spans.

Defined results: null text is empty and has no spans; spans are in code points, end
exclusive; an empty table gives no rows; repeated rows give repeated results; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, parts

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]

# Definitions of the base kinds, and cues of the others.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)
URL_REST = re.compile(r"[^\s<>\"'\x00-\x1f]+")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport")
SECRET_CUES = ("token", "password", "secret", "api_key", "apikey")
ACCOUNT_VALUE = re.compile(r"(?:\s*(?:no\.?|number|nr\.?|#))?\s*[:=#]\s*[\"']?([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})")
SECRET_VALUE = re.compile(r"\s*[:=]\s*[\"']?([A-Za-z0-9_+/=-]{8,})")
AWS_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
DIGITS = "0123456789"


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.add_word("AKIA", ("aws", 4))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d)
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


_shared: list = []


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind as a place in KINDS, end) in order."""
    if not text:
        return []
    if not _shared:
        _shared.append(automaton())
    spans: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = url_end = secret_end = account_end = 0
    for last, (what, width) in _shared[0].iter(text):
        at = last - width + 1
        if what == "digit":
            if at >= ip_end:
                if m := IP.match(text, at):
                    ip_end = m.end()
                    if all(map(_byte, m[0].split("."))):
                        spans.append((at, 1, ip_end))
                else:  # no digit of this run can begin one
                    ip_end = at + 1
                    while ip_end < len(text) and text[ip_end] in DIGITS:
                        ip_end += 1
            if at >= card_end:
                if m := CARD.match(text, at):
                    card_end = m.end()
                    if CARD_DIGITS[0] <= card_end - at:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                            spans.append((at, 2, card_end))
        elif what == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                spans.append((start, 0, email_end))
        elif what == "plus":
            if m := PHONE.match(text, at):
                if PHONE_DIGITS[0] <= sum(c in DIGITS for c in m[0]) <= PHONE_DIGITS[1]:
                    spans.append((at, 3, m.end()))
        elif what == "scheme":
            if at >= url_end and (m := URL_REST.match(text, last + 1)):
                url_end = m.end()
                while url_end > last + 1 and text[url_end - 1] in ".,;:!?)]}":
                    url_end -= 1
                if url_end > last + 1:
                    spans.append((at, 4, url_end))
        elif what == "aws":
            if at >= secret_end and (m := AWS_KEY.match(text, at)):
                secret_end = m.end()
                spans.append((at, 6, secret_end))
        elif what == "account":
            if at >= account_end and (m := ACCOUNT_VALUE.match(text, last + 1)) and any(c in DIGITS for c in m[1]):
                account_end = m.end(1)
                spans.append((m.start(1), 5, account_end))
        elif at >= secret_end and (m := SECRET_VALUE.match(text, last + 1)):
            secret_end = m.end(1)
            spans.append((m.start(1), 6, secret_end))
    spans.sort()
    return spans


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, spans: list[tuple[int, int, int]] | None = None) -> str | None:
    """The text with every span replaced by its kind's name; of overlapping spans the first counts."""
    if text is None:
        return None
    out, at = [], 0
    for a, k, b in find_spans(text) if spans is None else spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans, a count for each added kind, n_spans (all of them) and, if asked for, the redacted text; no shuffle."""
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[4:]), "n_spans", *(["redacted"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                counts: list[list[int]] = [[] for _ in KINDS]
                sha, joined, n_spans, redacted = [], [], [], []
                for text in part.column(1).to_pylist():
                    spans = find_spans(text)
                    kinds = [k for _, k, _ in spans]
                    for k, column in enumerate(counts):
                        column.append(kinds.count(k))
                    sha.append(hashlib.sha256(join_spans([s for s in spans if s[1] < len(BASE)]).encode()).hexdigest())
                    joined.append(join_spans(spans))
                    n_spans.append(len(spans))
                    if with_text:
                        redacted.append(redact(text, spans))
                n = [pa.array(c, pa.int64()) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *n[:4], pa.array(sha, pa.string()), pa.array(joined, pa.string()), *n[4:], pa.array(n_spans, pa.int64()), *([pa.array(redacted, pa.string())] if with_text else [])],
                    names=names,
                )

    kinds = {"doc_id": id_type, "base_sha256": "string", "spans": "string", "redacted": "string"}
    return df.select(col(id_col), col(text_col)).mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'bigint')}" for n in names))
