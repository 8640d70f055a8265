"""Personal data by anchor expansion.

An Aho-Corasick automaton finds short anchors in one pass over a text: at-signs, URL schemes, a plus
before a digit, digit pairs, a dot between digits, and cue words of accounts and credentials. From each
anchor a parser of its kind reads the span around it, to both sides, and validates it.

Kinds ``email``, ``ip``, ``card`` and ``phone`` equal what the leftmost non-overlapping matches of the
patterns in ``PATTERNS`` give after validation (tested). Kinds ``url``, ``account`` and ``secret`` are
what the anchors add.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product
from string import digits

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
"""What the base kinds are defined by; only tests run these."""

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = frozenset(digits)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(PATTERNS["phone"])
_URL_REST = re.compile(r"[^\s<>\"'`|\\^{}]+")
_ACCOUNT = re.compile(r"(?:\s*(?:no|nr|number|num|id)\b)?[.:#=\s]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?|[0-9](?:[ -]?[0-9]){5,33})")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")
_SECRET = re.compile(r"\s{0,2}[:=]\s{0,2}[\"']?([^\s\"'<>,;]{8,})")
_ACCESS_KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")


def luhn(number: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(number)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(number: str) -> bool:
    """ISO 13616: moved to the end and letters spelled as numbers, it leaves 1 modulo 97."""
    return 15 <= len(number) <= 34 and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    anchors: dict[str, str] = {"@": "email", "://": "url", "www.": "www", "AKIA": "access"}
    anchors |= {f"+{d}": "phone" for d in digits}
    anchors |= {f"{d}.{e}": "ip" for d, e in product(digits, digits)}
    anchors |= {f"{d}{sep}{e}": "card" for d, sep, e in product(digits, ("", " ", "-"), digits)}
    for cue in ("account", "acct", "iban", "konto", "cuenta", "compte", "routing"):
        anchors |= {w: "account" for w in (cue, cue.title(), cue.upper())}
    for cue in ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key"):
        anchors |= {w: "secret" for w in (cue, cue.title(), cue.upper())}
    for word, kind in anchors.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


class Finder:
    """Finds spans ``(kind, start, end)`` in a text, in code points."""

    def __init__(self):
        self.automaton = _automaton()

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys(KINDS, 0)  # where the last match of a kind, valid or not, ended
        for last, (anchor, width) in self.automaton.iter(text):
            at = last - width + 1
            if anchor == "card":
                if at >= done["card"]:
                    done["card"] = self._card(text, at, done["card"], found["card"])
            elif anchor == "ip":
                if at >= done["ip"]:
                    done["ip"] = self._ip(text, at, done["ip"], found["ip"])
            elif anchor == "email":
                start, m = at, _DOMAIN.match(text, at + 1)
                if m:
                    while start > done["email"] and text[start - 1] in _LOCAL:
                        start -= 1
                    if start < at:
                        found["email"].append((start, m.end()))
                        done["email"] = m.end()
            elif anchor == "phone":
                if at >= done["phone"] and (m := _PHONE.match(text, at)):
                    if 8 <= sum(c in _DIGIT for c in m[0]) <= 15:
                        found["phone"].append(m.span())
                    done["phone"] = m.end()
            elif anchor in ("url", "www"):
                self._url(text, at, anchor, done, found["url"])
            elif anchor == "account":
                self._account(text, last + 1, done, found["account"])
            elif anchor == "secret":
                if last >= done["secret"] and (m := _SECRET.match(text, last + 1)):
                    found["secret"].append(m.span(1))
                    done["secret"] = m.end()
            elif at >= done["secret"] and (at == 0 or not text[at - 1].isalnum()) and (m := _ACCESS_KEY.match(text, at)):
                found["secret"].append(m.span())
                done["secret"] = m.end()
        return [(k, *span) for k in KINDS for span in found[k]]

    @staticmethod
    def _card(text: str, at: int, floor: int, out: list) -> int:
        start = at
        while start > floor:
            if text[start - 1] in _DIGIT:
                start -= 1
            elif start - 1 > floor and text[start - 1] in " -" and text[start - 2] in _DIGIT:
                start -= 2
            else:
                break
        m = _NUMBER.match(text, start)
        number = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(number) <= 19 and luhn(number):
            out.append(m.span())
        return m.end()

    @staticmethod
    def _ip(text: str, at: int, floor: int, out: list) -> int:
        """Reads the whole dotted chain around the anchor, and takes its numbers four by four."""
        start = at
        while start > floor:
            if text[start - 1] in _DIGIT:
                start -= 1
            elif start - 1 > floor and text[start - 1] == "." and text[start - 2] in _DIGIT:
                start -= 2
            else:
                break
        m = _DOTTED.match(text, start)
        parts, place = m[0].split("."), start
        for k in range(0, len(parts) - 3, 4):
            end = place + sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts[k : k + 4]):
                out.append((place, end))
            place = end + 1
        return m.end()

    @staticmethod
    def _url(text: str, at: int, anchor: str, done: dict, out: list) -> None:
        start = at
        if anchor == "url":
            while start > done["url"] and at - start < 32 and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
        if start < done["url"] or (anchor == "url" and start == at) or (anchor == "www" and start and text[start - 1].isalnum()):
            return
        m = _URL_REST.match(text, at + (3 if anchor == "url" else 4))
        if m and len(kept := m[0].rstrip(".,;:!?)]}")) >= 1:
            end = m.start() + len(kept)
            out.append((start, end))
            done["url"] = end

    @staticmethod
    def _account(text: str, at: int, done: dict, out: list) -> None:
        m = _ACCOUNT.match(text, at) if at >= done["account"] else None
        if m is None:
            return
        start, end = m.span(1)
        if text[start].isalpha():  # an account number with letters must pass its checksum; try shorter readings
            end = next((e for e in range(end, start + 14, -1) if iban(text[start:e].replace(" ", ""))), None)
            if end is None:
                return
        out.append((start, end))
        done["account"] = end


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, found, base_sha256)`` of every row; found: ``array<struct<kind,start,end,value>>``.

    Spans are in code points of the whole text, end exclusive, ordered by kind (as ``KINDS``), then start;
    spans of one kind do not overlap. ``base_sha256`` digests the base kinds' ``kind:start:end`` list. A
    null text is empty. Repeated rows and null ids each give a row; an empty table gives none; other
    columns are not read.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder()
        for batch in batches:
            rows, base = [], []
            for text in batch.column(1).to_pylist():
                spans = find(text) if text else []
                rows.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in spans])
                base.append(hashlib.sha256(joined([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span), pa.array(base)], names=[id_col, "found", "base_sha256"])

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, found array<struct<kind:string,start:long,end:long,value:string>>, base_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first, then the longest, counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
