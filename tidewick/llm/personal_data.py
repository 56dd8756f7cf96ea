"""Personal data: Aho-Corasick anchors, expanded and validated by local parsers."""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents

#: The first four are the base kinds; the method adds the others. At equal starts spans stand in this order.
KINDS = ("email", "ip", "card", "phone", "mail", "login", "ipv6", "account")
BASE = 4
CARD_DIGITS, PHONE_DIGITS = range(14, 20), range(10, 16)
ACCOUNT_CHARS = range(15, 35)

_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WIDE_DOMAIN = re.compile(r"(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[A-Za-z0-9._~%!$&'()*+,;=-]+(?=@[A-Za-z0-9\[])")
_BRACKETED = re.compile(r"(?:[^/\s@]*@)?\[([0-9A-Fa-f:.]{2,45})\]")
_ACCOUNT = re.compile(r"(?:\W|no|nr){0,8}?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
#: Words before an account number, as they are written in lower case, with a capital and in capitals.
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")


@functools.cache
def _anchors() -> ahocorasick.Automaton:
    """The automaton of all anchors: at-signs, plus signs, digits, scheme ends and account cues."""
    found = ahocorasick.Automaton()
    for key, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in sorted(_DIGITS))]:
        found.add_word(key, (kind, len(key)))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _account_valid(number: str) -> bool:
    """The check of an international account number: its letters as 10 to 35, its first four characters last, modulo 97."""
    return len(number) in ACCOUNT_CHARS and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all spans of a text in code points, in order.

    The automaton meets the anchors from left to right; the parser of an anchor looks no further than
    the characters that its kind allows, and each kind goes on after its last match, so a text is read
    a constant number of times whatever it holds.
    """
    out: list[tuple[int, int, int]] = []
    emails = mails = dotted = spaced = dialled = 0  # where the last match of each kind ended
    for last, (anchor, size) in _anchors().iter(text):
        at = last + 1 - size
        if anchor == "digit":
            if at >= dotted:
                m = _DOTTED.match(text, at)
                dotted = m.end()
                _addresses(m, out)
            if at >= spaced:
                m = _SPACED.match(text, at)
                if m is None:
                    spaced = at + 1
                    continue
                spaced = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if len(digits) in CARD_DIGITS and luhn(digits):
                    out.append((at, 2, spaced))
        elif anchor == "at":
            start = at
            while start > emails and text[start - 1] in _LOCAL:
                start -= 1
            base = _DOMAIN.match(text, at + 1) if start < at else None
            if base is not None:
                emails = base.end()
                out.append((start, 0, emails))
            wide = at
            while wide > mails and (text[wide - 1] in _LOCAL or text[wide - 1].isalnum()):
                wide -= 1
            m = _WIDE_DOMAIN.match(text, at + 1) if wide < at else None
            if m is not None:
                mails = m.end()
                if base is None or (wide, mails) != (start, emails):
                    out.append((wide, 4, mails))
        elif anchor == "plus":
            m = _DIALLED.match(text, at) if at >= dialled else None
            if m is not None:
                dialled = m.end()
                if sum(c in _DIGITS for c in m[0]) in PHONE_DIGITS:
                    out.append((at, 3, dialled))
        elif anchor == "scheme":
            if at and (text[at - 1].isascii() and text[at - 1].isalnum()):
                if (m := _LOGIN.match(text, last + 1)) is not None:
                    out.append((m.start(), 5, m.end()))
                if (m := _BRACKETED.match(text, last + 1)) is not None and _is_ipv6(m[1]):
                    out.append((m.start(1), 6, m.end(1)))
        elif (m := _ACCOUNT.match(text, last + 1)) is not None and _account_valid(m[1].replace(" ", "")):
            out.append((m.start(1), 7, m.end(1)))
    return sorted(set(out))


def _addresses(m: re.Match, out: list[tuple[int, int, int]]) -> None:
    """Each four numbers in a row of a dotted chain are one match."""
    if m[0].count(".") < 3:
        return
    at, parts = m.start(), m[0].split(".")
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        end = at + sum(map(len, four)) + 3
        if all(map(_octet, four)):
            out.append((at, 1, end))
        at = end + 1


def _is_ipv6(address: str) -> bool:
    try:
        ipaddress.IPv6Address(address)
    except ValueError:
        return False
    return True


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """df's other columns with n_email, n_ip, n_card, n_phone (longs), base_sha256 and spans (strings) of the whole text.

    Spans are kind:start:end in code points, comma-joined by start, then in the order of KINDS;
    base_sha256 is of the base kinds' spans alone. Rows are read where they lie, one at a time: no
    shuffle, and nothing of a text but its spans is kept. Null and empty texts have no spans; a text of
    any length is read whole, in linear time; equal rows get equal results; an empty table gives no
    rows; columns of df with the names of results give way to them.
    """
    made = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    rest = [c for c in df.columns if c != text and c.lower() not in made]
    schema = df.select(*[f"`{c}`" for c in rest]).schema
    for name in made:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(BASE)]
            shas, spans = [], []
            for value in batch.column(len(rest)):
                found = find_spans(value.as_py() or "")
                base = [x for x in found if x[1] < BASE]
                for k, n in enumerate(counts):
                    n.append(sum(x[1] == k for x in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(found))
            own = [*(pa.array(n, pa.int64()) for n in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *own], names=schema.fieldNames())

    return df.select(*[f"`{c}`" for c in [*rest, text]]).mapInArrow(scan, schema)


def mask_personal_data(df: DataFrame, text: str = "text", fill: str = "*") -> DataFrame:
    """df with every code point of a span (see find_personal_data) replaced by fill; all columns and rows stay.

    Null texts stay null.
    """
    at, names = df.columns.index(text), df.columns
    unique = [f"c{i}" for i in range(len(names))]
    schema = df.toDF(*unique).schema

    def masked(value: str | None) -> str | None:
        if value is None:
            return None
        parts, end = [], 0
        for s, _, e in find_spans(value):
            parts.append(value[end : max(s, end)])
            parts.append(fill * (max(e, end) - max(s, end)))
            end = max(e, end)
        return "".join([*parts, value[end:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([masked(x.as_py()) for x in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], names=unique)

    return df.toDF(*unique).mapInArrow(scan, schema).toDF(*names)


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
