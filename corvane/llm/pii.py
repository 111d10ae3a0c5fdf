"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs,
plus signs, digits, scheme marks and identifier cues. A deterministic parser of
its kind grows each anchor to its left and right by character classes and
validates what it found; no parser backtracks, so long runs cost linear time.

The base kinds are fixed by a contract: email, ip, card and phone, each
leftmost and non-overlapping, failing matches dropped without a retry. The
method adds ``iban`` (cue: the word IBAN; or, without it, a country's letters
at the start of a word, which then need two digits after them, that country's
length and at least eight digits; valid by remainder 97), ``ssn`` (cue: the letters SSN), ``account`` (cue: the word
account, acct or konto, then 6 to 18 digits) and ``userinfo`` (cue: ``://``,
then ``name:password@``). Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "account", "userinfo")
Span = tuple[int, int]

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset(_LETTERS) | _DIGITS
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
#: The cue words of the added kinds, each also found capitalised and in capitals.
_CUES = {"iban": "iban", "ssn": "ssn", "account": "account", "acct": "account", "konto": "account"}
#: Countries and the lengths of their account numbers.
_COUNTRIES = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    cues = {form: kind for word, kind in _CUES.items() for form in (word, word.capitalize(), word.upper())}
    for word, kind in {"@": "at", "+": "plus", "://": "scheme", **{d: "digit" for d in "0123456789"}, **cues, **dict.fromkeys(_COUNTRIES, "country")}.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def _run(text: str, at: int, chars: frozenset[str]) -> int:
    """The end of the run of ``chars`` that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _email(text: str, at: int, low: int) -> tuple[int, int] | None:
    """Around the at-sign at ``at``, not left of ``low``: a local part and at least two labels."""
    start = at
    while start > low and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    whole = end
    while whole < len(text) and text[whole] == ".":
        nxt = _run(text, whole + 1, _LABEL)
        if nxt == whole + 1:
            break
        whole = nxt
    return (start, whole) if whole > end else None


def _ips(text: str, at: int) -> tuple[list[Span], int]:
    """From the digit run at ``at``: matches of four runs joined by single dots, and where the chain of runs ends."""
    runs = []
    while True:
        end = _run(text, at, _DIGITS)
        runs.append((at, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS:
            at = end + 1
        else:
            break
    out = []
    for i in range(0, len(runs) - 3, 4):
        four = runs[i : i + 4]
        if all(int(text[max(s, e - 4) : e]) <= 255 and not text[s : max(s, e - 4)].strip("0") for s, e in four):
            out.append((four[0][0], four[3][1]))
    return out, runs[-1][1]


def _card(text: str, at: int) -> tuple[Span | None, int]:
    """From the digit at ``at``: digits joined by at most one space or hyphen each."""
    end, n, digits = at, len(text), []
    while True:
        digits.append(text[end])
        end += 1
        if end < n and text[end] in _DIGITS:
            continue
        if end + 1 < n and text[end] in " -" and text[end + 1] in _DIGITS:
            end += 1
            continue
        break
    return ((at, end) if 16 <= len(digits) <= 19 and luhn("".join(digits)) else None), end


def _phone(text: str, at: int) -> tuple[Span | None, int]:
    """From the plus sign at ``at``: the longest stretch of digits and separators that ends in a digit; (None, at) if there is none."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None, at
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in _DIGITS:
        return None, at
    n = sum(c in _DIGITS for c in text[at:end])
    return ((at, end) if 8 <= n <= 15 else None), end


def _iban(text: str, start: int) -> Span | None:
    """From ``start``: country, check digits and 11 to 30 letters or digits in groups, with remainder 1 by 97."""
    got, at = [], start
    while at < len(text) and len(got) < 34:
        if text[at] in _ALNUM:
            got.append(text[at].upper())
        elif text[at] != " " or not got or text[at - 1] == " ":
            break
        at += 1
    for n in range(len(got), 14, -1):  # trailing words may have been taken in
        code = "".join(got[:n])
        if code[:2].isalpha() and code[2:4].isdigit() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            at, left = start, n
            while left:
                left -= text[at] != " "
                at += 1
            if at >= len(text) or text[at] not in _ALNUM:
                return start, at
    return None


def _country(text: str, start: int) -> Span | None:
    """From a country's letters at ``start``: its account number in groups, without the cue word."""
    if start and text[start - 1] in _ALNUM or _run(text, start + 2, _DIGITS) < start + 4:
        return None
    left, at, digits = _COUNTRIES[text[start : start + 2]], start, []
    while left and at < len(text):
        if text[at] in _ALNUM:
            digits.append(text[at])
            left -= 1
        elif text[at] != " " or text[at - 1] == " ":
            return None
        at += 1
    code = "".join(digits).upper()
    if left or (at < len(text) and text[at] in _ALNUM) or sum(c in _DIGITS for c in code) < 10:
        return None
    return (start, at) if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else None


def _after_cue(text: str, at: int) -> int:
    """Past separators and words like "no" or "number" that stand between a cue and its value."""
    end = min(len(text), at + 24)
    while at < end and text[at] not in _DIGITS:
        if text[at] not in " :#.=" and text[at] not in "nobrumeNOBRUME":
            return -1
        at += 1
    return at if at < end else -1


def _ssn(text: str, at: int) -> Span | None:
    start = _after_cue(text, at)
    if start < 0:
        return None
    part = text[start : start + 11]
    ok = len(part) == 11 and part[3] == part[6] == "-" and all(c in _DIGITS for c in part[:3] + part[4:6] + part[7:])
    return (start, start + 11) if ok and part[:3] not in ("000", "666") and part[0] != "9" and _run(text, start + 11, _DIGITS) == start + 11 else None


def _account(text: str, at: int) -> Span | None:
    start = _after_cue(text, at)
    if start < 0:
        return None
    end = _run(text, start, _DIGITS)
    return (start, end) if 6 <= end - start <= 18 else None


def _userinfo(text: str, at: int) -> Span | None:
    end = _run(text, at, _LOCAL | frozenset(":!$&'()*,;=~"))
    return (at, end) if end > at and end < len(text) and text[end] == "@" and ":" in text[at:end] else None


def find(text: str) -> dict[str, list[Span]]:
    """Spans of every kind in ``text``, by start."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    email_low = phone_low = ip_low = card_low = 0
    for last, (kind, size) in _ANCHORS.iter(text):
        if kind == "digit":
            if last >= ip_low:
                found, ip_low = _ips(text, last)
                out["ip"] += found
            if last >= card_low:
                card, card_low = _card(text, last)
                if card:
                    out["card"].append(card)
        elif kind == "at":
            if last >= email_low and (span := _email(text, last, email_low)):
                out["email"].append(span)
                email_low = span[1]
        elif kind == "plus":
            if last >= phone_low:
                phone, end = _phone(text, last)
                phone_low = max(phone_low, end)
                if phone:
                    out["phone"].append(phone)
        else:
            end = last + 1
            if kind == "scheme":
                span, name = _userinfo(text, end), "userinfo"
            elif kind == "iban":
                at = end
                while at < len(text) and text[at] in " :#" and at < end + 6:
                    at += 1
                span, name = _iban(text, at), "iban"
            elif kind == "country":
                span, name = _country(text, last - 1), "iban"
            elif kind == "ssn":
                span, name = _ssn(text, end), "ssn"
            else:
                span, name = _account(text, end), "account"
            if span and (not out[name] or span[0] >= out[name][-1][1]):
                out[name].append(span)
    return out


def spans_text(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    A null or empty text has no spans. Repeated rows and null keys pass
    through; other columns are not read.
    """
    schema = docs.select(key).schema
    for k in BASE:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def run(batches):
        for b in batches:
            rows = [find(t or "") for t in b.column(1).to_pylist()]
            columns = [b.column(0), *(pa.array([len(r[k]) for r in rows], pa.int64()) for k in BASE)]
            columns += [pa.array([hashlib.sha256(spans_text(r, BASE).encode()).hexdigest() for r in rows], pa.string()), pa.array([spans_text(r, KINDS) for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def mask(text: str | None) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    if not text:
        return text
    merged: list[list] = []
    for s, e, k in sorted((s, e, k) for k, spans in find(text).items() for s, e in spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    out, at = [], 0
    for s, e, k in merged:
        out += [text[at:s], f"<{k}>"]
        at = e
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with personal data in its text column masked; ``length`` names a column that holds the text's length in code points, kept true."""
    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for b in batches:
            columns = list(b.columns)
            new = [mask(t) for t in b.column(at).to_pylist()]
            columns[at] = pa.array(new, pa.string())
            if length:
                i = names.index(length)
                columns[i] = pa.array([None if t is None else len(t) for t in new], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
