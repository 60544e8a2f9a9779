"""Personal data by anchor expansion (operator 5).

One Aho-Corasick pass over a text finds the anchors: at-signs, ``://``, plus
signs before a digit, two digits that touch or are one separator apart, and cue
words of identifiers (IBAN, SSN, account, street names).  A small parser for
each kind expands an anchor to its boundaries and validates it (octets, Luhn,
digit counts, IBAN's check digits).  Text without anchors is never parsed.

Anchors come in order of position and each kind remembers where its last match
ended, so a kind's spans are leftmost and do not overlap, as if its pattern had
been searched for from left to right: every match of a pattern holds an anchor
of its kind, and the first anchor fixes the match's start.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal, id_and_text

#: Kinds in the order in which spans with one start are listed; the first four are the contract's.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "ssn", "account", "address")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://[^\s/@:?#\"'<>]+:[^\s/@?#\"'<>]+@[A-Za-z0-9.-]+(:[0-9]+)?")
IBAN = re.compile(r"\s{0,2}(?:[Nn]o\.?|[Nn]umber)?\s?[:#=]?\s{0,2}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
SSN = re.compile(r"\s{0,2}(?:[Nn]o\.?|[Nn]umber)?\s?[:#=]?\s{0,2}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")
ACCOUNT = re.compile(r"\s{0,2}(?:[Nn]o\.?|[Nn]r\.?|[Nn]umber)?\s?[:#=]\s{0,2}([0-9]{6,17})(?![0-9A-Za-z])")
NAME = re.compile(r"[A-Z][A-Za-z'.-]*")
HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?\Z")
#: Cue words by parser; fixed values.
CUES = {"iban": ("IBAN", "iban", "Iban"), "ssn": ("SSN", "ssn", "Social Security", "social security"),
        "account": ("account", "Account", "ACCOUNT", "acct", "Acct", "Konto", "konto", "compte", "cuenta"),
        "address": ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive")}


def anchors():
    """The automaton; a value is (kind, length)."""
    import ahocorasick
    found = ahocorasick.Automaton()
    digits = "0123456789"
    words = {"@": ("email",), "://": ("login",)}
    for a in digits:
        words["+" + a] = ("phone",)
        for b in digits:
            words |= {a + b: ("card",), f"{a} {b}": ("card",), f"{a}-{b}": ("card",), f"{a}.{b}": ("ip",)}
    for kind, cues in CUES.items():
        words |= {cue: (kind,) for cue in cues}
    for word, (kind,) in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _email(text, at, low):
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end(), True) if m else None


def _octet(part: str) -> bool:
    part = part.lstrip("0")  # Python reads no number of over 4,300 digits
    return len(part) <= 3 and int(part or 0) <= 255


def _ip(text, at, low):
    start = at
    while start > low and text[start - 1] in "0123456789":
        start -= 1
    m = IP.match(text, start)
    return (start, m.end(), all(map(_octet, m[0].split(".")))) if m else None


def _card(text, at, low):
    m = CARD.match(text, at)
    digits = m[0].replace(" ", "").replace("-", "")
    return at, m.end(), 12 <= len(digits) <= 19 and luhn(digits)


def _phone(text, at, low):
    m = PHONE.match(text, at)
    return (at, m.end(), 9 <= sum(c in "0123456789" for c in m[0]) <= 15) if m else None


def _login(text, at, low):
    m = LOGIN.match(text, at)
    start = at
    while start > low and text[start - 1] in SCHEME:
        start -= 1
    return (start, m.end(), True) if m and start < at else None


def _after(pattern, valid=None):
    def parse(text, at, low, length):
        m = pattern.match(text, at + length)
        return (m.start(1), m.end(1), valid is None or valid(m[1])) if m else None
    return parse


def _address(text, at, low, length):
    """A house number and one to four names before the cue, read back blank by blank."""
    if text[at - 1: at] != " " or text[at + length: at + length + 1].isalnum():
        return None
    end, names = at - 1, 0
    while end > low and names <= 4:
        start = max(low, text.rfind(" ", low, end) + 1)
        if NAME.fullmatch(text, start, end):
            end, names = start - 1, names + 1
            continue
        m = HOUSE.search(text[start: end]) if names else None
        return (start + m.start(), at + length, True) if m else None
    return None


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "login": _login}
CUE_PARSERS = {"iban": _after(IBAN, iban_valid), "ssn": _after(SSN), "account": _after(ACCOUNT), "address": _address}
ORDER = {kind: k for k, kind in enumerate(KINDS)}


def spans(text: str, automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    found, ends = [], dict.fromkeys(KINDS, 0)
    for last, (kind, length) in automaton.iter(text):
        at, low = last + 1 - length, ends[kind]
        if at < low:  # inside the kind's last match
            continue
        hit = PARSERS[kind](text, at, low) if kind in PARSERS else CUE_PARSERS[kind](text, at, low, length)
        if hit:
            start, end, valid = hit
            ends[kind] = end
            if valid:
                found.append((start, end, kind))
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


def joined(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, n_more, base_sha256, spans)`` for each row.

    ``spans`` lists every span as kind:start:end by start; ``base_sha256`` is
    the digest of the first four kinds alone.  A null or empty text has no
    spans.  Null doc_ids, repeated rows and extra columns are no special case;
    an empty table gives no rows.  Whole texts are read; rows are independent."""

    def run(batches):
        automaton = anchors()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                counts, digests, lists = {kind: [] for kind in KINDS}, [], []
                for text in rows.column(1).to_pylist():
                    found = spans(text, automaton) if text else []
                    kinds = [s[2] for s in found]
                    for kind in KINDS:
                        counts[kind].append(kinds.count(kind))
                    digests.append(hashlib.sha256(joined(s for s in found if ORDER[s[2]] < 4).encode()).hexdigest())
                    lists.append(joined(found))
                more = [sum(x) for x in zip(*(counts[kind] for kind in KINDS[4:]))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *(pa.array(counts[kind], pa.int64()) for kind in KINDS[:4]), pa.array(more, pa.int64()),
                     pa.array(digests, pa.string()), pa.array(lists, pa.string())],
                    names=["doc_id", *(f"n_{kind}" for kind in KINDS[:4]), "n_more", "base_sha256", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        frugal(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_more long, base_sha256 string, spans string")
