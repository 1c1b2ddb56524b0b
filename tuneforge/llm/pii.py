"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs, digits,
URL schemes and identifier cues. At each anchor a deterministic local parser expands to both
sides and validates: ``email``, ``ip``, ``card`` and ``phone`` by the base grammar, ``address``
(the authority after a scheme, if it carries user information or an IPv4 or IPv6 host) and ``account`` (an
identifier of digits, or letters and digits, behind an identifier cue; of what has the form of an
IBAN, the longest run of whole groups that passes the check digits; of others, the groups up to the
first without a digit, 34 characters at most). Parsers never look back beyond the end of their kind's last match, so that
results equal leftmost non-overlapping search, and each character is read a bounded number of times.

Null texts are empty and give no spans. Offsets are code points, end exclusive. Each row is
judged alone: repeated rows, null doc_ids and extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneforge.llm.common import text_or_empty

KINDS = ["email", "ip", "card", "phone", "address", "account"]
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string>>"

# What may stand in each part, and the cues of identifiers.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AUTHORITY = re.compile(r"[A-Za-z0-9._%+:@\[\]-]+")
LEAD = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|id))?\x20?[:#=]?\x20?(?=[A-Z]{0,4}[0-9])")
GROUP = re.compile(r"[A-Z0-9]{1,35}")
IPV6 = re.compile(r"\[([0-9A-Fa-f:.]{2,45})\]")
SCHEMES = ["://"]
DIGITS = frozenset("0123456789")
#: An identifier has at most so many letters and digits (the longest IBAN).
MAX_IDENTIFIER = 34
CUES = ["account", "Account", "ACCOUNT", "acct", "Acct", "IBAN", "iban", "Konto", "konto", "compte", "cuenta", "passport", "Passport", "SSN", "ssn", "tax id", "Tax ID"]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def account_end(text: str, at: int) -> int:
    """Where an identifier that begins at ``at`` ends, 0 if there is none. Whole groups are read up to
    ``MAX_IDENTIFIER`` characters, so the time does not depend on what follows."""
    value, ends, numeric, plain_value = "", [], 0, ""
    pos, still = at, True
    while m := GROUP.match(text, pos):
        whole = m.end() == len(text) or not (text[m.end()].isalnum() or text[m.end()] == "_")
        if len(value) + len(m[0]) > MAX_IDENTIFIER or (ends and not whole):
            break
        value += m[0]
        ends.append((m.end(), value))
        still = still and any(c in DIGITS for c in m[0])
        if still:
            numeric, plain_value = m.end(), value
        if not whole or m.end() == len(text) or text[m.end()] not in " -":
            break
        pos = m.end() + 1
    form = re.match(r"[A-Z]{2}[0-9]{2}", value)
    if form and (passed := [end for end, v in ends if len(v) >= 15 and iban(v)]):
        return passed[-1]
    return numeric if sum(c in DIGITS for c in plain_value) >= 6 and not (form and len(plain_value) >= 15) else 0


def ipv6(authority: str) -> bool:
    m = IPV6.match(authority)
    try:
        return bool(m) and IPv6Address(m[1]) is not None
    except ValueError:
        return False


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in ["@", "+", *SCHEMES, *"0123456789", *CUES]:
        a.add_word(word, word)
    a.make_automaton()
    return a


def spans_of(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span of a text, by start and kind."""
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = identifier_end = 0
    for last, word in anchors.iter(text):
        if word in "0123456789":
            if last and text[last - 1] in "0123456789":
                continue
            if last >= ip_end and (m := IP.match(text, last)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    out.append((last, 1, ip_end))
            if last >= card_end and (m := CARD.match(text, last)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((last, 2, card_end))
        elif word == "@":
            start = last
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                email_end = m.end()
                out.append((start, 0, email_end))
        elif word == "+":
            if last >= phone_end and (m := PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((last, 3, phone_end))
        elif word == "://":
            if (m := AUTHORITY.match(text, last + 1)) and ("@" in m[0] or IP.match(m[0]) or ipv6(m[0])):
                out.append((last + 1, 4, m.end()))
        elif last + 1 >= identifier_end and (m := LEAD.match(text, last + 1)) and (end := account_end(text, m.end())):
            identifier_end = end
            out.append((m.end(), 5, end))
    out.sort()
    return out


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
    for batch in batches:
        rows, texts = [], batch.column(1)
        for k in range(len(texts)):
            text = texts[k].as_py()
            rows.append([{"kind": KINDS[n], "start": a, "end": b, "value": text[a:b]} for a, n, b in spans_of(text, anchors)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of each text, by start and kind, with their values."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_scan, SCHEMA)
