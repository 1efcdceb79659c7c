"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, URL schemes,
identifier cues and the digit pairs that every IP address and card number
contains.  Deterministic local parsers expand each anchor to its boundaries and
validate what they find.  Per kind the spans are leftmost and do not overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelink.llm.common import prepare

#: Kinds in their order for equal starts; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "account", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"://(?:[^\s/?#@<>\"']*@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
_AFTER_CUE = re.compile(r"(?:[\x20_-]?(?:number|no\.?|nr\.?|id))?[\x20:#=]{1,3}", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])")
_SCHEMES = ("http", "https", "ftp")
#: After the cue of a secret: perhaps a quote, then an assignment, then perhaps a quote.
_ASSIGNED = re.compile(r"[\"'\x60]?(?:\x20{0,3}(?:=>|:=|[:=])\x20{0,3}|\x20)(?:bearer\x20)?[\"'\x60]?", re.IGNORECASE)
_SECRET = re.compile(r"[A-Za-z0-9_+/.~$!%^&*=-]{12,512}")
_CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}
_CUES |= dict.fromkeys(("api key", "api-key", "api_key", "apikey", "access key", "access_key", "secret", "token", "password", "passwd", "bearer"), "secret")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    found.add_word("://", ("url", 3))
    for a in "0123456789":
        for b in "0123456789":
            found.add_word(f"{a}.{b}", ("ip", 3))
            found.add_word(a + b, ("card", 2))
            for gap in " -":
                found.add_word(a + gap + b, ("card", 3))
    for cue, kind in _CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    if not 15 <= len(text) <= 34:
        return False
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def secret_like(value: str) -> bool:
    """Letters and digits mixed, as words and numbers are not."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _folded(text: str) -> str:
    """``text`` in lower case, place by place; U+0130 alone would take two places."""
    return text.translate(_LOWER) if "\u0130" in text else text.lower()


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def find(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all spans, by start, then kind; code points, end exclusive."""
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the kind's next match may start
    for last, (kind, width) in _anchors().iter(_folded(text)):
        at = last + 1 - width
        if kind == "email":
            start = at
            while start > done[kind] and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, last + 1) if start < at else None
            if m:
                done[kind] = m.end()
                out.append((kind, start, m.end()))
        elif kind == "ip":
            if at < done[kind]:
                continue
            start = at
            while start > done[kind] and text[start - 1] in _DIGITS:
                start -= 1
            run = _DOTTED.match(text, start)
            done[kind] = run.end()
            parts = [(m.start(), m.end()) for m in re.compile("[0-9]+").finditer(text, start, run.end())]
            for k in range(0, len(parts) - 3, 4):
                if all(_byte(text[a:b]) for a, b in parts[k : k + 4]):
                    out.append((kind, parts[k][0], parts[k + 3][1]))
        elif kind == "card":
            if at < done[kind]:
                continue
            m = _CARD.match(text, at)
            done[kind] = m.end()
            digits = re.sub("[^0-9]", "", m.group()) if m.end() - at <= 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((kind, at, m.end()))
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m and 10 <= sum(c in _DIGITS for c in m.group()) <= 15:
                out.append((kind, at, m.end()))
        elif kind == "url":
            start = at
            while start > max(done[kind], at - 5) and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            m = _URL.match(text, at) if text[start:at].lower() in _SCHEMES else None
            if m:
                end = m.end()
                while text[end - 1] in ".,;:!?)]}":
                    end -= 1
                done[kind] = end
                out.append((kind, start, end))
        else:
            before = text[at - 1] if at else " "
            after, form, ok = _FORMS[kind]
            # a secret's cue may end a longer name, such as client_secret
            gap = after.match(text, last + 1) if not (before.isalnum() or before == "_" and kind != "secret") else None
            m = form.match(text, gap.end()) if gap else None
            if m and m.start() >= done[kind] and ok(m.group()):
                done[kind] = m.end()
                out.append((kind, m.start(), m.end()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


_FORMS = {"iban": (_AFTER_CUE, _IBAN, iban_valid), "ssn": (_AFTER_CUE, _SSN, bool), "account": (_AFTER_CUE, _ACCOUNT, bool), "secret": (_ASSIGNED, _SECRET, secret_like)}


def redact(text: str) -> str:
    """``text`` with its spans replaced by their kinds; of spans that overlap the first counts."""
    parts, at = [], 0
    for kind, start, end in find(text):
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*parts, text[at:]])


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans array<struct<kind, start, end>>)`` of every whole text.

    A null or empty text has no spans, a null id stays null, rows that repeat
    come as often, an empty table gives none; other columns are ignored.
    """
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape)], ["id", "spans"])

    return rows.mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every text."""
    found = spans(df, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
