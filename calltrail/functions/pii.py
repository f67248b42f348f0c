"""Masking of personal data and keyword guardrails."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import SPACE, WORD, ColumnLike, as_col

# What counts as an e-mail address, a card number and a phone number.
# A word boundary next to a digit is written as a look-around on ASCII word characters,
# and the first character is tested before the look-behind to skip most positions fast.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CARD = rf"(?=[0-9])(?<!{WORD})(?:[0-9][ -]*?){{13,19}}(?!{WORD})"
_GAP = f"(?:[-.]|{SPACE})?"
_START = rf"(?=[0-9(+])(?:(?<!{WORD})(?=[0-9])|(?<={WORD})(?=[(+]))"
PHONE = rf"{_START}(?:\+[0-9]{{1,3}}{_GAP})?\(?[0-9]{{2,4}}\)?{_GAP}[0-9]{{2,4}}{_GAP}[0-9]{{4}}(?!{WORD})"
EMAIL_MARK, CARD_MARK, PHONE_MARK = "[EMAIL_REDACTED]", "[CARD_REDACTED]", "[PHONE_REDACTED]"

# Keywords blocked when no list is given.
DEFAULT_BANNED = "exploit,jailbreak,bypass,malware"


def mask_pii(text: ColumnLike) -> Column:
    """Mask e-mails, then card numbers, then phone numbers.

    Texts without ``@`` or without digits skip the costly patterns.
    """
    c = as_col(text)
    no_mail = F.when(c.contains("@"), F.regexp_replace(c, EMAIL, EMAIL_MARK)).otherwise(c)
    digits = F.regexp_replace(F.regexp_replace(no_mail, CARD, CARD_MARK), PHONE, PHONE_MARK)
    return F.when(c.rlike("[0-9]"), digits).otherwise(no_mail)


_EMAIL_RE = re.compile(EMAIL, re.ASCII)
_CARD_RE = re.compile(CARD, re.ASCII)
_PHONE_RE = re.compile(PHONE, re.ASCII)


_DIGIT_RE = re.compile("[0-9]")


def _mask_text(text: str) -> str:
    if "@" in text:
        text = _EMAIL_RE.sub(EMAIL_MARK, text)
    if _DIGIT_RE.search(text):
        text = _PHONE_RE.sub(PHONE_MARK, _CARD_RE.sub(CARD_MARK, text))
    return text


# Strings of a JSON text, and the white space between its parts.
_JSON_PART = re.compile(r'"(?:[^"\\]|\\.)*+"|[ \t\r\n]++')
_KEY_FOLLOWS = re.compile(r"[ \t\r\n]*:")


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def _mask_json(doc: str) -> str:
    """Mask the string values of a JSON text, at any depth; keys, numbers and all else keep their form."""
    try:
        json.loads(doc, parse_constant=_refuse)
    except ValueError:
        return _mask_text(doc)
    except RecursionError:  # deeply nested; the strings are found without going down
        pass

    def part(m: re.Match) -> str:
        if m[0][0] != '"':
            return ""
        if _KEY_FOLLOWS.match(doc, m.end()):
            return m[0]
        try:
            text = json.loads(m[0])
        except ValueError:
            return m[0]
        masked = _mask_text(text)
        return m[0] if masked == text else json.dumps(masked, ensure_ascii=False)

    return _JSON_PART.sub(part, doc)


@F.pandas_udf(T.StringType())
def _mask_documents(docs: pd.Series) -> pd.Series:
    return docs.map(lambda doc: None if doc is None else _mask_json(doc))


def mask_pii_json(doc: ColumnLike) -> Column:
    """Mask every string value inside a JSON text; keys and structure stay.

    Only documents that hold ``@`` or a digit leave the JVM.
    """
    c = as_col(doc)
    needs = c.contains("@") | c.rlike("[0-9]")
    masked = _mask_documents(F.when(needs, c))
    return F.when(needs, masked).otherwise(c)


def redact_messages(messages: ColumnLike) -> Column:
    """Mask the ``content`` of every message of an ``array<struct<role,content>>``."""
    return F.transform(as_col(messages), lambda m: m.withField("content", mask_pii(m["content"])))


def banned_list(banned: str | Sequence[str] = DEFAULT_BANNED) -> list[str]:
    words = banned.split(",") if isinstance(banned, str) else banned
    return [w.strip().lower() for w in words if w.strip()]


def guardrail_check(messages: ColumnLike, banned: str | Sequence[str] = DEFAULT_BANNED) -> Column:
    """struct(blocked, keyword, message): first message, then first keyword, that hits."""
    words = banned_list(banned)
    if not words:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(False).alias("blocked"), none.alias("keyword"), none.alias("message"))
    needles = F.array(*[F.lit(w) for w in words])

    def hits(m):
        text = F.lower(F.coalesce(m["content"], F.lit("")))
        return F.filter(needles, lambda w: F.contains(text, w))

    first = F.get(F.flatten(F.transform(as_col(messages), hits)), F.lit(0))
    note = F.concat(F.lit('Request blocked by guardrails: Banned content detected (keyword: "'), first, F.lit('").'))
    return F.struct(first.isNotNull().alias("blocked"), first.alias("keyword"), note.alias("message"))
