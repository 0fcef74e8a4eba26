"""Question scalar functions (F19-F22): barcode and quoted-text extraction,
intent detection and the deduced product reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nutrilake.operators.lookup import additive_code

# Intent keywords in rule order (first match wins).
INTENT_RULES = [
    ("additif", ["additif"]),
    ("similarite", ["similaire", "mieux not"]),
    ("categorie", ["catégorie", "categorie"]),
    ("origine", ["pays", "origine"]),
    ("coherence", ["cohérent", "coherent"]),
    ("estimer_nutriscore", ["nutri-score", "nutriscore"]),
]
DEFAULT_INTENT = "rag"


def extract_barcode(question: Column, barcode: Column | None = None) -> Column:
    """given barcode (trimmed) when non-empty, else the first run of
    8-14 digits standing as a word in the question."""
    found = F.regexp_extract(question, r"\b([0-9]{8,14})\b", 1)
    from_text = F.when(found != "", found)
    if barcode is None:
        return from_text
    return F.when(barcode.isNotNull() & (barcode != ""), F.trim(barcode)).otherwise(from_text)


def quoted_texts(question: Column) -> Column:
    """every ``"..."`` of the question, in order."""
    return F.regexp_extract_all(question, F.lit('"([^"]+)"'), 1)


def detect_intent(question: Column) -> Column:
    """ordered keyword rules on the lower-cased question; an additive
    code anywhere also means ``additif``."""
    q = F.lower(question)
    out = F.when(additive_code(question).isNotNull(), F.lit("additif"))
    for intent, words in INTENT_RULES:
        cond = None
        for w in words:
            c = q.contains(w)
            cond = c if cond is None else (cond | c)
        out = out.when(cond, F.lit(intent))
    return out.otherwise(F.lit(DEFAULT_INTENT))


def deduced_reference(question: Column, hint: Column, barcode: Column) -> Column:
    """first non-blank of barcode, hint, barcode found in the text; '' if none."""
    def nb(c: Column) -> Column:
        t = F.trim(c)
        return F.when(t != "", t)
    return F.coalesce(nb(barcode), nb(hint), nb(extract_barcode(question)), F.lit(""))
