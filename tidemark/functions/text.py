"""Text functions on columns: label repair, comparison keys, keyword tests, fallbacks and JSON fields."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folds() -> dict[str, str]:
    """Letters below U+2000 that canonically decompose into one character and marks, with that character."""
    out = {"\u2019": "'"}
    for code in range(0xC0, 0x2000):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.category(m)[0] == "M" for m in marks):
            out[chr(code)] = base
    return out


FOLDS = _folds()
# What makes an action count as a download in the live counters.
DOWNLOAD_HINTS = ("download", "telecharg", "téléchar", "document", "certificat", "decompte", "wallet", "file")
# Routes and the families they belong to.
ROUTE_FAMILIES = {
    "login": "auth", "logout": "auth", "documents": "documents", "refunds": "insured", "home": "home", "bankinginformation": "bankinginformation", "address": "insured", "file": "documents",
}


#: Blanks and control characters.
TRIMMED = "".join(map(chr, range(0x21)))
#: Signs of UTF-8 that was read as Latin-1.
MISREAD = "[ÃÂ\ufffd]"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_text(*columns: Column | str) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(blank_to_null(F.col(c) if isinstance(c, str) else c) for c in columns))


def _trimmed(c: Column) -> Column:
    """Without blanks and control characters at both ends."""
    return F.btrim(c, F.lit(TRIMMED))


def normalize_label(c: Column) -> Column:
    """Trimmed; text that was read as Latin-1 though it was UTF-8 is repaired, up to three times.

    What Latin-1 lacks becomes a question mark, bytes that are no UTF-8 become U+FFFD.
    """

    def mended(x: Column, _: Column) -> Column:
        as_bytes = F.encode(F.regexp_replace(x, "[^\u0000-\u00ff]", "?"), "ISO-8859-1")
        return F.when(x.rlike(MISREAD), _trimmed(F.make_valid_utf8(as_bytes.cast("string")))).otherwise(x)

    # the fold binds each pass once, so the expression does not grow with the passes
    three = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), _trimmed(c), mended)
    return F.when(c.rlike(MISREAD), three).otherwise(_trimmed(c))


def comparison_key(c: Column) -> Column:
    """Repaired, without accents, lower case, trimmed; null gives the empty key."""
    plain = F.translate(normalize_label(c), "".join(FOLDS), "".join(FOLDS.values()))
    return F.coalesce(F.trim(F.lower(F.regexp_replace(plain, "\\p{M}", ""))), F.lit(""))


def equals_normalized(a: Column, b: Column) -> Column:
    return comparison_key(a) == comparison_key(b)


def python_key(text: str | None) -> str:
    """``comparison_key`` of a literal."""
    t = (text or "").strip(TRIMMED)
    for _ in range(3):
        if any(x in t for x in "ÃÂ\ufffd"):
            t = t.encode("latin-1", "replace").decode("utf-8", "replace").strip(TRIMMED)
    t = t.translate(str.maketrans(FOLDS))
    return "".join(x for x in t if unicodedata.category(x)[0] != "M").lower().strip()


def key_is_one_of(key: Column, labels: Iterable[str]) -> Column:
    """``is_one_of`` of a column that holds comparison keys already."""
    return key.isin(sorted({python_key(x) for x in labels}))


def is_one_of(c: Column, labels: Iterable[str]) -> Column:
    """Whether the column equals one of the labels, accents and case aside."""
    return key_is_one_of(comparison_key(c), labels)


def has_download_word(c: Column, words: Iterable[str]) -> Column:
    key = comparison_key(c)
    found = F.lit(False)
    for w in words:
        found = found | F.contains(key, F.lit(w))
    return F.coalesce(found, F.lit(False))


def has_download_hint(flag: Column, action: Column, hints: Iterable[str] = DOWNLOAD_HINTS) -> Column:
    """The counters' own test: a flag, or a hint in the lower-cased action as it is spelled."""
    low, found = F.lower(action), F.coalesce(flag == 1, F.lit(False))
    for h in hints:
        found = found | F.coalesce(F.contains(low, F.lit(h)), F.lit(False))
    return found


def normalize_status(c: Column) -> Column:
    """Synonyms of both outcomes; anything else as it is."""
    up = F.upper(F.trim(c))
    return F.when(up.isin("OK", "SUCCESS", "PENDING"), "OK").when(up.isin("KO", "FAILURE", "FAILED", "ERROR"), "KO").otherwise(c)


def status_of_http(code: Column) -> Column:
    return F.when(code.between(200, 299) | (code == 304), "SUCCESS").otherwise("FAILURE")


def path_family(path: Column) -> Column:
    """The first part of a path that is no version, lower case, dashes as underscores."""
    parts = F.filter(F.split(F.split_part(path, F.lit("?"), F.lit(1)), "/"), lambda x: (x != "") & ~x.rlike("^v[12]$"))
    return F.replace(F.lower(F.try_element_at(parts, F.lit(1))), F.lit("-"), F.lit("_"))


def api_family(c: Column) -> Column:
    """Lower case; nothing for placeholders; the first part of a path."""
    t = F.lower(F.trim(c))
    named = F.when(~t.isin("", "unknown", "n/a"), t)
    return F.when(named.startswith("/"), F.try_element_at(F.filter(F.split(named, "/"), lambda x: x != ""), F.lit(1))).otherwise(named)


def route_family(route: Column, families: dict[str, str] = ROUTE_FAMILIES) -> Column:
    """The family of a route's name, blanks around it and case aside; null for others."""
    pairs = [F.lit(x) for kv in families.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(route)))


def json_text(payload: Column, *paths: str) -> Column:
    """The first path that holds text."""
    return first_text(*(F.get_json_object(payload, p) for p in paths))


def event_key(id_: Column, *parts: Column) -> Column:
    """The id, or else a hash of the parts, nulls as empty text."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.coalesce(blank_to_null(id_.cast("string")), F.sha2(joined, 256))


def evidence_hash(payload: Column) -> Column:
    """Content hash of a payload struct, as the evidence store keys it."""
    return F.sha2(F.to_json(payload), 256)


def evidence_summary(score: Column, level: Column, kind: Column, fallback: Column) -> Column:
    show = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat(F.lit("risk="), show(score), F.lit("; level="), show(level), F.lit("; type="), show(kind), F.lit("; fallback="), show(fallback))


def template_of(method: Column, path: Column, templates: Iterable[tuple[str, str]], untracked: str = "UNTRACKED") -> Column:
    """The template of a request: the path itself, then the path without its query, then the first template of the method
    whose ``*`` and ``{parameter}`` parts, any text without a slash, fit. ``templates``: method and template, few and typed by the caller;
    for a table of them see ``operators.requests``."""
    few = list(templates)
    bare = F.split_part(path, F.lit("?"), F.lit(1))
    same = lambda p, t: (F.upper(method) == t[0].upper()) & (p == t[1])
    out = None
    tests = [(same(path, t), t[1]) for t in few] + [(same(bare, t), t[1]) for t in few]
    for kind, template in few:
        parts = re.split(r"(\*|\{[^{}/]*\})", template)
        pattern = "".join("[^/]+" if k % 2 else re.escape(x) for k, x in enumerate(parts))
        if len(parts) > 1:
            tests.append(((F.upper(method) == kind.upper()) & bare.rlike(f"^{pattern}$"), template))
    for test, template in tests:
        out = F.when(test, template) if out is None else out.when(test, template)
    return F.lit(untracked) if out is None else out.otherwise(untracked)
