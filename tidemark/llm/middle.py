"""Fill-in-the-middle rewriting: a text is cut at two unit ends and its middle is moved to the end.

Units are runs of letters or single other characters. One pass of the regex library collects where they
end in a compact array; the two cuts are look-ups in it. Cuts, form and order follow from a digest
of seed and doc_id alone, so any worker, and any repeated attempt, gives the same output.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points: four bytes a unit."""
    return array("I", (m.end() for m in _UNIT.finditer(text)))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the digest of ``seed:doc_id``; a row without doc_id has nothing after the colon."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4]) for k in range(0, 16, 4))


def rearrange(text: str, doc_id: int | None, seed: int = 1, plain: int = 90, spm: int = 20) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= plain:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``rearrange`` was given. No mark ends as another one begins, so the first of each is the one put there."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.index(second, len(first))
    last = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : last], output[last + len(MIDDLE) :]
    return two + middle + one if form == "spm" else one + middle + two


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 90, spm: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, output_sha256`` of each row of ``docs(doc_id, text, ...)``.

    ``n`` counts units; of 100 texts about ``plain`` are rearranged, of those ``spm`` put the suffix first.
    Form is plain, and the output the text itself, for empty texts and such that hold a mark. Defined
    cases: null counts as empty; a null doc_id draws as an empty one; repeated rows each get their
    row, the same for the same doc_id and text; an empty table gives none; other columns are ignored.
    """

    @pandas_udf(_FIELDS)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for i, text in zip(ids, texts):
            found = rearrange(text or "", int(i) if i else None, seed, plain, spm)
            rows.append((*found, _sha256(found[-1])))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in _FIELDS.split(", ")])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    # the id goes as text: pandas would turn a column of integers with nulls into floats
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.select("doc_id", cut(F.col("doc_id").cast("string"), "text").alias("f"))
    return found.select("doc_id", "f.*")


@pandas_udf(StringType())
def restored(outputs: pd.Series, forms: pd.Series) -> pd.Series:
    """Texts rebuilt from output and form."""
    return pd.Series([None if o is None or f is None else restore(o, f) for o, f in zip(outputs, forms)], dtype=object)


@pandas_udf(StringType())
def _restored_sha256(outputs: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([_sha256(restore(o, f)) for o, f in zip(outputs, forms)], dtype=object)


def middle_digests(docs: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with digests in place of texts, and that of the text rebuilt from each output."""
    found = fill_in_middle(docs).withColumn("restored_sha256", _restored_sha256("output", "form"))
    return found.drop("output")


#: From the definition: units as a list, cuts as sums of their lengths; what is rebuilt must be the text itself.
ORACLE_SQL = """
with units as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
    sha256('1:' || coalesce(doc_id::varchar, '')) as h
  from documents
), drawn as (
  select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from units
), cuts as (
  select *, coalesce(list_sum(list_transform(u[1:least(h1 % (n + 1), h2 % (n + 1))], lambda x: length(x))), 0)::bigint as a,
    coalesce(list_sum(list_transform(u[1:greatest(h1 % (n + 1), h2 % (n + 1))], lambda x: length(x))), 0)::bigint as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    else '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) end) as output_sha256,
  sha256(t) as restored_sha256
from cuts
"""
