"""Requests matched with a table of templates, as large as it may be, by equal keys alone.

A path has a template when it equals it, when it does so without its query, or when it has as many segments, the same
literal ones, and text in place of the others: ``*`` and ``{parameter}`` stand for any text without a slash. Which
segments are literal is the template's signature. There are few signatures for a method and length, so a path is cut down to
the literal segments of each of them, and what is left meets the templates in an equi-join: neither
a chain of conditions nor a comparison of each path with each template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signatures are broadcast up to this many rows (a method, a length and its masks), beyond it they are shuffled.
MOST_SIGNATURES = 100_000
UNTRACKED = "UNTRACKED"
_OPEN = r"(\*|\{[^}]+\})"


def _segments(path: Column) -> Column:
    return F.split(path, "/", -1)


def _literal_key(segments: Column, mask: Column) -> Column:
    """The segments that a mask of 0 and 1 marks as literal."""
    return F.array_join(F.filter(segments, lambda s, i: F.substring(mask, i + 1, F.lit(1)) == "1"), "/")


def _quoted(text: Column) -> Column:
    """A template as a regular expression: open parts any text without a slash, all else as it is."""
    return F.concat(F.lit("^\\Q"), F.regexp_replace(text, _OPEN, r"\\E[^/]+\\Q"), F.lit("\\E$"))


def match_templates(requests: DataFrame, templates: DataFrame, method: str = "method", path: str = "path") -> DataFrame:
    """``requests`` with ``template``: the first of ``templates(position, method, template)`` that fits, else ``UNTRACKED``.

    A template equal to the path comes first, then one equal to the path without its query, then open ones; among
    these the least position. Methods are compared without regard to case; a request without method or
    path is untracked. Each different request is matched once.
    """
    t = templates.select(F.col("position").alias("_position"), F.upper("method").alias("_method"), F.col("template").alias("_template")).where("_method is not null and _template is not null")
    t = t.withColumn("_parts", _segments(F.col("_template"))).withColumn("_n", F.size("_parts"))
    mask = F.array_join(F.transform("_parts", lambda s: F.when(s.rlike(_OPEN), "0").otherwise("1")), "")
    open_ = t.withColumn("_mask", mask).where(F.contains("_mask", F.lit("0"))).withColumn("_key", _literal_key(F.col("_parts"), F.col("_mask")))
    # where an open segment is more than one open part, what stands around it has to be looked at
    partial = F.exists("_parts", lambda s: s.rlike(_OPEN) & ~s.rlike(f"^{_OPEN}$"))
    open_ = open_.select("_method", F.lit(2).alias("_rank"), "_n", "_mask", "_key", "_position", "_template", F.when(partial, _quoted(F.col("_template"))).alias("_pattern"))
    same = t.select("_method", "_n", "_position", "_template")
    exact = [same.select("_method", F.lit(r).alias("_rank"), "_n", F.lit("").alias("_mask"), F.col("_template").alias("_key"), "_position", "_template", F.lit(None).cast("string").alias("_pattern")) for r in (0, 1)]
    keyed = exact[0].unionByName(exact[1]).unionByName(open_)

    signatures = open_.groupBy("_method", "_n").agg(F.sort_array(F.collect_set("_mask")).alias("_masks"))
    if signatures.limit(MOST_SIGNATURES + 1).count() <= MOST_SIGNATURES:
        signatures = F.broadcast(signatures)
    each = requests.select(F.upper(method).alias("_method"), F.col(path).alias("_path")).where("_method is not null and _path is not null").distinct()
    bare = F.split_part("_path", F.lit("?"), F.lit(1))
    each = each.withColumn("_bare", bare).withColumn("_parts", _segments(F.col("_bare"))).withColumn("_n", F.size("_parts")).join(signatures, ["_method", "_n"], "left")

    def key(rank: Column, n: Column, mask: Column, text: Column) -> Column:
        return F.struct(rank.alias("_rank"), n.alias("_n"), mask.alias("_mask"), text.alias("_key"))

    looked = F.concat(
        F.array(key(F.lit(0), F.size(_segments(F.col("_path"))), F.lit(""), F.col("_path")), key(F.lit(1), F.col("_n"), F.lit(""), F.col("_bare"))),
        F.transform(F.coalesce("_masks", F.array().cast("array<string>")), lambda m: key(F.lit(2), F.col("_n"), m, _literal_key(F.col("_parts"), m))),
    )
    met = each.select("_method", "_path", "_bare", "_parts", F.explode(looked).alias("k")).select("_method", "_path", "_bare", "_parts", "k.*").join(keyed, ["_method", "_rank", "_n", "_mask", "_key"])
    filled = ~F.exists(F.zip_with("_parts", F.split("_mask", ""), lambda s, m: (m == "0") & (s == "")), lambda x: F.coalesce(x, F.lit(False)))
    fits = (F.col("_rank") < 2) | F.coalesce(F.rlike("_bare", F.col("_pattern")), filled)
    best = met.where(fits).groupBy("_method", "_path").agg(F.min_by("_template", F.struct("_rank", "_position")).alias("_found"))
    asked = requests.withColumns({"_method": F.upper(method), "_path": F.col(path)})
    return asked.join(best, ["_method", "_path"], "left").withColumn("template", F.coalesce("_found", F.lit(UNTRACKED))).drop("_method", "_path", "_found")
