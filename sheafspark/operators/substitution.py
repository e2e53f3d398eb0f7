"""Texts rewritten by position: replacements outside formulas, formulas put into texts, runs cut at formulas, pictures replaced by their texts.

Formulas stand between the marks of EQUATION; what lies between a pair of marks on one
line is a formula. All of it is column expressions and joins.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands before and after a formula.
EQUATION = ("<eq>", "</eq>")
#: Stands between the parts of a text while it is cut; no text of Unicode has it.
_CUT = "\uffff"
#: References to one uri that meet its text in one task, about.
REFERENCES = 100_000
_FORMULA = f"({EQUATION[0]}[^\\n]*?{EQUATION[1]})"


def parts(text: Column) -> Column:
    """text cut before and after each formula: stretches without formulas at even places (from 0), formulas at odd ones."""
    return F.split(F.regexp_replace(text, _FORMULA, f"{_CUT}$1{_CUT}"), _CUT)


def plain_parts(text: Column) -> Column:
    """The stretches without formulas."""
    return F.filter(parts(text), lambda _, i: i % 2 == 0)


def replace_outside(text: Column, old: Column, new: Column) -> Column:
    """text with the first old in each stretch without formulas replaced; an empty old is found nowhere."""
    at = lambda p: F.position(old, p)

    def one(p: Column, i: Column) -> Column:
        changed = F.concat(F.substring(p, F.lit(1), at(p) - 1), new, F.substring(p, at(p) + F.length(old), F.length(p)))
        return F.when((i % 2 == 0) & (F.length(old) > 0) & (at(p) > 0), changed).otherwise(p)

    return F.array_join(F.transform(parts(text), one), "")


def _locate(needle: Column, text: Column, start: Column) -> Column:
    """The place (from 1) of needle in text at ``start`` (from 1) or after; 0 for none."""
    at = F.position(needle, F.substring(text, start, F.length(text)))
    return F.when(at > 0, at + start - 1).otherwise(0)


def merge_formulas(text: Column, pieces: Column) -> Column:
    """text with the formulas among ``pieces`` (structs of content and is_formula, in order) put where they stand between the others; where these don't make up the text, white space aside, it stays as it is, as it does without a formula."""
    tight = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    same = tight(F.array_join(F.transform(F.filter(pieces, lambda p: ~p["is_formula"]), lambda p: p["content"]), "")) == tight(text)
    start = F.struct(text.alias("out"), F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        own, at = p["content"], s["at"]
        found = _locate(own, s["out"], at + 1)
        size = F.length(own)
        put = F.concat(F.substring(s["out"], F.lit(1), at), own, F.substring(s["out"], at + 1, F.length(s["out"])))
        moved = F.when(size == 0, s["out"]).when(found > 0, s["out"]).when(s["n"] > 0, put).otherwise(F.concat(own, s["out"]))
        place = F.when(size == 0, at).when(found > 0, found - 1 + size).when(s["n"] > 0, at + size).otherwise(at)
        return F.struct(moved.alias("out"), place.cast("int").alias("at"), (s["n"] + 1).alias("n"))

    merged = F.aggregate(pieces, start, step, lambda s: s["out"])
    return F.when(F.coalesce(F.exists(pieces, lambda p: p["is_formula"]), F.lit(False)) & same, merged).otherwise(text)


def split_runs(runs: DataFrame, texts: DataFrame, keys: list[str], order: str, run: str, text: str) -> DataFrame:
    """runs (several a paragraph, in order) cut where a formula of their paragraph's text stands, with fragment (from 0): no run then crosses one. A paragraph whose runs don't make up its text without formulas keeps them; an empty run stays one.

    Where runs begin is a running sum; which cuts fall into a run is asked of the paragraph's list of cuts.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    own = runs.withColumn("_end", F.sum(F.length(run)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_start", F.col("_end") - F.length(run))
    plain = plain_parts(F.col(text))
    # running sums of the stretches' lengths, the last left out
    cuts = F.slice(F.aggregate(plain, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p)))), F.lit(2), F.greatest(F.size(plain) - 1, F.lit(0)))
    whole = runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, run))), lambda r: r[run]), "").alias("_all"))
    marks = texts.select(*keys, F.array_distinct(cuts).alias("_cuts"), F.array_join(plain, "").alias("_plain")).join(whole, keys).select(*keys, F.when(F.col("_all") == F.col("_plain"), F.col("_cuts")).alias("_cuts"))
    rows = own.join(marks, keys, "left")
    inner = F.transform(F.filter("_cuts", lambda b: (b > F.col("_start")) & (b < F.col("_end"))), lambda b: (b - F.col("_start")).cast("int"))
    edges = F.concat(F.array(F.lit(0)), F.coalesce(inner, F.array().cast("array<int>")), F.array(F.length(run)))
    pieces = F.transform(F.sequence(F.lit(1), F.size("_edges") - 1), lambda i: F.substring(F.col(run), F.get("_edges", i - 1) + 1, F.get("_edges", i) - F.get("_edges", i - 1)))
    rows = rows.withColumn("_edges", edges).withColumn("_pieces", pieces)
    return rows.select(*[c for c in runs.columns if c != run], F.posexplode("_pieces").alias("fragment", run))


def replace_pictures(contents: DataFrame, found: DataFrame, keys: list[str], content: str, uri: str, text: str) -> DataFrame:
    """contents with each picture reference that ``found`` (uri and text) knows replaced by its text, a null one by nothing; others stay.

    What a text brings in is never searched again. ``found`` has a row for each uri; of several the greatest text counts.
    Only a content's distinct references meet ``found``, those of a uri with many contents in parts of about REFERENCES; what
    they lead to comes back as a map of the content, in which each of its references is looked up (along the map: a content's
    references times its distinct ones).
    """
    mark = r"(!\[\]\([^()\s]*\))"
    pieces = F.split(F.regexp_replace(content, mark, f"{_CUT}$1{_CUT}"), _CUT)
    uri_of = lambda p: F.substring(p, F.lit(5), F.length(p) - 5)
    own = F.array_distinct(F.transform(F.filter(pieces, lambda _, i: i % 2 == 1), uri_of))
    asked = contents.select(*keys, F.explode(own).alias("_uri"))
    parts_of = asked.groupBy("_uri").agg(F.ceil(F.count("*") / REFERENCES).alias("_parts"))
    known = parts_of.join(found.groupBy(F.col(uri).alias("_uri")).agg(F.max(text).alias("_t")), "_uri").select("_uri", F.coalesce("_t", F.lit("")).alias("_t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    # uris in several parts are few: each has REFERENCES of the rows
    part = F.coalesce(F.pmod(F.xxhash64(*keys), F.col("_parts")), F.lit(0))
    asked = asked.join(F.broadcast(parts_of.filter("_parts > 1")), "_uri", "left").select(*keys, "_uri", part.alias("_part"))
    texts = asked.join(known, ["_uri", "_part"]).groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.map_from_entries(F.collect_set(F.struct("_uri", "_t"))).alias("_texts"))
    same = reduce(and_, [F.equal_null(F.col(k), F.col(f"_key{i}")) for i, k in enumerate(keys)])
    put = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.element_at("_texts", uri_of(p)), p)).otherwise(p))
    return contents.join(texts, same, "left").select(*keys, *[c for c in contents.columns if c not in (*keys, content)], F.array_join(put, "").alias(content))
