"""Scalar functions over columns: identifiers, keys, digests, and formulas of pipes and pumps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed limits of stored names.
SLUG_LENGTH, NAMES_LENGTH = 40, 254


def abbreviation(text: Column, n: int = 3) -> Column:
    """Capitals of ``n`` letters: the start of one word, or the initials of several, filled up with X."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    one = F.upper(F.substring(F.get(words, F.lit(0)), 1, n))
    return F.when(F.size(words) == 0, F.lit("X" * n)).when(F.size(words) == 1, one).otherwise(F.rpad(F.upper(F.substring(initials, 1, n)), n, "X"))


def id_prefix(pattern: str, network: Column, name: Column, group: Column, kind: Column) -> Column:
    """What a pattern of {NET} {CLASS} {GROUP} {TYPE} {N} puts ahead of the number."""
    out = F.lit(pattern)
    for mark, value in (("{NET}", network), ("{CLASS}", name), ("{GROUP}", group), ("{TYPE}", kind)):
        out = F.replace(out, F.lit(mark), abbreviation(value))
    return F.split_part(out, F.lit("{N}"), F.lit(1))


def word_tokens(text: Column) -> Column:
    """Distinct lower-case words of Latin letters, digits or Arabic letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z\\u0600-\\u06ff0-9]+)"), F.lit(1)))


def slug(text: Column) -> Column:
    """Lower-case name of letters, digits and underscores."""
    flat = F.regexp_replace(F.trim(text), "[^A-Za-z0-9_]+", "_")
    return F.substring(F.lower(F.regexp_replace(flat, "^_+|_+$", "")), 1, SLUG_LENGTH)


def feature_key(name: Column, fid: Column) -> Column:
    return F.concat_ws(":", name, fid)


def split_key(text: Column) -> Column:
    """Struct ``name, fid`` of a key, split at its last colon; null where that isn't followed by a number."""
    name, fid = F.regexp_extract(text, "^(.*):(-?\\d+)$", 1), F.regexp_extract(text, "^(.*):(-?\\d+)$", 2)
    return F.when(fid != "", F.struct(name.alias("name"), fid.cast("long").alias("fid")))


def field_hashes(fields: Sequence[str], digits: int = 10) -> Column:
    """Map of each field that isn't null to the start of its digest."""
    each = F.array(*[F.struct(F.lit(f).alias("k"), F.substring(F.sha1(F.col(f).cast("string").cast("binary")), 1, digits).alias("v")) for f in fields])
    return F.map_from_entries(F.filter(each, lambda x: x["v"].isNotNull()))


def joined_names(names: Column) -> Column:
    """Sorted distinct names joined by semicolons, cut to what the field holds."""
    return F.substring(F.array_join(F.array_sort(F.array_distinct(names)), ";"), 1, NAMES_LENGTH)


def pump_head(flow: Column, design_head: Column, design_flow: Column) -> Column:
    """One-point pump curve."""
    return 4 / F.lit(3.0) * design_head - design_head / 3 * F.pow(flow / design_flow, 2)


def friction_factor(reynolds: Column, roughness: Column) -> Column:
    """Darcy friction of rough pipes (relative roughness): laminar below 2000, else by Swamee and Jain."""
    re = F.greatest(reynolds.cast("double"), F.lit(1.0))
    turbulent = 0.25 / F.pow(F.log10(roughness / 3.7 + 5.74 / F.pow(re, 0.9)), 2)
    return F.when(re < 2000, 64 / re).otherwise(turbulent)


def fire_flow(flow: Column, static: Column, residual: Column, least: Column) -> Column:
    """Flow that a hydrant gives at pressure ``least``: none if that is above the static one, unknown without a pressure drop."""
    drop = static - residual
    return F.when(static <= least, F.lit(0.0)).when(drop <= 1e-6, F.lit(None)).otherwise(flow * F.pow((static - least) / drop, 0.54))


@F.pandas_udf(T.DoubleType())
def name_score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How alike two names are, 0 to 1: by their longest common blocks, or by the words of the second that the first has.

    Spark has no function for common blocks. Meant for distinct values, of which there are few.
    """
    import difflib
    import re

    words = lambda t: set(re.findall(r"[a-z؀-ۿ0-9]+", t))
    for values, names in parts:
        out = []
        for a, b in zip(values.fillna("").str.lower(), names.fillna("").str.lower(), strict=True):
            common = len(words(a) & words(b)) / max(len(words(b)), 1)
            out.append(max(difflib.SequenceMatcher(None, a, b).ratio(), common))
        yield pd.Series(out, dtype="float64")
