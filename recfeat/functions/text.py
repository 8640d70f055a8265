"""Cleaning, joining and rendering of product and history texts.

Everything that Spark can express is a column expression; emoji names, HTML entities and Unicode
normalisation, for which it has no function, are one Arrow-batched step in front.
"""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import half_even, once

# The characters that cleaning replaces, and what it puts there.
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u275b\u275c"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u275d\u275e"
DASHES = "\u2013\u2014\u2015"
ELLIPSIS = "\u2026"
# A text that ends in one of these needs no semicolon when texts are joined.
SENTENCE_END = "。.;；!?？！"
# What the rendered texts say where something is missing.
NO_HISTORY, NO_REVIEWS, NOT_KNOWN, NO_VARIATION, NO_REVIEW_TEXT = (
    "No browsing history", "No reviews", "N/A", "No price variation", "No review history.",
)
NO_CATEGORY, NO_TITLE, NO_FEATURES, NO_DESCRIPTION = "Unknown category", "No title", "No features.", "No description."

_NATIVE_STEPS = (
    (f"[{SINGLE_QUOTES}]", "'"),
    (f"[{DOUBLE_QUOTES}]", '"'),
    (f"[{DASHES}]", "-"),
    (ELLIPSIS, "..."),
    (r"[\r\n\t]+", " "),
    (r"\p{C}", ""),
    (r"\\([\"'])", "$1"),
    (r"\\", " "),
    (r"[\s\p{Z}]+", " "),
)


def clean_native(text: Column) -> Column:
    """Straight quotes, plain dashes and dots, no control characters or backslashes, single spaces, trimmed."""
    return F.trim(reduce(lambda c, step: F.regexp_replace(c, F.lit(step[0]), F.lit(step[1])), _NATIVE_STEPS, text))


# What the five skin tones, from U+1F3FB on, add to a name.
SKIN_TONES = ("light_skin_tone", "medium_light_skin_tone", "medium_skin_tone", "medium_dark_skin_tone", "dark_skin_tone")

_ONE = r"(?:\p{Emoji_Presentation}|\p{Extended_Pictographic})[\p{Emoji_Modifier}\uFE0F]*"
_EMOJI = regex.compile(rf"\p{{RI}}\p{{RI}}|[0-9#*]\uFE0F?\u20E3|\U0001F3F4[\U000E0020-\U000E007E]+\U000E007F|{_ONE}(?:\u200D{_ONE})*")


def _emoji_name(found) -> str:
    """`` name `` of a whole emoji: joined people and tones, flags and keycaps are one."""
    text = found[0]
    if "\u20e3" in text:
        return f" keycap_{text[0]} "
    if "\U0001f1e6" <= text[0] <= "\U0001f1ff":
        return " flag_" + "".join(chr(ord(c) - 0x1F1E6 + ord("a")) for c in text) + " "
    if text[-1] == "\U000e007f":
        return " flag_" + "".join(chr(ord(c) - 0xE0000) for c in text[1:-1]) + " "
    names = [
        SKIN_TONES[ord(c) - 0x1F3FB] if "\U0001f3fb" <= c <= "\U0001f3ff" else unicodedata.name(c, "emoji").lower().replace(" ", "_")
        for c in text if c not in "\u200d\ufe0f"
    ]
    return f" {'_'.join(names)} "


def _normal(text: str) -> str:
    if text.isascii():
        return html.unescape(text) if "&" in text else text
    return unicodedata.normalize("NFKC", html.unescape(_EMOJI.sub(_emoji_name, text)))


@F.pandas_udf(T.StringType())
def _normal_text(texts: pd.Series) -> pd.Series:
    return texts.map(_normal, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _normal_array(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda a: [None if x is None else _normal(x) for x in a], na_action="ignore")


def clean(text: Column) -> Column:
    """Emoji to their names, entities decoded, NFKC, then ``clean_native``. Null stays null."""
    return clean_native(_normal_text(text))


def clean_array(texts: Column) -> Column:
    """``clean`` for each element; a null array is empty, null elements are dropped."""
    return F.transform(F.filter(F.coalesce(_normal_array(texts), F.array().cast("array<string>")), lambda x: x.isNotNull()), clean_native)


def clean_array_native(texts: Column) -> Column:
    return F.transform(F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: x.isNotNull()), clean_native)


def smart_join(texts: Column) -> Column:
    """Elements trimmed, closed by a semicolon unless a sentence mark closes them, joined by spaces."""
    closed = F.transform(texts, lambda x: F.trim(x))
    return F.array_join(F.transform(closed, lambda x: F.when(x.rlike(f"[{SENTENCE_END}]$"), x).otherwise(F.concat(x, F.lit(";")))), " ")


def fixed(number: Column, digits: int) -> Column:
    """A number with so many decimals, half to even."""
    return F.format_string(f"%.{digits}f", half_even(number, digits))


def user_text(feat: Column, clean_texts=clean_array_native) -> Column:
    """The user's side of a sample, from the ``user_feat`` struct.

    Shares of zero are left out. A past review shows its text, else its title, else nothing.
    """
    shares = F.map_entries(F.map_filter(F.coalesce(feat["cat_hist"], F.create_map().cast("map<string,double>")), lambda k, v: v > 0))
    percent = lambda x: half_even(x * 100, 0).cast("long").cast("string")
    named = lambda s: F.array_join(F.transform(s, lambda e: F.concat(e["key"], F.lit(": "), percent(e["value"]), F.lit("%"))), "; ")
    categories = once(shares, lambda s: F.when(F.size(s) > 0, named(s)).otherwise(NO_HISTORY))
    pieces = F.transform(
        F.coalesce(feat["history"], F.array().cast("array<struct<title:string,text:string>>")),
        lambda h: F.coalesce(F.nullif(h["text"], F.lit("")), h["title"], F.lit("")),
    )
    pieces = clean_texts(F.filter(pieces, lambda p: p != ""))
    numbered = lambda all_: F.transform(all_, lambda p, i: F.concat(F.lit("Review"), (i + 1).cast("string"), F.lit(": "), p))
    reviews = once(pieces, lambda all_: F.when(F.size(all_) > 0, smart_join(numbered(all_))).otherwise(NO_REVIEW_TEXT))
    count, mean, std = feat["review_cnt"], feat["price_mean"], feat["price_std"]
    # fixed values: the labels of the sections, here and in ``item_text``
    return F.concat(
        F.lit("Category history: "), categories,
        F.lit(". Total reviews: "), F.when(count > 0, count.cast("string")).otherwise(NO_REVIEWS),
        F.lit(". Avg price: "), F.when(mean.isNotNull(), fixed(mean, 2)).otherwise(NOT_KNOWN),
        F.lit(". Price std: "), F.when(std > 0, fixed(std, 2)).otherwise(NO_VARIATION),
        F.lit(". Review history: "), reviews,
    )


def item_text(category: Column, title: Column, price: Column, features: Column, description: Column, clean_texts=clean_array_native) -> Column:
    """The item's side of a sample. An empty category or title counts as missing."""
    features, description = clean_texts(features), clean_texts(description)
    return F.concat(
        F.lit("Item category: "), F.coalesce(F.nullif(category, F.lit("")), F.lit(NO_CATEGORY)),
        F.lit(". Item title: "), F.coalesce(F.nullif(title, F.lit("")), F.lit(NO_TITLE)),
        F.lit(". Item price: "), F.when(price.isNotNull(), fixed(price, 2)).otherwise(NOT_KNOWN),
        F.lit(". Item features: "), F.when(F.size(features) > 0, smart_join(features)).otherwise(NO_FEATURES),
        F.lit(" Item description: "), F.when(F.size(description) > 0, smart_join(description)).otherwise(NO_DESCRIPTION),
    )


def sentences(text: Column) -> Column:
    """Sentences of a text, split after terminators (CJK ones too); null and blank give none."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?]+)\s+|([。！？]+)\s*|\s*\n\s*", "$1$2\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda s: s != "")
