"""Explicit schemas of all records; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _LONG, _NUMBER, _FLAG = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_TEXTS = T.ArrayType(_TEXT)


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


IMAGE = _record(variant=_TEXT, hi_res=_TEXT, large=_TEXT, thumb=_TEXT)

RAW_META = _record(
    parent_asin=_TEXT, asin=_TEXT, main_category=_TEXT, title=_TEXT, average_rating=_NUMBER, rating_number=_LONG, price=_TEXT, store=_TEXT,
    features=_TEXTS, description=_TEXT, details=_TEXT, images=_TEXT, bought_together=_TEXT, categories=_TEXTS,
)
"""Fields whose type varies in the landed files (price, description, details, images) are read as raw JSON text."""

META = _record(
    parent_asin=_TEXT, asin=_TEXT, main_category=_TEXT, title=_TEXT, average_rating=_NUMBER, rating_number=_LONG, price=_NUMBER, store=_TEXT,
    features=_TEXTS, description=_TEXTS, details=T.MapType(_TEXT, _TEXT), images=T.ArrayType(IMAGE), bought_together=_TEXT, categories=_TEXTS,
)

RAW_REVIEW = _record(
    user_id=_TEXT, asin=_TEXT, parent_asin=_TEXT, rating=_NUMBER, title=_TEXT, text=_TEXT, timestamp=_LONG, verified_purchase=_FLAG, helpful_vote=_LONG
)

REVIEW = _record(
    user_id=_TEXT, asin=_TEXT, parent_asin=_TEXT, rating=_NUMBER, title=_TEXT, text=_TEXT, sort_timestamp=_LONG, verified_purchase=_FLAG, helpful_votes=_LONG
)

HISTORY = T.ArrayType(_record(title=_TEXT, text=_TEXT))

USER_FEAT = _record(cat_hist=T.MapType(_TEXT, _NUMBER), review_cnt=_LONG, price_mean=_NUMBER, price_std=_NUMBER, history=HISTORY)

SAMPLE = _record(
    key=_TEXT, user_text=_TEXT, item_text=_TEXT, patch=T.BinaryType(), shape=T.ArrayType(T.IntegerType()), has_image=T.IntegerType(),
    label_good=T.IntegerType(), label_best=T.IntegerType(),
)
