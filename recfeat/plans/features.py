"""Queries of the feature pipeline: join, sampling, profile, negatives, split, texts, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import assemble, enrich, evaluate, negatives, profile, split
from ..sources import ingest
from ..tables import as_bucketed, as_table, lean
from . import adapters as a

SEED = 7
PROFILED = ("price_cents", "main_category", "review_title", "review_text")
"""What a whole profile is made from."""


def enrich_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.positives(spark, sf_dir)
    return rows.select(
        "user_id", "parent_asin", "row_key", "main_category", "product_title", "price_cents", ingest.main_image("images").alias("url"),
        "sort_timestamp", "event_date", "rating", "label_good", "label_best", "is_neg",
    )


ENRICH_SQL = f"""with {a.POSITIVES_SQL}
select user_id, parent_asin, row_key, main_category, product_title, price_cents, url, sort_timestamp, event_date, rating, label_good, label_best, 0 as is_neg
from positives"""


def downsample_five_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.thin_top_ratings(a.reviews(spark, sf_dir), "row_key", seed=SEED).select("user_id", "row_key", "rating")


DOWNSAMPLE_SQL = f"""with {a.REVIEWS_SQL}
select user_id, row_key, rating from reviews
where rating is not null and (rating <> 5 or ('0x' || substr(md5(concat_ws('|', row_key, '{SEED}')), 1, 8))::ubigint / 4294967296.0 < 0.2)"""


def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric_profile(a.ordered(spark, sf_dir, "row_key", "price_cents")).select("user_id", "row_key", "review_cnt", "price_mean", "price_std")


PROFILE_NUMERIC_SQL = f"""with {a.ORDERED_SQL}, w as (
    select user_id, row_key, pos - 1 as review_cnt, cast(count(price_cents) over past as double) n, cast(coalesce(sum(price_cents::hugeint) over past, 0) as double) s,
           cast(coalesce(sum(price_cents::hugeint * price_cents) over past, 0) as double) q
    from ordered window past as (partition by user_id order by pos rows between unbounded preceding and 1 preceding))
select user_id, row_key, review_cnt, case when n > 0 then round_even(s / n / 100, 4) end price_mean,
       case when n > 1 then round_even(sqrt(greatest(0.0, n * q - s * s) / (n * (n - 1))) / 100, 4) else 0.0 end price_std
from w"""


def profile_cat_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.category_shares(a.ordered(spark, sf_dir, "main_category")).where("pos > 1")
    return rows.select("user_id", F.col("pos").cast("long").alias("pos"), _shares_text(F.col("shares"), "category", "share").alias("cat_hist"))


def _shares_text(entries, name: str, value: str):
    """``name:0.1234`` of each entry; values have four decimals at most, so whole ten-thousandths are exact, and far cheaper than a format."""
    parts = F.transform(entries, lambda e: F.struct(e[name].alias("name"), F.rint(e[value] * 10_000).cast("long").alias("n")))
    digits = lambda n: F.concat(F.floor(n / 10_000).cast("string"), F.lit("."), F.lpad((n % 10_000).cast("string"), 4, "0"))
    return F.array_join(F.transform(parts, lambda e: F.concat_ws(":", e["name"], digits(e["n"]))), ";")


PROFILE_CAT_HIST_SQL = f"""with {a.ORDERED_SQL}, o as (select user_id, pos, coalesce(nullif(main_category, ''), 'UNK') own from ordered),
seen as (select user_id, own as category, min(pos) first_pos from o group by 1, 2),
met as (select o.user_id, o.pos, s.first_pos, s.category,
               sum(cast(o.own = s.category as int)) over (partition by o.user_id, s.category order by o.pos rows between unbounded preceding and 1 preceding) cnt
        from o join seen s on o.user_id = s.user_id)
select user_id, pos, string_agg(category || ':' || printf('%.4f', round_even(cnt / (pos - 1), 4)), ';' order by first_pos) cat_hist
from met where first_pos < pos group by user_id, pos"""


def profile_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.history(a.ordered(spark, sf_dir, "row_key", "review_title", "review_text"))
    joined = F.array_join(F.transform("history", lambda h: F.concat_ws("/", h["title"], h["text"])), ";")
    return rows.select("user_id", "row_key", joined.alias("history"))


PROFILE_HISTORY_SQL = f"""with {a.ORDERED_SQL}
select user_id, row_key, coalesce(array_to_string(list(concat_ws('/', review_title, review_text)) over (partition by user_id order by pos rows between 3 preceding and 1 preceding), ';'), '') history
from ordered"""


def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile struct of each row, read from the struct field by field."""
    rows = profile.user_features(a.ordered(spark, sf_dir, "row_key", *PROFILED))
    return rows.select(
        "user_id", "row_key", _shares_text(F.map_entries("user_feat.cat_hist"), "key", "value").alias("cat_hist"), "user_feat.review_cnt", "user_feat.price_mean",
        "user_feat.price_std", F.array_join(F.transform("user_feat.history", lambda h: F.concat_ws("/", h["title"], h["text"])), ";").alias("history"),
    )


USER_FEATURES_SQL = f"""with num as ({PROFILE_NUMERIC_SQL}), hist as ({PROFILE_HISTORY_SQL}), cat as ({PROFILE_CAT_HIST_SQL})
select num.user_id, row_key, coalesce(cat.cat_hist, '') cat_hist, review_cnt, price_mean, price_std, history
from num join hist using (user_id, row_key) left join cat on cat.user_id = num.user_id and cat.pos = num.review_cnt + 1"""


def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.candidate_pool(a.meta(spark, sf_dir), seed=SEED)


POOL_SQL = f"""pool as (
    select row_number() over (order by h, parent_asin) - 1 as idx, parent_asin
    from (select distinct parent_asin, md5(concat_ws('|', parent_asin, '{SEED}')) h from meta) order by h, parent_asin limit {negatives.POOL})"""

CANDIDATE_POOL_SQL = f"with {a.META_SQL}, {POOL_SQL} select idx, parent_asin from pool"


def draw_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = negatives.draw_negatives(a.ordered(spark, sf_dir, "row_key", "parent_asin"), candidate_pool(spark, sf_dir), seed=SEED)
    return drawn.select("user_id", "row_key", "neg_asin", F.col("nth").cast("long").alias("nth"))


def _draw_sql(nth: int) -> str:
    """One draw: a rank among what is free, shifted past the sorted numbers that are gone."""
    word = f"('0x' || substr(md5(concat_ws('|', row_key, '{nth - 1}', '{SEED}')), 1, 8))::ubigint"
    rank = f"cast(({word} * cast((select count(*) from pool) - len(gone) as ubigint)) >> 32 as bigint)"
    shifted = f"list_reduce(list_prepend({rank}, gone), lambda d, x: d + cast(x <= d as int))"
    return f"""draw{nth} as materialized (select user_id, row_key, pos, list_append(drawn, d) as drawn, case when d is null then gone else list_sort(list_append(gone, d)) end as gone
    from (select *, case when len(gone) < (select count(*) from pool) then {shifted} end as d from draw{nth - 1}))"""


NEGATIVES_SQL = f"""{a.ORDERED_SQL}, {POOL_SQL},
seen as materialized (select user_id, idx, min(pos) as first_pos from ordered join pool using (parent_asin) group by all),
draw0 as materialized (select o.user_id, row_key, pos, []::bigint[] as drawn, coalesce(list(idx order by idx) filter (where idx is not null), []) as gone
    from ordered o left join seen s on o.user_id = s.user_id and s.first_pos <= o.pos group by all),
{", ".join(_draw_sql(nth) for nth in range(1, negatives.PER_POSITIVE + 1))},
drawn as materialized (select user_id, row_key, pos, parent_asin as neg_asin, nth from (
    select user_id, row_key, pos, unnest(drawn) as idx, unnest(range(1, len(drawn) + 1)) as nth from draw{negatives.PER_POSITIVE}) join pool using (idx))"""

DRAW_NEGATIVES_SQL = f"with {NEGATIVES_SQL} select user_id, row_key, neg_asin, nth from drawn"


def _all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.ordered(spark, sf_dir, "row_key", "parent_asin", "main_category", "event_date", "rating", "label_good", "label_best", "is_neg")
    pool = as_table(candidate_pool(spark, sf_dir), "candidates")
    drawn = negatives.draw_negatives(rows, pool, seed=SEED, keep=("event_date",))
    negs = negatives.negative_rows(drawn, _pool_facts(spark, sf_dir, pool))
    return split.split_rows(rows.withColumn("nth", F.lit(0)).drop("pos", "chunk", "lot"), negs, a.TRAIN_END, a.VALID_END)


def _pool_facts(spark: SparkSession, sf_dir: str, pool: DataFrame) -> DataFrame:
    """The metadata of the pool's items: no more rows than the pool, so all negatives can meet it without a shuffle."""
    mine = a.meta(spark, sf_dir).join(F.broadcast(pool), "parent_asin", "left_semi")
    return F.broadcast(as_table(enrich.least_row(mine.select("parent_asin", "main_category"), "parent_asin"), "pool_facts"))


def negative_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives with their positive's time and its past-only profile."""
    rows, keys, n = a.dealt(spark, sf_dir, "row_key", "parent_asin", "event_date", *PROFILED)
    rows = as_bucketed(profile.user_features(rows).drop(*PROFILED), "featured", *keys, n=n, dealt=True)
    pool = as_table(candidate_pool(spark, sf_dir), "candidates")
    negs = negatives.negative_rows(negatives.draw_negatives(rows, pool, seed=SEED, keep=("event_date", "user_feat")), _pool_facts(spark, sf_dir, pool))
    return negs.groupBy("user_id", "event_date").agg(
        F.count("*").alias("n"), F.sum("user_feat.review_cnt").alias("reviews"), F.sum(F.size("user_feat.cat_hist")).alias("categories"),
        F.sum(F.size("user_feat.history")).alias("history"), F.sum(F.round(F.col("user_feat.price_std") * 10_000).cast("long")).alias("std_sum"), F.sum("label_good").alias("good"),
    )


NEGATIVE_PROFILES_SQL = f"""with num as ({PROFILE_NUMERIC_SQL}), cat as ({PROFILE_CAT_HIST_SQL}), {NEGATIVES_SQL}
select d.user_id, o.event_date, count(*) n, cast(sum(num.review_cnt) as bigint) reviews, cast(sum(case when cat.cat_hist is null then 0 else len(string_split(cat.cat_hist, ';')) end) as bigint) categories,
       cast(sum(least(num.review_cnt, 3)) as bigint) history, cast(sum(round(num.price_std * 10000)) as bigint) std_sum, cast(0 as bigint) good
from drawn d join meta m on m.parent_asin = d.neg_asin join ordered o on o.row_key = d.row_key join num on num.row_key = d.row_key
left join cat on cat.user_id = o.user_id and cat.pos = o.pos group by 1, 2"""


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_rows(spark, sf_dir).select(
        "user_id", "parent_asin", "row_key", F.col("nth").cast("long").alias("nth"), "main_category", "event_date", "label_good", "label_best", "is_neg", "split"
    )


SPLIT_ROWS_SQL = f"""with {NEGATIVES_SQL}, both_rows as (
    select user_id, parent_asin, row_key, 0 as nth, main_category, event_date, label_good, label_best, 0 as is_neg from ordered
    union all
    select d.user_id, d.neg_asin, d.row_key, d.nth, m.main_category, o.event_date, 0, 0, 1
    from drawn d join meta m on m.parent_asin = d.neg_asin join ordered o on o.row_key = d.row_key)
select user_id, parent_asin, row_key, nth, coalesce(main_category, 'UNK') main_category, event_date, label_good, label_best, is_neg, {a.SPLIT_SQL} split
from both_rows"""


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_rows(spark, sf_dir).groupBy("split", "main_category", "is_neg").agg(F.count("*").alias("n"), F.sum("label_good").alias("good"), F.sum("label_best").alias("best"))


SPLIT_COUNTS_SQL = f"select split, main_category, is_neg, count(*) n, cast(sum(label_good) as bigint) good, cast(sum(label_best) as bigint) best from ({SPLIT_ROWS_SQL}) group by all"


def part_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and negatives of the split rows as the two parts of one plan, by split."""
    positive, negative = split.parts(_all_rows(spark, sf_dir))
    both = positive.select("split", "row_key", F.lit("positive").alias("part"), "rating").unionByName(negative.select("split", "row_key", F.lit("negative").alias("part"), "rating"))
    return both.groupBy("split", "part").agg(F.count("*").alias("n"), F.countDistinct("row_key").alias("keys"), F.sum("rating").alias("stars"))


PART_COUNTS_SQL = f"""select split, case when is_neg = 0 then 'positive' else 'negative' end part, count(*) n, count(distinct row_key) "keys", sum(case when is_neg = 0 then rating else 0 end) stars
from ({SPLIT_ROWS_SQL}) s join (select row_key as k, rating from ({ENRICH_SQL})) e on e.k = s.row_key group by 1, 2"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, labels and mean past of each split and category, without leakage from later dates."""
    rows = profile.numeric_profile(a.ordered(spark, sf_dir, "price_cents", "main_category", "event_date", "label_good", "label_best"))
    rows = rows.select("*", split.split_of(F.col("event_date"), a.TRAIN_END, a.VALID_END).alias("split"), split.category_of(F.col("main_category")).alias("category"))
    return rows.groupBy("split", "category").agg(
        F.count("*").alias("n"), F.sum("label_good").alias("good"), F.sum("label_best").alias("best"), F.sum("review_cnt").alias("past_reviews"),
        F.round(F.avg("price_mean"), 2).alias("mean_price"),
    )


FLAGSHIP_SQL = f"""with profiles as ({PROFILE_NUMERIC_SQL}), {a.ORDERED_SQL}
select {a.SPLIT_SQL} split, coalesce(main_category, 'UNK') category, count(*) n, cast(sum(label_good) as bigint) good, cast(sum(label_best) as bigint) best,
       cast(sum(review_cnt) as bigint) past_reviews, round(avg(price_mean), 2) mean_price
from ordered join profiles using (user_id, row_key) group by 1, 2"""


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_balance(a.positives(spark, sf_dir), ["label_good", "label_best"]).withColumn("pos_weight", F.round("pos_weight", 6))


CLASS_BALANCE_SQL = f"""with {a.POSITIVES_SQL}
select task, cast(count(*) filter (where label <> 1) as bigint) negatives, cast(count(*) filter (where label = 1) as bigint) positives,
       round(count(*) filter (where label <> 1) / nullif(count(*) filter (where label = 1), 0), 6) pos_weight
from (select 'label_good' task, label_good as label from positives union all select 'label_best', label_best from positives) group by task"""


def _meta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as raw JSON lines in both image layouts, with broken lines."""
    part = a.table(spark, sf_dir, "part")
    name = F.col("p_partkey").cast("string")
    listed = F.to_json(F.array(F.struct(F.lit("MAIN").alias("variant"), F.concat(F.lit("img://"), name).alias("hi_res"))))
    lists = F.to_json(F.struct(F.array(F.concat(F.lit("img://"), name), F.lit("x")).alias("hi_res"), F.array(F.lit("MAIN")).alias("variant"), F.array(F.lit("")).alias("large"), F.array(F.lit("t")).alias("thumb")))
    raw_price = F.expr("case p_partkey % 5 when 0 then 'None' when 1 then '' when 2 then concat('$', p_retailprice) else cast(cast(p_retailprice as decimal(12,2)) as string) end")
    line = F.concat(
        F.lit('{"parent_asin":'), F.when(F.col("p_partkey") % 11 == 0, F.lit('""')).otherwise(F.to_json(F.struct(name.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(name.alias("v")))) - 6)),
        F.lit(',"asin":"A'), name, F.lit('","title":"'), F.col("p_name"), F.lit('","price":"'), raw_price, F.lit('","images":'),
        F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(lists), F.lit(',"details":"{\\"Size\\": \\"'), F.col("p_size").cast("string"), F.lit('\\"}","features":["'),
        F.col("p_brand"), F.lit('"]'), F.when(F.col("p_partkey") % 13 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    return part.select(line.alias("raw"))


def meta_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = ingest.parse_lines(_meta_lines(spark, sf_dir), ingest.RAW_META)
    return _meta_fields(ingest.clean_meta(rows))


def meta_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from VARIANT columns: lines are parsed once and lie shredded in a table."""
    rows, _ = ingest.parse_variants(_meta_lines(spark, sf_dir))
    return _meta_fields(ingest.clean_variants(ingest.shredded(rows, "meta_variants")))


def _meta_fields(rows: DataFrame) -> DataFrame:
    clean = ingest.with_key(rows)
    return clean.select("parent_asin", "asin", "title", "price", F.col("details")["Size"].alias("size"), F.col("features")[0].alias("feature"), ingest.main_image("images").alias("url"), F.size("images").cast("long").alias("n_images"))


META_CLEAN_SQL = """select case when p_partkey % 11 = 0 then 'A' || p_partkey else cast(p_partkey as varchar) end parent_asin, 'A' || p_partkey asin, p_name title,
       case when p_partkey % 5 in (0, 1, 2) then null else cast(cast(p_retailprice as decimal(12,2)) as double) end price, cast(p_size as varchar) size, p_brand feature,
       'img://' || p_partkey url, cast(1 as bigint) n_images
from part where p_partkey % 13 <> 0"""


def text_clean_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = a.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = a.table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    both = docs.unionByName(turns)
    return both.select("id", F.md5(texts.clean_native(F.col("text")).cast("binary")).alias("clean_md5"))


def _duck_clean(column: str) -> str:
    out = column
    for pattern, new in (
        (f"[{texts.SINGLE_QUOTES}]", "''"), (f"[{texts.DOUBLE_QUOTES}]", '"'), (f"[{texts.DASHES}]", "-"), (texts.ELLIPSIS, "..."), (r"[\r\n\t]+", " "),
        (r"\p{C}", ""), (r"\\([\"''])", r"\1"), (r"\\", " "), (r"[\s\p{Z}]+", " "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"trim({out})"


TEXT_CLEAN_SQL = f"""select id, md5({_duck_clean("text")}) clean_md5 from (
    select 'd' || doc_id id, text from documents union all select concat_ws('-', 'c', cast(conv_id as varchar), cast(turn as varchar)), text from conversations)"""


_ODD = (
    ("\U0001f600 &lt;", " grinning_face <", "&gt; \ufb01ne", "> fine"), ("\U0001f44d\U0001f3fd&amp;", " thumbs_up_sign_medium_skin_tone &", " \uff21\u2460", " A1"),
    ("\U0001f1e9\U0001f1ea\u00bd ", " flag_de 1\u20442 ", "&quot;x&#39;", "\"x''"), ("3\ufe0f\u20e3\u201eq\u201d\t", ' keycap_3 "q" ', "\u2014\u2026\u200b", "-..."),
)
"""Before and after a name: raw pieces (emoji, entities, compatibility forms, quotes) and what cleaning makes of them."""


def text_clean_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all parts between emoji, entities and compatibility characters, and as an array with a null, cleaned."""
    pick = lambda at: F.get(F.array(*[F.lit(o[at]) for o in _ODD]), (F.col("p_partkey") % len(_ODD)).cast("int"))
    rows = a.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), pick(0), F.col("p_name"), pick(2)).alias("raw"), "p_brand")
    several = texts.clean_array(F.array(F.col("raw"), F.lit(None).cast("string"), F.col("p_brand")))
    return rows.select("p_partkey", texts.clean(F.col("raw")).alias("clean"), texts.smart_join(several).alias("joined"))


_PICK_SQL = lambda at: "([" + ", ".join(f"'{o[at]}'" for o in _ODD) + f"])[p_partkey % {len(_ODD)} + 1]"
TEXT_PLANTED_SQL = f"""select p_partkey, clean, clean || ';' || ' ' || p_brand || ';' joined
from (select p_partkey, p_brand, trim({_PICK_SQL(1)} || p_name || {_PICK_SQL(3)}) clean from part)""".replace("clean || ';' ||", "case when right(clean, 1) in ('.', ';', '!', '?') then clean else clean || ';' end ||")


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions in raw lines as a list, one text, a list that is none, or not at all, parsed to lists."""
    part = a.table(spark, sf_dir, "part")
    given = F.expr("case p_partkey % 5 when 0 then to_json(array(p_name, p_type)) when 1 then to_json(named_struct('x', p_name)) when 2 then concat('[', p_name) end")
    line = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("parent_asin"), F.when(F.col("p_partkey") % 5 == 3, F.col("p_name")).otherwise(given).alias("description")))
    rows, _ = ingest.parse_lines(part.select(line.alias("raw")), ingest.RAW_META)
    made = ingest.clean_meta(rows)
    return made.select("parent_asin", F.size("description").cast("long").alias("n"), F.array_join("description", "|").alias("description"))


DESCRIPTIONS_SQL = """select cast(p_partkey as varchar) parent_asin, case when d is null then null else len(d) end n, array_to_string(d, '|') description from (
    select p_partkey, case p_partkey % 5 when 0 then [p_name, p_type] when 1 then ['{"x":"' || p_name || '"}'] when 2 then ['[' || p_name] when 3 then [p_name] end d from part)"""


def text_clean_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "pages").select("page_id", texts.clean(F.col("html")).alias("clean"))


def user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.user_features(a.ordered(spark, sf_dir, "row_key", *PROFILED))
    return rows.select("user_id", "row_key", texts.user_text(F.col("user_feat")).alias("user_text"))


USER_TEXT_SQL = f"""with num as ({PROFILE_NUMERIC_SQL}), cat as (
    with {a.ORDERED_SQL}, o as (select user_id, pos, row_key, coalesce(nullif(main_category, ''), 'UNK') own from ordered),
    seen as (select user_id, own as category, min(pos) first_pos from o group by 1, 2),
    met as (select o.user_id, o.row_key, o.pos, s.first_pos, s.category,
                   sum(cast(o.own = s.category as int)) over (partition by o.user_id, s.category order by o.pos rows between unbounded preceding and 1 preceding) cnt
            from o join seen s on o.user_id = s.user_id)
    select user_id, row_key, string_agg(category || ': ' || cast(cast(round_even(round_even(cnt / (pos - 1), 4) * 100, 0) as bigint) as varchar) || '%', '; ' order by first_pos) cats
    from met where first_pos < pos and round_even(cnt / (pos - 1), 4) > 0 group by user_id, row_key, pos),
hist as (with {a.ORDERED_SQL} select user_id, row_key, list(review_text) over (partition by user_id order by pos rows between 3 preceding and 1 preceding) h from ordered)
select user_id, row_key, 'Category history: ' || coalesce(cats, 'No browsing history') || '. Total reviews: ' || case when review_cnt > 0 then cast(review_cnt as varchar) else 'No reviews' end
    || '. Avg price: ' || case when price_mean is not null then printf('%.2f', round_even(price_mean, 2)) else 'N/A' end
    || '. Price std: ' || case when price_std > 0 then printf('%.2f', round_even(price_std, 2)) else 'No price variation' end
    || '. Review history: ' || case when h is null or len(h) = 0 then 'No review history.' else array_to_string([ 'Review' || i || ': ' || h[i] || ';' for i in range(1, len(h) + 1)], ' ') end user_text
from num join hist using (user_id, row_key) left join cat using (user_id, row_key)"""


def item_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.meta(spark, sf_dir)
    return rows.select("parent_asin", texts.item_text(*map(F.col, ("main_category", "product_title", "price", "features", "description"))).alias("item_text"))


ITEM_TEXT_SQL = f"""with {a.META_SQL}
select parent_asin, 'Item category: ' || coalesce(main_category, 'Unknown category') || '. Item title: ' || product_title || '. Item price: '
    || case when price_cents is null then 'N/A' else printf('%.2f', round_even(price_cents / 100, 2)) end
    || '. Item features: ' || p_brand || '; size ' || p_size || '; Item description: ' || product_title || ';' item_text
from meta"""


def left_patch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assemble.with_patches(a.reviews(spark, sf_dir), a.patches(spark, sf_dir))
    return rows.select("row_key", "parent_asin", F.col("patch").cast("string").alias("patch"), "has_image")


LEFT_PATCH_SQL = f"""with {a.REVIEWS_SQL}
select row_key, parent_asin, case when cast(parent_asin as bigint) % 3 = 0 and p_partkey is not null then md5(parent_asin) end patch, cast(cast(parent_asin as bigint) % 3 = 0 and p_partkey is not null as int) has_image
from reviews left join part on p_partkey = cast(parent_asin as bigint)"""


def image_missing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assemble.with_patches(a.positives(spark, sf_dir), a.patches(spark, sf_dir))
    rows = rows.withColumn("split", split.split_of(F.col("event_date"), a.TRAIN_END, a.VALID_END))
    return evaluate.missing_image_ratio(rows, "split").withColumn("missing_ratio", F.round("missing_ratio", 9))


IMAGE_MISSING_SQL = f"""with {a.POSITIVES_SQL}
select {a.SPLIT_SQL} split, count(*) n, round(avg(case when cast(parent_asin as bigint) % 3 = 0 then 0 else 1 end), 9) missing_ratio from positives group by 1"""


def model_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole samples: profile, texts, key, patch flag and labels, valid ones only."""
    items = assemble.described(enrich.least_row(a.meta(spark, sf_dir), "parent_asin"), a.patches(spark, sf_dir))
    with lean(spark, a.table(spark, sf_dir, "lineitem").count()):
        rows = a.ordered(spark, sf_dir, "row_key", "parent_asin", "label_good", "label_best", "item_text", "has_image", *PROFILED, items=items)
        rows = profile.user_features(rows)
    made = assemble.valid(assemble.samples(rows))
    return made.select("key", "user_text", "item_text", "has_image", "label_good", "label_best")


MODEL_SAMPLES_SQL = f"""with ut as ({USER_TEXT_SQL}), it as ({ITEM_TEXT_SQL}), {a.ORDERED_SQL}
select concat_ws('-', o.user_id, o.parent_asin, substr(md5(o.row_key), 1, 6)) as key, user_text, item_text,
       cast(cast(o.parent_asin as bigint) % 3 = 0 as int) has_image, label_good, label_best
from ordered o join ut on ut.row_key = o.row_key join it on it.parent_asin = o.parent_asin"""


def reviews_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as raw review lines, some without fields and some broken, and parsed again."""
    e = a.table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    line = F.concat(
        F.lit('{"user_id":"'), F.col("user_id").cast("string"), F.lit('","asin":"A'), number, F.lit('"'),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"parent_asin":"P'), number, F.lit('"'))).otherwise(""),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit(',"title":"'), F.col("event_type"), F.lit('"'))),
        F.lit(',"rating":'), (F.col("event_id") % 5 + 1).cast("string"), F.lit(',"timestamp":'), number, F.lit(',"helpful_vote":'), (F.col("event_id") % 7).cast("string"),
        F.when(F.col("event_id") % 10 == 0, "").otherwise("}"),
    )
    rows, _ = ingest.parse_lines(e.select(line.alias("raw")), ingest.RAW_REVIEW)
    return ingest.clean_reviews(rows)


REVIEWS_CLEAN_SQL = """select cast(user_id as varchar) user_id, 'A' || event_id asin, case when event_id % 3 = 0 then 'P' || event_id else 'A' || event_id end parent_asin,
       cast(event_id % 5 + 1 as double) rating, case when event_id % 4 = 0 then '' else event_type end title, '' as text, event_id sort_timestamp, false verified_purchase, event_id % 7 helpful_votes
from events where event_id % 10 <> 0"""


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of all events as JSON lines, each eleventh broken: the lines set aside, with their reasons."""
    broken = F.expr("case when event_id % 11 = 0 then substr(props, 1, 3) when event_id % 11 = 1 then concat('[', props, ']') else props end")
    _, bad = ingest.parse_lines(a.table(spark, sf_dir, "events").select(broken.alias("raw")), ingest.RAW_REVIEW)
    return bad.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.length("raw")).alias("chars"))


REJECTED_SQL = """select case event_id % 11 when 0 then 'malformed' else 'not an object' end reason, count(*) n,
       cast(sum(case event_id % 11 when 0 then length(substr(props, 1, 3)) else length(props) + 2 end) as bigint) chars
from events where event_id % 11 in (0, 1) group by 1"""


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of all events as JSON lines, some broken, written as rows: what the one pass over the lines has counted, and the rows there are."""
    broken = F.expr("case when event_id % 11 = 0 then substr(props, 1, 3) when event_id % 11 = 1 then concat('[', props, ']') else props end")
    counts = Observation("ingest")
    lines = a.table(spark.newSession(), sf_dir, "events").select(broken.alias("raw"))  # a session that observes cannot fit Spark ML's models any more
    written = as_table(ingest.parse_counted(lines, ingest.RAW_REVIEW, counts), "ingested").count()
    seen = {"written": written} | counts.get
    return spark.range(1).select(*[F.lit(seen[k]).cast("long").alias(k) for k in ("written", "lines", "rows", "malformed", "not_object")])


INGEST_COUNTS_SQL = """select count(*) filter (where event_id % 11 > 1) written, count(*) lines, count(*) filter (where event_id % 11 > 1) as "rows",
       count(*) filter (where event_id % 11 = 0) malformed, count(*) filter (where event_id % 11 = 1) not_object from events"""


QUERIES = {
    "ingest_counts": (ingest_counts, INGEST_COUNTS_SQL),
    "reviews_clean": (reviews_clean, REVIEWS_CLEAN_SQL), "rejected_lines": (rejected_lines, REJECTED_SQL), "negative_profiles": (negative_profiles, NEGATIVE_PROFILES_SQL),
    "flagship": (flagship, FLAGSHIP_SQL), "enrich_reviews": (enrich_reviews, ENRICH_SQL), "downsample_five_star": (downsample_five_star, DOWNSAMPLE_SQL),
    "profile_numeric": (profile_numeric, PROFILE_NUMERIC_SQL), "profile_cat_hist": (profile_cat_hist, PROFILE_CAT_HIST_SQL),
    "profile_history": (profile_history, PROFILE_HISTORY_SQL), "user_features": (user_features, USER_FEATURES_SQL), "candidate_pool": (candidate_pool, CANDIDATE_POOL_SQL),
    "negatives": (draw_negatives, DRAW_NEGATIVES_SQL), "split_rows": (split_rows, SPLIT_ROWS_SQL), "split_counts": (split_counts, SPLIT_COUNTS_SQL),
    "class_balance": (class_balance, CLASS_BALANCE_SQL), "meta_clean": (meta_clean, META_CLEAN_SQL), "meta_variants": (meta_variants, META_CLEAN_SQL),
    "text_clean_native": (text_clean_native, TEXT_CLEAN_SQL), "text_clean_full": (text_clean_full, None), "text_clean_planted": (text_clean_planted, TEXT_PLANTED_SQL), "descriptions": (descriptions, DESCRIPTIONS_SQL),
    "part_counts": (part_counts, PART_COUNTS_SQL), "user_text": (user_text, USER_TEXT_SQL),
    "item_text": (item_text, ITEM_TEXT_SQL), "left_patch_join": (left_patch_join, LEFT_PATCH_SQL), "image_missing_ratio": (image_missing_ratio, IMAGE_MISSING_SQL),
    "model_samples": (model_samples, MODEL_SAMPLES_SQL),
}
