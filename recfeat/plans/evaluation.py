"""Queries of evaluation, vectors, chunks, patches, shards, sampling and streaming."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chunks, image, pieces, text, vectors
from ..operators import assemble, evaluate, sampling, sentences
from ..sources import images, patches, shards, sinks
from ..streaming import profile as streams
from ..tables import as_table, lean, own_folder
from . import adapters as a

GATE = [[0.5 if (i + e) % 2 else -0.25 * e for i in range(16)] for e in range(4)]
GATE_SQL = str(GATE)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "labels").join(a.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")


def auc_two_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    made = [evaluate.auc(rows, "n_chars", t).select(F.lit(t).alias("task"), F.round("auc", 9).alias("auc"), "positives", "negatives") for t in ("quality", "toxic")]
    return made[0].unionByName(made[1])


_AUC = """select '{t}' task, round(sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0), 9) auc, cast(sum(p) as bigint) positives, cast(sum(n) as bigint) negatives
from (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) below
      from (select n_chars score, cast(count(*) filter (where {t} = 1) as double) p, cast(count(*) filter (where {t} <> 1) as double) n
            from labels join documents using (doc_id) where n_chars is not null and {t} is not null group by 1))"""
AUC_SQL = f"{_AUC.format(t='quality')} union all {_AUC.format(t='toxic')}"


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_points(_labelled(spark, sf_dir), "n_chars", "quality").select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


ROC_SQL = """select threshold, round(sum(n) over (order by threshold desc) / nullif(sum(n) over (), 0), 9) fpr, round(sum(p) over (order by threshold desc) / nullif(sum(p) over (), 0), 9) tpr
from (select cast(n_chars as double) threshold, count(*) filter (where quality = 1) p, count(*) filter (where quality <> 1) n
      from labels join documents using (doc_id) where n_chars is not null and quality is not null group by 1)"""


def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluate.vector_stats(a.table(spark, sf_dir, "embeddings"), "embedding")
    return made.select(F.col("dim").cast("long").alias("dim"), "n", F.round("mean", 9).alias("mean"), F.round("variance", 9).alias("variance"))


VECTOR_STATS_SQL = """select dim, count(x) n, round(avg(x), 9) mean, round(var_pop(x), 9) variance
from (select unnest(range(len(embedding))) dim, cast(unnest(embedding) as double) x from embeddings) group by dim"""


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluate.mean_pool(a.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return made.select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 9).alias("value"))


MEAN_POOL_SQL = """select label, dim, round(avg(x), 9) "value"
from (select label, unnest(range(len(embedding))) dim, cast(unnest(embedding) as double) x from embeddings where len(list_filter(embedding, lambda v: v <> 0)) > 0) group by label, dim"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its partner, the next id of its batch of 20."""
    v = a.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") / 20).cast("long").alias("batch"), "embedding")
    partner = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("partner"))
    return v.join(partner.where("(vec_id + 1) % 20 <> 0"), "vec_id")


def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions' losses in each batch, and their weighted sum with the log losses of the pairs' two signs."""
    pairs = as_table(_pairs(spark, sf_dir), "pairs")
    score = vectors.dot(F.col("embedding"), F.col("partner"))
    tasks = pairs.groupBy("batch").agg(F.avg(F.log1p(F.exp(-score))).alias("t0"), F.avg(F.log1p(F.exp(score))).alias("t1"))
    rows = evaluate.contrastive_losses(pairs, "batch", "embedding", "partner").join(tasks, "batch")
    total = evaluate.weighted_loss([F.col("t0"), F.col("t1")], [F.col("loss"), F.col("back")])
    return rows.select("batch", "n", F.round("loss", 6).alias("loss"), F.round("back", 6).alias("back"), F.round(total, 6).alias("total"))


_LOSS = """{name}r as (select batch, {i} k, max(s) top, max(s) filter (where i = j) own from s group by 1, 2),
{name}e as (select s.batch, {i} k, ln(sum(exp(s - top))) + any_value(top) - any_value(own) l from s join {name}r on {name}r.batch = s.batch and {name}r.k = {i} group by 1, 2),
{name} as (select batch, count(*) n, avg(l) l from {name}e group by 1)"""
CONTRASTIVE_SQL = f"""with v as (select vec_id, vec_id // 20 batch, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
p as (select v.vec_id, v.batch, v.e l, w.e r from v join v w on w.vec_id = v.vec_id + 1 where (v.vec_id + 1) % 20 <> 0),
s as (select x.batch, x.vec_id i, y.vec_id j, list_cosine_similarity(x.l, y.r) / 0.07 s from p x join p y on x.batch = y.batch),
{_LOSS.format(name="there", i="i")}, {_LOSS.format(name="back", i="j")},
t as (select batch, avg(ln(1 + exp(-list_dot_product(l, r)))) t0, avg(ln(1 + exp(list_dot_product(l, r)))) t1 from p group by 1)
select there.batch, there.n, round(there.l, 6) loss, round(back.l, 6) back, round(t0 + t1 + 0.1 * there.l + 0.1 * back.l, 6) total from there join back using (batch) join t using (batch)"""


def capped_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact AUC of the first three batches of 64 labelled documents: evaluation may be capped."""
    rows = evaluate.first_batches(_labelled(spark, sf_dir), "doc_id", 3, 64)
    return evaluate.auc(rows, "n_chars", "quality").select(F.round("auc", 9).alias("auc"), "positives", "negatives")


CAPPED_AUC_SQL = """with r as (select n_chars score, quality y from labels join documents using (doc_id) order by doc_id limit 192),
g as (select score, cast(count(*) filter (where y = 1) as double) p, cast(count(*) filter (where y <> 1) as double) n from r where score is not null and y is not null group by 1)
select round(sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0), 9) auc, cast(sum(p) as bigint) positives, cast(sum(n) as bigint) negatives
from (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) below from g)"""


def gate_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four experts of 16 values, all of each vector, mixed by softmax weights of their mean."""
    experts = F.array(*[F.slice("embedding", 1 + 16 * e, 16) for e in range(4)])
    rows = a.table(spark, sf_dir, "embeddings").select("vec_id", experts.alias("experts"))
    rows = rows.withColumn("w", vectors.gate(F.col("experts"), GATE))
    fused = vectors.fuse(F.col("experts"), F.col("w"))
    return rows.select("vec_id", F.round(F.get("w", F.lit(0)), 6).alias("first_weight"), F.round(vectors.total(fused), 6).alias("fused_sum"))


GATE_FUSION_SQL = f"""with e as (select vec_id, [[cast(v as double) for v in embedding[1 + 16 * k : 16 + 16 * k]] for k in range(4)] x from embeddings),
q as (select vec_id, x, [(x[1][i] + x[2][i] + x[3][i] + x[4][i]) / 4 for i in range(1, 17)] m from e),
s as (select vec_id, x, [list_dot_product(m, cast(w as double[])) for w in {GATE_SQL}] s from q),
w as (select vec_id, x, [exp(v) / list_sum([exp(u) for u in s]) for v in s] w from s)
select vec_id, round(w[1], 6) first_weight, round(list_sum([list_sum(x[k]) * w[k] for k in range(1, 5)]), 6) fused_sum from w"""


def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("epoch"), "value", (F.col("event_id") % 50 + 1).alias("weight"))
    made = evaluate.metric_rollup(rows, "epoch", "value", "weight")
    return made.select(F.col("epoch").cast("long").alias("epoch"), "n", F.round("value", 6).alias("value"))


METRIC_ROLLUP_SQL = """select day(ts) epoch, cast(sum(event_id % 50 + 1) as bigint) n, round(sum("value" * (event_id % 50 + 1)) / sum(event_id % 50 + 1), 6) "value"
from events where "value" is not null group by 1"""


def safe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of dirty numbers: what is not finite counts as 0."""
    dirty = F.expr("case event_id % 4 when 0 then 'nan' when 1 then 'x' when 2 then cast(cast(value as decimal(12,2)) as string) end")
    rows = a.table(spark, sf_dir, "events").select("event_id", vectors.safe_float(dirty).alias("x"))
    return rows.select("event_id", "x", F.round(vectors.sigmoid(F.col("x") / 100), 9).alias("p"))


SAFE_VALUES_SQL = """select event_id, x, round(1 / (1 + exp(-x / 100)), 9) p
from (select event_id, case when event_id % 4 = 2 then coalesce(cast(cast("value" as decimal(12,2)) as double), 0.0) else 0.0 end x from events)"""


def finite_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without a value that is missing, NaN or infinite; every seventh gets one first."""
    rows = a.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding")).alias("v"))
    return rows.where(vectors.finite(F.col("v"))).select("vec_id", F.size("v").cast("long").alias("n"))


FINITE_VECTORS_SQL = "select vec_id, len(embedding) n from embeddings where vec_id % 7 <> 0"


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    """The words of all documents with their numbers, and the vocabulary learned from them."""
    words = as_table(pieces.histogram(a.table(spark, sf_dir, "documents")), "histogram")
    return words, {r.piece: r.id for r in pieces.learn(words).collect()}


def word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different word of the documents, cut into pieces of the learned vocabulary: their number and a digest of their ids."""
    words, vocabulary = _pieces(spark, sf_dir)
    ids = pieces.encoded(F.array("word"), vocabulary)[0]
    rows = words.select("word", "n", ids.alias("ids"))
    return rows.select("word", "n", F.size("ids").cast("long").alias("n_pieces"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids_md5"))


_PIECES_SQL = rf"""hist as materialized (select word, count(*) n from (select unnest(regexp_extract_all(text, '{pieces.WORD}')) as word from documents) group by word),
spans as (select substr(chr(1) || word, s, k) as piece, n from (
    select word, n, k, unnest(range(1, length(word) - k + 3)) as s from hist, (select unnest(range(1, {pieces.LONGEST + 1})) as k) where length(word) + 1 >= k)),
vocabulary as materialized (select piece, row_number() over (order by gain desc, piece) + {pieces.FIRST_ID + pieces.BYTES - 1} as id from (
    select piece, sum(n) * greatest(length(piece) - 1, 1) as gain from spans group by piece order by gain desc, piece limit {pieces.SIZE})),
cut as (
    select word, chr(1) || word as m, 1 as at_char, []::bigint[] as ids from hist
    union all
    select word, m, at_char + greatest(any_value(took), 1), any_value(ids) || case when any_value(took) > 0 then [any_value(id)]
        else list_transform(range(1, any_value(octet_length(encode(substr(m, at_char, 1)))) + 1), lambda i: {pieces.FIRST_ID} + ('0x' || substr(hex(encode(substr(any_value(m), any_value(at_char), 1))), 2 * i - 1, 2))::bigint) end
    from (select cut.*, coalesce(max(length(piece)), 0) as took, arg_max(v.id, length(piece)) as id
          from cut cross join (select unnest(range(1, {pieces.LONGEST + 1})) as k) left join vocabulary v on v.piece = substr(m, at_char, k) and length(v.piece) = k
          where at_char <= length(m) group by all) group by word, m, at_char),
cut_words as materialized (select word, ids from cut where at_char > length(m))"""

WORD_PIECES_SQL = f"""with recursive {_PIECES_SQL}
select word, n, len(ids) n_pieces, md5(array_to_string(ids, ',')) ids_md5 from cut_words join hist using (word)"""


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents in learned word pieces: their lengths, and the places of their sentence marks cut or filled to 64."""
    docs = a.table(spark, sf_dir, "documents")
    _, vocabulary = _pieces(spark, sf_dir)
    ids = docs.select("doc_id", pieces.encoded(text.sentences(F.col("text")), vocabulary, each=chunks.MAX_TOK - 3, most=chunks.MAX_CHUNKS * (chunks.MAX_TOK - 2)).alias("ids"))
    one = ids.select("doc_id", F.posexplode(chunks.sentence_chunks(F.col("ids"))).alias("chunk", "x"))
    marks = F.array_join(F.transform(chunks.padded(F.col("x.marks"), 64, -1), lambda m: m.cast("string")), ",")
    return one.select("doc_id", "chunk", F.size("x.ids").alias("n_ids"), F.size("x.marks").alias("n_sentences"), marks.alias("marks"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document, by number and total length."""
    s = text.sentences(F.col("text"))
    return a.table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.coalesce(F.length(F.array_join(s, "")), F.lit(0)).cast("long").alias("chars"))


SENTENCE_COUNTS_SQL = r"""select doc_id, len(s) n, coalesce(length(array_to_string(s, '')), 0) chars from (
    select doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]+)\s+|([。！？]+)\s*|\s*\n\s*', '\1\2' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') s
    from documents)"""

_SENTENCES = SENTENCE_COUNTS_SQL[SENTENCE_COUNTS_SQL.index("from (") + 6 : -1]
SENTENCE_CHUNKS_SQL = rf"""with recursive {_PIECES_SQL},
said as (select doc_id, unnest(s) as sentence, unnest(range(len(s))) as k from ({_SENTENCES})),
spoken as (select doc_id, k, coalesce(sum(len(ids)), 0) as n from (select doc_id, k, unnest(regexp_extract_all(sentence, '{pieces.WORD}')) as word from said) left join cut_words using (word) group by all),
t as materialized (select doc_id, list(1 + least(n, 381) order by k) as n from spoken group by doc_id),
r as (select doc_id, 1 i, 0 chunk, n[1] used from t
      union all
      select r.doc_id, i + 1, case when used + n[i + 1] > 382 then chunk + 1 else chunk end, case when used + n[i + 1] > 382 then n[i + 1] else used + n[i + 1] end
      from r join t on t.doc_id = r.doc_id where i < len(n) and not (chunk = 3 and used + n[i + 1] > 382)),
p as (select r.doc_id, chunk, used, used - n[i] + 1 as place from r join t on t.doc_id = r.doc_id),
g as (select doc_id, chunk, cast(max(used) + 2 as int) n_ids, cast(count(*) as int) n_sentences, list(place order by place) m from p group by 1, 2)
select doc_id, cast(chunk as int) chunk, n_ids, n_sentences, array_to_string(list_resize(m, 64, -1), ',') marks from g"""


def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations that the documents' periods tell, with their counts and scores."""
    found = sentences.abbreviation_scores(as_table(sentences.token_counts(a.table(spark, sf_dir, "documents")), "token_counts"))
    return found.where(F.col("score") >= sentences.ABBREVIATION).withColumn("score", F.round("score", 6))


def learned_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences each document has by the boundaries learned from all documents, and how many periods end none."""
    inner = lambda s: F.size(F.regexp_extract_all(s, F.lit(rf"\.[{sentences.CLOSERS}]*[\x20\x09-\x0D]"), F.lit(0)))
    rows = sentences.with_sentences(a.table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("sentences", "s")
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate(F.transform("s", inner), F.lit(0), lambda x, y: x + y).cast("long").alias("n_inner"))


def _kind_sql(column: str, name: str) -> str:
    lead, trail, comma = (x.replace("'", "\'\'") for x in (sentences._LEAD, sentences._TRAIL, sentences._COMMA))
    core = f"regexp_replace(regexp_replace({column}, '{lead}', ''), '{trail}', '')"
    bare = f"lower(regexp_replace(regexp_replace({core}, '\\.$', ''), '{comma}', ''))"
    return f"""case when regexp_matches({bare}, '{sentences._DIGITS}') then '##' else {bare} end as {name}type, {core} like '%.' as {name}dot, regexp_matches({core}, '[!?。！？]$') as {name}stop,
    case when regexp_matches({core}, '^\\p{{Lu}}') then 'U' when regexp_matches({core}, '^\\p{{Ll}}') then 'L' else '-' end as {name}case, {core} as {name}core"""


def _ratio_sql(a_: str, b_: str, ab: str, n: str) -> str:
    log = lambda p: f"ln(greatest({p}, 1e-300))"
    like = lambda k, m, q: f"(({k}) * {log(q)} + (({m}) - ({k})) * {log(f'1 - ({q})')})"
    p, p1, p2 = f"{b_} / {n}", f"{ab} / {a_}", f"({b_} - {ab}) / greatest({n} - {a_}, 1)"
    return f"-2 * ({like(ab, a_, p)} + {like(f'{b_} - {ab}', f'{n} - {a_}', p)} - {like(ab, a_, p1)} - {like(f'{b_} - {ab}', f'{n} - {a_}', p2)})"


_TOKENS_SQL = rf"""raw as (select doc_id, unnest(t) as token, unnest(range(len(t))) as i from (select doc_id, regexp_extract_all(text, '{sentences.TOKEN}') as t from documents)),
tok as materialized (select doc_id, i, {_kind_sql("token", "")} from raw),
seq as materialized (select *, lag(i) over w is null as first, lag(stop) over w as last_stop, lag(dot) over w as last_dot, lag(type) over w as last_type,
    lead(core) over w as next_core, lead(type) over w as next_type, lead("case") over w as next_case from tok window w as (partition by doc_id order by i)),
counts as materialized (select type, dot, "case", case when first then 'start' when last_stop then 'stop' when last_dot then 'dot' else 'mid' end as place,
    case when not first and not last_stop and last_dot then last_type end as before, count(*) as n from seq group by all),
totals as (select cast(sum(n) as double) as tokens, cast(sum(n) filter (where dot) as double) as dots from counts),
scored as materialized (select type, n_dot, n_plain, -2 * (n_dot * ln(greatest(dots / tokens, 1e-300)) + n_plain * ln(greatest(1 - dots / tokens, 1e-300)) - n_dot * ln(0.99::double) - n_plain * ln(1 - 0.99::double))
        * exp(-letters) * (length(type) - letters + 1) * pow(letters, -n_plain) as score
    from (select *, length(replace(type, '.', '')) as letters from (select type, coalesce(sum(n) filter (where dot), 0)::bigint as n_dot, coalesce(sum(n) filter (where not dot), 0)::bigint as n_plain from counts group by type)), totals
    where n_dot > 0 and regexp_matches(type, '{sentences._WORD}'))"""

ABBREVIATIONS_SQL = f"with {_TOKENS_SQL} select type, n_dot, n_plain, round(score, 6) as score from scored where score >= {sentences.ABBREVIATION}"

LEARNED_SENTENCES_SQL = rf"""with {_TOKENS_SQL},
known as (select type from scored where score >= {sentences.ABBREVIATION}),
types as materialized (select type, sum(n)::double as n, coalesce(sum(n) filter (where "case" = 'L'), 0) as small, coalesce(sum(n) filter (where "case" = 'U' and place = 'mid'), 0) as large
    from counts where regexp_matches(type, '{sentences._WORD}') group by type),
pairs as materialized (select before, type, sum(n)::double as n, coalesce(sum(n) filter (where "case" = 'U'), 0) as large, length(before) = 1 or before = '##' or before in (from known) as weak
    from counts where place = 'dot' group by all),
opens as (select type, sum(n) as opens from (select type, n from counts where place = 'stop' union all select type, n from pairs where not weak) group by type),
starters as (select type from opens join types using (type), totals, (select sum(opens) as breaks from opens)
    where {_ratio_sql("breaks", "n", "opens", "tokens")} >= {sentences.STARTER} and tokens / breaks > n / opens),
openers as (select type from types where small > 0 and large = 0 and type in (select type from pairs where weak and large > 0)),
bound as (select p.before, p.type from pairs p join (select type as before, sum(n)::double as firsts from counts where dot group by 1) f using (before) join types t on t.type = p.type, totals
    where weak and before <> '##' and p.n > 1 and {_ratio_sql("firsts", "t.n", "p.n", "tokens")} >= {sentences.COLLOCATION} and tokens / firsts > t.n / p.n),
ends as (select doc_id, case when next_core is null then null when stop then true when not dot then null when type = '##' then not regexp_matches(next_core, '^\p{{Ll}}')
        when type in (from known) or regexp_matches(type, '^\p{{L}}$') or core like '%..'
            then (type, next_type) not in (select before, type from bound) and next_case = 'U' and (next_type in (from starters) or next_type in (from openers))
        else true end as parts, dot and next_core is not null as inner_dot, regexp_matches(core, '[。！？]') as wide from seq)
select doc_id, 1 + count(*) filter (where parts) as n, count(*) filter (where inner_dot and not parts) as n_inner from ends group by doc_id
union all select doc_id, 0, 0 from documents where doc_id not in (select doc_id from ends where doc_id is not null)"""


def vocabulary_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids drawn from all vectors: those past a vocabulary of 60 become padding, and the list is filled to 80."""
    ids = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("int"))
    kept = chunks.padded(chunks.within_vocabulary(ids, 60), 80, 0)
    rows = a.table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids"), kept.alias("kept"))
    return rows.select("vec_id", F.array_join(F.transform("kept", lambda i: i.cast("string")), ",").alias("kept"), F.size(F.filter("ids", lambda i: i >= 60)).cast("long").alias("n_past"))


VOCABULARY_SQL = """with i as (select vec_id, [cast(floor(abs(cast(x as double)) * 100) as int) for x in embedding] ids from embeddings)
select vec_id, array_to_string(list_resize([case when v < 60 then v else 0 end for v in ids], 80, 0), ',') kept, len([v for v in ids if v >= 60]) n_past from i"""


def patch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels drawn from every vector, cut into patches and put together again, must be what they were."""
    rows = _spread(spark, a.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id").select("vec_id", _drawn_pixels(F.col("embedding")).alias("pixels"))
    back = rows.withColumn("patch", image.patchify("pixels")).withColumn("back", image.unpatchify("patch"))
    return back.select("vec_id", (F.col("pixels") == F.col("back")).alias("same"), F.octet_length("patch").alias("n_bytes"))


PATCH_ROUNDTRIP_SQL = "select vec_id, true same, cast(3 * 224 * 224 as int) n_bytes from embeddings"


def _digest(vector):
    return F.sha2(F.concat_ws(",", F.transform(vector, lambda x: F.floor(x.cast("double") * 1000).cast("string"))), 256)


_DIGEST_SQL = "sha256(array_to_string([cast(cast(floor(cast(x as double) * 1000) as bigint) as varchar) for x in embedding], ','))"


def _drawn_pixels(vector):
    """(3, 224, 224) bytes: the vector's digest, repeated."""
    digest = F.unhex(_digest(vector))
    return F.rpad(digest, F.lit(3 * 224 * 224), digest)


def pixel_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised pixel values of patches drawn from every vector (every fifth has none): their number, and a digest of all by place."""
    patch = F.when(F.col("vec_id") % 5 != 0, image.patchify(_drawn_pixels(F.col("embedding"))))
    rows = _spread(spark, a.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id").select("vec_id", patch.alias("patch"))
    kind, arrow = T.StructType().add("n", T.LongType()).add("digest", T.LongType()), pa.struct([("n", pa.int64()), ("digest", pa.int64())])
    made = rows.select("vec_id", image.over_pixel_values(F.col("patch"), _weighed, kind, arrow).alias("x"))
    return made.select("vec_id", "x.n", "x.digest")


_WEIGHTS = (np.arange(3 * 224 * 224) % 97 + 1).astype(float)


def _weighed(values: np.ndarray) -> dict[str, int]:
    """The number of values, and their sum in ten-thousandths, each times a weight by its place: whole numbers below 2 ** 53, so exact."""
    scaled = values.astype(float)
    scaled *= 10_000
    scaled += 0.5
    return {"n": len(values), "digest": int(np.floor(scaled, out=scaled) @ _WEIGHTS)}


def _spread(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores before a few numbers become many bytes."""
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


# a byte of the digest comes at every place of one remainder by 32, in each channel
PIXEL_VALUES_SQL = f"""with d as (select vec_id, {_DIGEST_SQL} h from embeddings),
places as (select c, i % 32 as r, sum((c * 50176 + i) % 97 + 1) as w from (select unnest(range(3)) as c), (select unnest(range(50176)) as i) group by all),
b as (select vec_id, c, w, case when vec_id % 5 = 0 then 0::real else ((('0x' || substr(h, 2 * r::int + 1, 2))::int::real / 255::real) - ([{", ".join(f"{m}::real" for m in image.MEAN)}])[c + 1]) / ([{", ".join(f"{s}::real" for s in image.STD)}])[c + 1] end as x
    from d, places)
select vec_id, cast(3 * 224 * 224 as bigint) n, cast(sum(cast(floor(x::double * 10000 + 0.5) as bigint) * w) as bigint) digest from b group by vec_id"""

PICKED = ((0, 0, 3, 5), (97, 1, 11, 0), (195, 2, 15, 15), (13, 0, 7, 9))
"""Patch, channel, row and column of the pixels that are compared."""


def _gradient(h, w, bases: list):
    """An image's bytes in the order of ``bases``: each channel grows by 2 a row and by 1 or 2 a column."""
    byte = lambda i: (F.get(F.array(*bases), (i % 3).cast("int")) + 2 * F.floor(i / (3 * w)) + (1 + i % 3 % 2) * (F.floor(i / 3) % w)).cast("int")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), 3 * h * w - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))


def _picked(patch) -> list:
    return [F.conv(F.hex(F.substring(patch, 1 + 768 * p + 256 * c + 16 * y + x, 1)), 16, 10).cast("int").alias(f"pixel_{k}") for k, (p, c, y, x) in enumerate(PICKED)]


def image_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images drawn from every vector that grow darker in both directions, resized, cropped and cut: single pixels tell how they were interpolated."""
    base = lambda k: F.conv(F.substring(_digest(F.col("embedding")), 1 + 2 * k, 2), 16, 10).cast("int") % 90
    rows = a.table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("vec_id") % 40 + 10).cast("int").alias("h"), (F.col("vec_id") % 23 + 12).cast("int").alias("w"), *[base(k).alias(f"b{k}") for k in range(3)]
    )
    rows = _spread(spark, rows, "vec_id")
    bgr = _gradient(F.col("h"), F.col("w"), [F.col("b0"), F.col("b1"), F.col("b2")])
    made = rows.select("vec_id", image.image_patches(F.when(F.col("vec_id") % 6 != 0, bgr), "h", "w").alias("p"))
    return made.select("vec_id", F.octet_length("p").alias("n_bytes"), *_picked(F.col("p")))


def _picked_sql(source: str, given: str) -> str:
    """Expected pixels of gradients: ``source`` has h, w and the list ``base`` in the bytes' order; ``given``: whether there is an image.

    The shorter side becomes 256, bilinear with pixel centres at half, then the middle 224 by 224 is cut out.
    """
    made = []
    for k, (p, c, y, x) in enumerate(PICKED):
        axis = lambda n, at: f"least(greatest((({at} + ((cast(round_even({n} * scale, 0) as int) - 224) // 2)) + 0.5::double) / scale - 0.5::double, 0), {n} - 1)"
        made.append(f"{axis('h', p // 14 * 16 + y)} as y{k}, {axis('w', p % 14 * 16 + x)} as x{k}")
    pixels = []
    for k, (_, c, _, _) in enumerate(PICKED):
        low = lambda v, n: f"least(cast(floor({v}) as int), greatest(0, {n} - 2))"
        y, x = low(f"y{k}", "h"), low(f"x{k}", "w")
        at = lambda yy, xx, c=c: f"(base[{3 - c}] + 2 * {yy} + {1 + (2 - c) % 2} * {xx})::double"
        up, right = f"least({y} + 1, h - 1)", f"least({x} + 1, w - 1)"
        row = lambda xx, k=k, y=y, up=up, at=at: f"({at(y, xx)} * (1 - (y{k} - {y})) + {at(up, xx)} * (y{k} - {y}))"
        pixels.append(f"case when {given} then cast(round_even({row(x)} * (1 - (x{k} - {x})) + {row(right)} * (x{k} - {x}), 0) as int) end as pixel_{k}")
    return f"""from (select *, {", ".join(made)} from (select *, 256::double / least(h, w) as scale from {source}))""", ", ".join(pixels)


_GRADIENT_FROM, _GRADIENT_PIXELS = _picked_sql(
    f"(select vec_id, cast(vec_id % 40 + 10 as int) as h, cast(vec_id % 23 + 12 as int) as w, [('0x' || substr(d, 2 * k + 1, 2))::int % 90 for k in range(3)] as base from (select *, {_DIGEST_SQL} as d from embeddings))",
    "vec_id % 6 <> 0",
)
IMAGE_GRADIENTS_SQL = f"select vec_id, case when vec_id % 6 <> 0 then cast(3 * 224 * 224 as int) end n_bytes, {_GRADIENT_PIXELS} {_GRADIENT_FROM}"


def landed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG files of gradients drawn from every supplier, landed in a folder and read by Spark's image source; every seventh file is broken."""
    key = F.col("s_suppkey")
    rows = a.table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("parent_asin"), (key % 30 + 10).cast("int").alias("h"), (key % 17 + 12).cast("int").alias("w"), *[(key * m % 90).cast("int").alias(f"b{k}") for k, m in enumerate((1, 7, 31))]
    )
    rows = _spread(spark, rows, "parent_asin")
    rgb = _gradient(F.col("h"), F.col("w"), [F.col("b0"), F.col("b1"), F.col("b2")])
    content = F.when(F.col("parent_asin").cast("int") % 7 != 0, image.png(rgb, F.col("h"), F.col("w"))).otherwise(F.lit(b"broken"))
    path = _folder(spark)
    images.land(rows.select("parent_asin", content.alias("content")), path, "png")
    made = patches.landed_patches(spark, path)
    return made.select(F.col("parent_asin").cast("long").alias("item"), F.octet_length("patch").alias("n_bytes"), *_picked(F.col("patch")))


_LANDED_FROM, _LANDED_PIXELS = _picked_sql(
    "(select s_suppkey, cast(s_suppkey % 30 + 10 as int) as h, cast(s_suppkey % 17 + 12 as int) as w, [s_suppkey * 31 % 90, s_suppkey * 7 % 90, s_suppkey % 90] as base from supplier where s_suppkey % 7 <> 0)", "true"
)
LANDED_IMAGES_SQL = f"select cast(s_suppkey as bigint) item, cast(3 * 224 * 224 as int) n_bytes, {_LANDED_PIXELS} {_LANDED_FROM}"


def _folder(spark: SparkSession) -> str:
    return f"{own_folder(spark).removeprefix('file:')}/{uuid.uuid4().hex}"


def shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all positives, written as tar shards and read back."""
    rows = a.positives(spark, sf_dir).select(
        F.concat(assemble.sample_key(F.col("user_id"), F.col("parent_asin"), F.col("row_key")), F.lit(".a/%")).alias("key"), F.col("review_text").alias("user_text"),
        F.col("product_title").alias("item_text"), F.md5("row_key").cast("binary").alias("patch"), F.array(F.lit(32)).alias("shape"),
        F.lit(1).alias("has_image"), "label_good", "label_best",
    )
    shards.register(spark)
    path = _folder(spark)
    with lean(spark, a.table(spark, sf_dir, "lineitem").count()):
        rows.write.format("tar_shards").option("path", path).mode("append").save()
        back = assemble.valid(spark.read.format("tar_shards").option("path", path).load())
        counts = back.groupBy("label_good", "label_best").agg(
            F.count("*").alias("n"), F.countDistinct("patch").alias("patches"), F.sum(F.length("user_text")).alias("chars"),
            F.min("key").alias("least_key"), F.max("key").alias("last_key"), F.countDistinct("key").alias("keys"),
        )
        return as_table(counts, "shard_counts")


SHARD_SQL = f"""with {a.POSITIVES_SQL}
select label_good, label_best, count(*) n, count(distinct md5(row_key)) patches, cast(sum(length(review_text)) as bigint) chars,
       min(k) least_key, max(k) last_key, count(distinct k) keys
from (select *, concat_ws('-', user_id, parent_asin, substr(md5(row_key), 1, 6)) || '.a/%' k from positives) group by 1, 2"""


def shard_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all parts found by a folder, by globs and by chosen keys; a glob that matches no shard is an error, which has no number."""
    part = a.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"))
    empty = {"user_text": F.lit("u"), "item_text": F.lit("i"), "patch": F.lit(None).cast("binary"), "shape": F.array(F.lit(1)), "has_image": F.lit(0), "label_good": F.lit(0), "label_best": F.lit(1)}
    shards.register(spark)
    path = _folder(spark)
    _spread(spark, part, "key").withColumns(empty).write.format("tar_shards").option("path", path).option("rows_per_shard", 100).mode("append").save()
    read = lambda where: spark.read.format("tar_shards").option("path", where).load()
    found = []
    for name, where in (("folder", path), ("glob", f"{path}/samples-*.tar.gz"), ("none", f"{path}/other-*.tar"), ("keys", path)):
        try:
            rows = read(where).where(F.col("key").isin("5", "70", "absent")) if name == "keys" else read(where)
            rows = rows.agg(F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("keys")).first()
            found.append((name, rows.n, rows["keys"]))
        except (AnalysisException, PythonException) as why:
            if "no shard matches" not in str(why):
                raise
            found.append((name, None, None))
    return spark.createDataFrame(found, "source string, n long, keys long")


SHARD_DISCOVERY_SQL = """select source, n, keys from (select count(*) n, cast(sum(p_partkey) as bigint) keys from part), (select unnest(['folder', 'glob']) as source)
union all select 'keys', count(*), cast(sum(p_partkey) as bigint) from part where p_partkey in (5, 70) union all select 'none', null, null"""


def sample_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of samples drawn from every event, some without a user or an item."""
    e = a.table(spark, sf_dir, "events")
    user, item = F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")), F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return e.select("event_id", assemble.sample_key(user, item, F.col("event_id")).alias("key"))


SAMPLE_KEYS_SQL = """select event_id, concat_ws('-', case when event_id % 5 <> 0 then cast(user_id as varchar) else 'unknown_user' end,
    case when event_id % 7 <> 0 then event_type else 'unknown_item' end, substr(md5(cast(event_id as varchar)), 1, 6)) as key from events"""


def predictions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all labelled documents, written as CSV with a header and read back."""
    rows = _labelled(spark, sf_dir).select(
        F.round(vectors.sigmoid((F.col("n_chars") - 2000) / 1000), 6).alias("prob_good"), F.col("quality").cast("double").alias("label_good"),
        F.round(vectors.sigmoid((2000 - F.col("n_chars")) / 1000), 6).alias("prob_best"), F.col("toxic").cast("double").alias("label_best"),
    )
    path = _folder(spark)
    sinks.write_predictions(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


PREDICTIONS_SQL = """select round(1 / (1 + exp(-(n_chars - 2000) / 1000.0)), 6) prob_good, cast(quality as double) label_good,
    round(1 / (1 + exp(-(2000 - n_chars) / 1000.0)), 6) prob_best, cast(toxic as double) label_best from labels join documents using (doc_id)"""


def worker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "events").select("event_id", sampling.worker_of("event_id", 8).alias("worker"))


WORKER_SQL = "select event_id, cast(('0x' || substr(md5(cast(event_id as varchar)), 1, 8))::ubigint % 8 as bigint) worker from events"


def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt to eight workers in the order of epoch 3: the place of each among its worker's rows, as they lie."""
    rows = a.table(spark, sf_dir, "events").select("event_id", sampling.shuffle_key("event_id", 3).alias("place"))
    lies = sampling.shuffled(rows, "event_id", 3, parts=8).withColumn("at", F.monotonically_increasing_id())
    nth = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    return lies.select("event_id", "place", F.col("part").cast("long").alias("part"), nth.cast("long").alias("nth"))


SHUFFLE_SQL = """with e as (select event_id, md5(concat_ws('|', cast(event_id as varchar), '3', '0')) place from events),
p as (select *, cast(('0x' || substr(md5(cast(event_id as varchar)), 1, 8))::ubigint % 8 as bigint) part from e)
select event_id, place, part, row_number() over (partition by part order by place) nth from p"""


def buffer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four parts through a buffer of 512 rows in epoch 2: the place of each in its part before and after."""
    dealt = a.table(spark, sf_dir, "events").select("event_id").repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    came = dealt.withColumn("came", F.monotonically_increasing_id() % (1 << 33))
    left = sampling.buffered(came, epoch=2).withColumn("part", F.spark_partition_id()).withColumn("went", F.monotonically_increasing_id() % (1 << 33))
    return left.select("event_id", F.col("part").cast("long").alias("part"), "came", "went")


def two_task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two class-weighted regressions on the numeric profile, and the exact AUC of each, held against Spark ML's."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from ..operators import profile

    rows = profile.numeric_profile(a.ordered(spark, sf_dir, "price_cents", "label_good", "label_best")).select(
        "label_good", "label_best", F.col("review_cnt").cast("double").alias("cnt"), F.coalesce("price_mean", F.lit(0.0)).alias("mean"),
        "price_std", F.coalesce(F.col("price_cents") / 100, F.lit(0.0)).alias("price"),
    )
    scored = as_table(evaluate.fit_two_tasks(as_table(rows, "features"), ["cnt", "mean", "price_std", "price"], rounds=5), "scored")
    made = []
    for t in ("good", "best"):
        found = evaluate.auc(scored, f"prob_{t}", f"label_{t}")
        other = BinaryClassificationEvaluator(rawPredictionCol=f"prob_{t}", labelCol=f"label_{t}", numBins=0).evaluate(scored)
        made.append(found.select(F.lit(t).alias("task"), "positives", "negatives", (F.abs(F.col("auc") - other) < 1e-9).alias("auc_is_exact"), (F.col("auc") >= 0.5).alias("above_chance")))
    return made[0].unionByName(made[1])


TWO_TASK_SQL = f"""with {a.POSITIVES_SQL}
select t.task, cast(sum(y) as bigint) positives, cast(sum(1 - y) as bigint) negatives, true auc_is_exact, true above_chance
from (select 'good' task, label_good y from positives union all select 'best', label_best from positives) t group by 1"""


def network_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector scored by a small two-headed network in Arrow batches."""

    def make():
        import numpy as np

        w = np.linspace(-1, 1, 128, dtype=np.float32).reshape(64, 2)
        return lambda x: x @ w

    rows = a.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scored = evaluate.score_batches(rows, make, ["embedding"], shapes=[[64]])
    return scored.select("vec_id", F.round("prob_good", 4).alias("prob_good"), F.round("prob_best", 4).alias("prob_best"))


NETWORK_SQL = """with w as (select vec_id, [cast(x as double) for x in embedding] e from embeddings)
select vec_id, round(1 / (1 + exp(-list_sum([e[i] * (-1 + (2 * (i - 1)) * 2 / 127.0) for i in range(1, 65)]))), 4) prob_good,
       round(1 / (1 + exp(-list_sum([e[i] * (-1 + (2 * (i - 1) + 1) * 2 / 127.0) for i in range(1, 65)]))), 4) prob_best from w"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.read_table(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), "event_id", "ts", F.col("event_type").alias("category"), F.col("value").alias("price"))
    made = streams.drained(streams.running_profiles(rows))
    return made.select("user_id", "event_id", "review_cnt", F.round("price_mean", 6).alias("price_mean"), F.round("price_std", 6).alias("price_std"), "cat_hist", "history", "late")


STREAM_PROFILE_SQL = """with o as (select cast(user_id as varchar) user_id, event_id, event_type, cast(round("value" * 100) as bigint) c,
        row_number() over (partition by user_id order by ts, event_id) pos from events),
w as (select *, cast(count(c) over p as double) n, cast(coalesce(sum(c) over p, 0) as double) s, cast(coalesce(sum(c * c) over p, 0) as double) q,
             coalesce(array_to_string(list(coalesce(event_type, 'UNK') || '/' || event_id) over (partition by user_id order by pos rows between 3 preceding and 1 preceding), ';'), '') history
      from o window p as (partition by user_id order by pos rows between unbounded preceding and 1 preceding)),
f as (select user_id, event_type, min(pos) first_pos from o group by 1, 2),
h as (select o.user_id, o.pos, string_agg(f.event_type || ':' || k.n, ';' order by f.first_pos) cats
      from o join f on o.user_id = f.user_id and f.first_pos < o.pos
      join lateral (select count(*) n from o x where x.user_id = o.user_id and x.event_type = f.event_type and x.pos < o.pos) k on true group by 1, 2)
select w.user_id, event_id, w.pos - 1 review_cnt, round(case when n > 0 then s / n / 100 end, 6) price_mean,
       round(case when n > 1 then sqrt((n * q - s * s) / (n * (n - 1))) / 100 else 0.0 end, 6) price_std, coalesce(cats, '') cat_hist, history, false late
from w left join h using (user_id, pos)"""


def stream_profile_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of a stream out of order: events leave in order once the watermark, an hour behind the newest, has passed their second."""
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), "event_id", "ts", F.col("event_type").alias("category"), F.col("value").alias("price"))
    made = streams.drained(streams.ordered_profiles(rows, "1 hour"))
    return made.select("user_id", "event_id", "review_cnt", F.round("price_mean", 6).alias("price_mean"), F.round("price_std", 6).alias("price_std"), "cat_hist", "history")


STREAM_ORDERED_SQL = f"""select s.* exclude (late) from ({STREAM_PROFILE_SQL}) s join events e using (event_id)
where epoch_ms(date_trunc('second', e.ts)) + {streams.LOT} <= (select epoch_ms(max(ts)) - 3600000 from events)"""


def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "user_id", (F.col("event_id") % 500).cast("string").alias("parent_asin"))
    meta = a.meta(spark, sf_dir).select("parent_asin", "product_title", "price_cents")
    return streams.drained(streams.enriched(rows, meta))


STREAM_ENRICH_SQL = f"with {a.META_SQL} select event_id, user_id, parent_asin, product_title, price_cents from events join meta on parent_asin = cast(event_id % 500 as varchar)"


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = streams.drained(streams.window_counts(_events(spark, sf_dir)))
    return made.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


STREAM_WINDOW_SQL = """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) n, round(sum("value"), 4) total
from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 hour group by 1, 2"""


QUERIES = {
    "auc_two_task": (auc_two_task, AUC_SQL), "roc_points": (roc_points, ROC_SQL), "vector_stats": (vector_stats, VECTOR_STATS_SQL), "mean_pool": (mean_pool, MEAN_POOL_SQL),
    "contrastive_loss": (contrastive_loss, CONTRASTIVE_SQL), "gate_fusion": (gate_fusion, GATE_FUSION_SQL), "metric_rollup": (metric_rollup, METRIC_ROLLUP_SQL),
    "safe_values": (safe_values, SAFE_VALUES_SQL), "finite_vectors": (finite_vectors, FINITE_VECTORS_SQL), "sentence_chunks": (sentence_chunks, SENTENCE_CHUNKS_SQL), "word_pieces": (word_pieces, WORD_PIECES_SQL),
    "abbreviations": (abbreviations, ABBREVIATIONS_SQL), "learned_sentences": (learned_sentences, LEARNED_SENTENCES_SQL), "vocabulary_guard": (vocabulary_guard, VOCABULARY_SQL),
    "sentence_counts": (sentence_counts, SENTENCE_COUNTS_SQL), "patch_roundtrip": (patch_roundtrip, PATCH_ROUNDTRIP_SQL), "pixel_values": (pixel_values, PIXEL_VALUES_SQL), "image_gradients": (image_gradients, IMAGE_GRADIENTS_SQL), "landed_images": (landed_images, LANDED_IMAGES_SQL),
    "shard_discovery": (shard_discovery, SHARD_DISCOVERY_SQL), "sample_keys": (sample_keys, SAMPLE_KEYS_SQL), "shard_roundtrip": (shard_roundtrip, SHARD_SQL),
    "predictions_csv": (predictions_csv, PREDICTIONS_SQL), "worker_split": (worker_split, WORKER_SQL), "shuffle_order": (shuffle_order, SHUFFLE_SQL), "buffer_order": (buffer_order, None),
    "two_task_scores": (two_task_scores, TWO_TASK_SQL), "capped_auc": (capped_auc, CAPPED_AUC_SQL), "network_scores": (network_scores, NETWORK_SQL), "stream_profile": (stream_profile, STREAM_PROFILE_SQL),
    "stream_profile_ordered": (stream_profile_ordered, STREAM_ORDERED_SQL), "stream_enrich": (stream_enrich, STREAM_ENRICH_SQL), "stream_window_counts": (stream_window_counts, STREAM_WINDOW_SQL),
}
