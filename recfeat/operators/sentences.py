"""Sentence boundaries by what a corpus says of its periods.

Abbreviations, collocations over a period and frequent sentence starters are found by log-likelihood ratios, without
labels (Kiss and Strunk, "Unsupervised multilingual sentence boundary detection", 2006). One pass of aggregates over the tokens
counts all of it. The tables that follow are what ``split`` looks at: sent to all tasks where they are small, else each text meets its own
part of them (``with_sentences``); none is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import as_table

# The thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER, SURE = 0.3, 7.88, 30.0, 0.99
MOST = 500_000
"""Tables of up to so many entries each are sent to all tasks; larger ones are joined with what the texts ask."""
SLICE = 64
TOKEN = r"[^\x20\x09-\x0D]+"
OPENERS, CLOSERS = "\"'“‘„(\\[«¿¡", "\"'”’“)\\]»"
NUMBER = "##"
_LEAD, _TRAIL, _COMMA = f"^[{OPENERS}]+", f"[{CLOSERS}]+$", "[,;:]+$"
_DIGITS, _WORD = r"^[0-9][0-9.,]*$", r"^[\p{L}\p{M}]+(\.[\p{L}\p{M}]+)*$"


def _core(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, _LEAD, ""), _TRAIL, "")


def _kind(core: Column) -> Column:
    """The type of a token without quotes and brackets: lower-cased, without final period or commas; all numbers are one."""
    plain = F.when(core.endswith("."), F.substring(core, F.lit(1), F.length(core) - 1)).otherwise(core)
    bare = F.lower(F.regexp_replace(plain, _COMMA, ""))
    return F.when(bare.rlike(_DIGITS), NUMBER).otherwise(bare)


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(type, dot, case, place, before, n)``: tokens by type, final period, case and what stands before.

    ``place``: ``start`` of a text, after a ``stop`` (question or exclamation mark), after a ``dot``, or ``mid``. ``before``: the type before the period,
    for tokens after one. Texts of any length; a null text has no tokens.
    """
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), F.lit(0))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("now", 1, F.greatest(F.size("now") - 1, F.lit(0))))
    listed = docs.select(tokens.alias("now")).where(F.size("now") > 0)
    rows = listed.select(F.explode(F.arrays_zip("now", before.alias("last"))).alias("x")).select("x.now", "x.last")
    mark = F.regexp_extract("last", rf"([.!?。！？])[{CLOSERS}]*$", 1)  # most tokens have none, and then nothing more is asked of the one before
    rows = rows.select("last", _core(F.col("now")).alias("core"), mark.alias("mark"))
    place = F.when(F.col("last").isNull(), "start").when(F.col("mark") == "", "mid").when(F.col("mark") == ".", "dot").otherwise("stop")
    letter = F.when(F.col("core").rlike(r"^\p{Lu}"), "U").when(F.col("core").rlike(r"^\p{Ll}"), "L").otherwise("-")
    before = F.when(F.col("mark") == ".", _kind(_core(F.col("last"))))
    rows = rows.select(_kind(F.col("core")).alias("type"), F.col("core").endswith(".").alias("dot"), letter.alias("case"), place.alias("place"), before.alias("before"))
    return rows.groupBy("type", "dot", "case", "place", "before").agg(F.count("*").alias("n"))


def _log(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-300)))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``(type, n_dot, n_plain, score)`` of types of letters that have ended in a period.

    The likelihood ratio of "a period follows nearly always" to "as often as after any token", times e to the minus length, times inner
    periods plus one, divided by length to the power of the number of sights without a period.
    """
    total = counts.agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("dot"), F.col("n"))), F.lit(0)).alias("dots"))
    types = counts.groupBy("type").agg(
        F.coalesce(F.sum(F.when(F.col("dot"), F.col("n"))), F.lit(0)).alias("n_dot"), F.coalesce(F.sum(F.when(~F.col("dot"), F.col("n"))), F.lit(0)).alias("n_plain")
    )
    rows = types.where((F.col("n_dot") > 0) & F.col("type").rlike(_WORD)).join(F.broadcast(total))  # one row
    p, k, rest = F.col("dots") / F.col("tokens"), F.col("n_dot"), F.col("n_plain")
    ratio = -2 * (k * _log(p) + rest * _log(1 - p) - k * F.log(F.lit(SURE)) - rest * F.log(F.lit(1 - SURE)))
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    periods = F.length("type") - letters + 1
    return rows.select("type", "n_dot", "n_plain", (ratio * F.exp(-letters.cast("double")) * periods * F.pow(letters.cast("double"), -rest.cast("double"))).alias("score"))


def _ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of two events that meet ``ab`` times, in ``n`` places."""
    p, p1, p2 = b / n, ab / a, (b - ab) / F.greatest(n - a, F.lit(1))
    like = lambda k, m, q: k * _log(q) + (m - k) * _log(1 - q)
    return -2 * (like(ab, a, p) + like(b - ab, n - a, p) - like(ab, a, p1) - like(b - ab, n - a, p2))


@dataclass(frozen=True)
class Boundaries:
    """What was learned: abbreviations, pairs that a period does not part, and words that open sentences."""

    abbreviations: frozenset[str] = frozenset()
    collocations: frozenset[tuple[str, str]] = frozenset()
    starters: frozenset[str] = frozenset()
    """Frequent sentence starters."""
    openers: frozenset[str] = frozenset()
    """Words that are else written small, so that a capital opens a sentence."""

    def ends(self, token: str, following: str) -> bool:
        """Whether a sentence ends between two tokens, the first of which has a period or other mark at its end."""
        core = _strip(token)
        if core.endswith(("!", "?", "。", "！", "？")):
            return True
        if not core.endswith("."):
            return False
        kind, after = _type(core), _strip(following)
        if kind == NUMBER:
            return not after[:1].islower()
        if not (kind in self.abbreviations or (len(kind) == 1 and kind.isalpha()) or core.endswith("..")):
            return True
        other = _type(after)
        return (kind, other) not in self.collocations and after[:1].isupper() and (other in self.starters or other in self.openers)

    def split(self, text: str | None) -> list[str]:
        """The sentences of a text, trimmed; null and blank give none. Texts without spaces are parted after their full-width marks."""
        text, out, start = text or "", [], 0
        for end, near in _signs(text):
            if near is None or self.ends(*near):
                out.append(text[start:end])
                start = end
        return [s for s in (x.strip(_SPACES) for x in [*out, text[start:]]) if s]


_SPACES = " \t\n\x0b\x0c\r"
_NEXT = re.compile(r"[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)")
_SIGN = re.compile(r"[.!?][\"'”’“)\]»]*(?=[\x20\x09-\x0D])|[。！？]+[\"'”’“)\]»]*")
_STRIP = re.compile(f"^[{OPENERS}]+|[{CLOSERS}]+$")


def _strip(token: str) -> str:
    return _STRIP.sub("", token)


def _type(core: str) -> str:
    bare = re.sub(_COMMA, "", core.removesuffix(".")).lower()
    return NUMBER if re.match(_DIGITS, bare) else bare


def _signs(text: str) -> Iterator[tuple[int, tuple[str, str] | None]]:
    """Where a sentence may end: the place, and the tokens on both sides; none after full-width marks, which always end one."""
    start = 0
    for sign in _SIGN.finditer(text):
        end = sign.end()
        if sign[0][0] in "。！？":
            start = end
            yield end, None
            continue
        at = end
        while at > start and text[at - 1] not in _SPACES:
            at -= 1
        rest = _NEXT.match(text, end)
        if rest is not None:
            yield end, (text[at:end], rest[1])


def asked(text: str | None) -> list[tuple[str, str]]:
    """The pairs ``(before, type)`` around the periods of a text, each once: all that ``ends`` looks up for it."""
    near = [(_strip(n[0]), n[1]) for _, n in _signs(text or "") if n]
    pairs = ((_type(core), _type(_strip(following))) for core, following in near if core.endswith("."))
    return list(dict.fromkeys(p for p in pairs if p[0] != NUMBER))


def learned_tables(counts: DataFrame) -> dict[str, DataFrame]:
    """``abbreviations``, ``starters``, ``openers`` (type, n) and ``collocations`` (before, type, n) of a table of ``token_counts``."""
    scores = abbreviation_scores(counts)
    known = as_table(scores.where(F.col("score") >= ABBREVIATION).select("type", F.col("n_dot").alias("n")), "abbreviations")
    total = counts.agg(F.sum("n").alias("tokens"))
    types = counts.groupBy("type").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("case") == "L", F.col("n"))), F.lit(0)).alias("small"),
        F.coalesce(F.sum(F.when((F.col("case") == "U") & (F.col("place") == "mid"), F.col("n"))), F.lit(0)).alias("large"),
    ).where(F.col("type").rlike(_WORD))
    types = as_table(types, "types")
    weak = (F.length("before") == 1) | F.col("before").isin(NUMBER) | F.col("known").isNotNull()
    pairs = counts.where("place = 'dot'").groupBy("before", "type").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("case") == "U", F.col("n"))), F.lit(0)).alias("large"))
    pairs = as_table(pairs.join(known.select(F.col("type").alias("known")), F.col("before") == F.col("known"), "left").select("before", "type", "n", "large", weak.alias("weak")), "pairs")
    after = counts.where("place = 'stop'").groupBy("type").agg(F.sum("n").alias("n")).union(pairs.where("not weak").groupBy("type").agg(F.sum("n")))
    after = as_table(after.groupBy("type").agg(F.sum("n").alias("opens")), "opens")
    breaks = after.agg(F.sum("opens").alias("breaks"))
    rows = after.join(types, "type").join(F.broadcast(total)).join(F.broadcast(breaks))  # one row each
    a, b, ab, n = (F.col(c).cast("double") for c in ("breaks", "n", "opens", "tokens"))
    starters = rows.where((_ratio(a, b, ab, n) >= STARTER) & (n / a > b / ab)).select("type", "n")
    openers = types.where("small > 0 and large = 0").join(pairs.where("weak and large > 0").select("type").distinct(), "type", "left_semi").select("type", "n")
    firsts = counts.where("dot").groupBy(F.col("type").alias("before")).agg(F.sum("n").alias("firsts"))
    rows = pairs.where(F.col("weak") & (F.col("before") != NUMBER)).join(firsts, "before").join(types.select("type", F.col("n").alias("seen")), "type").join(F.broadcast(total))
    a, b, ab, n = (F.col(c).cast("double") for c in ("firsts", "seen", "n", "tokens"))
    collocations = rows.where((F.col("n") > 1) & (_ratio(a, b, ab, n) >= COLLOCATION) & (n / a > b / ab)).select("before", "type", "n")
    return {"abbreviations": known, "starters": starters, "openers": openers, "collocations": collocations}


def _learned(docs: DataFrame, text_col: str) -> dict[str, DataFrame]:
    tables = learned_tables(as_table(token_counts(docs, text_col), "token_counts"))
    return {name: table if name == "abbreviations" else as_table(table, name) for name, table in tables.items()}


def _collected(tables: dict[str, DataFrame], most: int) -> Boundaries | None:
    """The whole tables; none if one has more than ``most`` entries."""
    if any(table.count() > most for table in tables.values()):
        return None
    types = lambda name: frozenset(r[0] for r in tables[name].select("type").collect())
    pairs = frozenset(tuple(r) for r in tables["collocations"].select("before", "type").collect())
    return Boundaries(types("abbreviations"), pairs, types("starters"), types("openers"))


def learn(docs: DataFrame, text_col: str = "text", most: int = MOST) -> Boundaries:
    """Learn from all texts. All entries come to the driver; more than ``most`` in one table are an error, and for ``with_sentences``."""
    found = _collected(_learned(docs, text_col), most)
    if found is None:
        raise ValueError(f"a learned table has more than {most} entries; with_sentences splits by tables of any size")
    return found


def with_sentences(docs: DataFrame, text_col: str = "text", most: int = MOST) -> DataFrame:
    """``docs`` with ``sentences``, by the boundaries learned from all its texts; null and blank texts have none. The same whatever ``most`` is."""
    tables = _learned(docs, text_col)
    found = _collected(tables, most)
    return split_by(docs, tables, text_col) if found is None else docs.withColumn("sentences", split(F.col(text_col), found))


def split_by(docs: DataFrame, tables: dict[str, DataFrame], text_col: str = "text") -> DataFrame:
    """``docs`` with ``sentences``, by learned tables of any size, which stay distributed.

    The pairs around the texts' periods meet the tables, and each text gets what is known of its own pairs. Texts are told apart by a hash: entries hold for
    all texts, so two texts of one hash only bring each other's entries along.
    """
    pairs = F.arrow_udf(_asked_texts, "array<struct<before:string,type:string>>")
    key, yes = F.xxhash64(F.col(text_col)).alias("_key"), F.lit(True)
    asks = docs.select(key, F.explode(pairs(F.col(text_col))).alias("x")).select("_key", "x.before", "x.type")
    opening = tables["starters"].select("type").union(tables["openers"].select("type")).distinct()
    known = asks.select("before", "type").distinct().join(tables["abbreviations"].select(F.col("type").alias("before"), yes.alias("short")), "before", "left")
    known = known.join(opening.withColumn("opens", yes), "type", "left")
    known = known.join(tables["collocations"].select("before", "type", yes.alias("bound")), ["before", "type"], "left")
    known = known.where("short or opens or bound")
    met = asks.join(known, ["before", "type"]).groupBy("_key").agg(F.collect_set(F.struct("before", "type", "short", "opens", "bound")).alias("_met"))
    cut = F.arrow_udf(_split_met, "array<string>")
    return docs.select("*", key).join(met, "_key", "left").withColumn("sentences", cut(F.col(text_col), F.col("_met"))).select(*docs.columns, "sentences")


def _asked_texts(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("before", pa.string()), ("type", pa.string())]))
    named = lambda text: [{"before": b, "type": t} for b, t in asked(text)]
    parts = [pa.array([named(t) for t in texts.slice(at, SLICE).to_pylist()], kind) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _split_met(texts: pa.Array, met: pa.Array) -> pa.Array:
    """Each text by the entries that came with it."""
    kind, parts = pa.list_(pa.string()), []
    for at in range(0, len(texts), SLICE):
        said = []
        for text, mine in zip(texts.slice(at, SLICE).to_pylist(), met.slice(at, SLICE).to_pylist()):
            mine = mine or ()
            opening, bound = (frozenset(m["type"] for m in mine if m["opens"]), frozenset((m["before"], m["type"]) for m in mine if m["bound"]))
            said.append(Boundaries(frozenset(m["before"] for m in mine if m["short"]), bound, opening).split(text))
        parts.append(pa.array(said, kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def split_texts(texts: pa.Array, boundaries: Boundaries) -> pa.Array:
    """The sentences of each text of a batch. Only ``SLICE`` texts and their sentences are Python objects at a time, whatever the batch."""
    kind = pa.list_(pa.string())
    parts = [pa.array([boundaries.split(t) for t in texts.slice(at, SLICE).to_pylist()], kind) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def split(text: Column, boundaries: Boundaries) -> Column:
    """The sentences of a text column as an array; null and blank give none."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return split_texts(texts, boundaries)

    return run(text)
