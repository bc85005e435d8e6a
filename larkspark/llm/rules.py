"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text's counts become rates. For each language and source, mergeable quantile sketches of the rates give
the upper quartile and the upper spread; a rate beyond upper quartile + FENCE times the spread (at least
FLOOR of it) fails. No cutoff is given for all sources, but where rates are zero for most texts
the quartiles are equal and the fence is the constant FENCE * FLOOR above them. The thresholds are joined back to the rates and filter
them. Texts that fail the base rules don't shape the thresholds.

The sketches are kept for every language and source, merged for every language, and merged for the whole corpus.
A group with fewer than LEAST_ROWS passing texts takes its language's fences, a language with fewer the corpus's.
A source whose upper quartile lies beyond its language's fence is junk for a quarter or more, so it would set its
fences by that junk: it takes its language's, too. A language isn't held against the corpus that way, as languages
differ for good reasons.

Defined results: a null text has no words and fails the base rule, as the empty one does. A null language or
source is a group of its own. A text of any length is looked at whole, as arrays of its words and lines. A rate
that equals its fence passes. Repeated rows each count. An empty table gives an empty result. Columns other than
the id, the text, lang and source, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The white space between words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rate -> the least spread that its fence counts with.
FLOOR = {"symbol_rate": 0.02, "dup_line_rate": 0.1, "repeat_rate": 0.1, "word_length": 1.0}
FENCE = 3.0
#: Passing texts that a group needs for fences of its own.
LEAST_ROWS = 20
#: Accuracy of the quantile sketches: the error in rank is 1 / ACCURACY.
ACCURACY = 10_000


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns id, the columns of keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A window of three words is hashed to 64 bits. Only texts in which a hash occurs twice are looked at more
    closely: the starts of repeated windows are the neighbours with equal hashes in sorted order, and the words
    that they cover are counted in one pass over the sorted starts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__{c}") for c in keep], text.alias("t"))
    out = out.withColumns({
        "w": F.filter(F.split("t", SPACE), lambda w: w != ""),
        "l": F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0),
        "word_chars": F.length(F.translate("t", _SPACES, "")).cast("long"),
        "n_symbols": (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"),
    }).drop("t")
    out = out.withColumns({
        "n_words": F.size("w").cast("long"),
        "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
        "g": F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))),
    }).drop("w", "l")
    out = out.withColumn("twice", F.size(F.array_distinct("g")) < F.size("g"))
    pairs = F.when(F.col("twice"), F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("s", pairs).drop("g")
    again = F.filter("s", lambda x, i: (F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False))))
    out = out.withColumn("starts", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("s", "twice")
    covered = F.aggregate("starts", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(F.col("__id").alias(id_col), *[F.col(f"__{c}").alias(c) for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def with_rates(counts: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counts.withColumns({"symbol_rate": F.col("n_symbols") / chars, "dup_line_rate": F.col("n_dup_lines") * 20 / words, "repeat_rate": F.col("n_repeat_words") / words, "word_length": F.col("word_chars") / words})


def thresholds(rates: DataFrame, groups: tuple[str, ...], fence: float = FENCE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Each group's fences, from sketches that are built in each task and merged at every level of groups.

    One aggregation makes the sketches of all levels; what is joined afterwards is a row for each group.
    """
    measures = [F.percentile_approx(r, [0.25, 0.75], ACCURACY).alias(r) for r in FLOOR]
    passing = rates.filter("not base_failed")
    sketched = (passing.rollup(*groups) if groups else passing.groupBy()).agg(F.grouping_id().alias("level") if groups else F.lit(0).alias("level"), F.count("*").alias("n"), *measures)
    own = [(F.col(r)[1] + fence * F.greatest(F.col(r)[1] - F.col(r)[0], F.lit(low))).alias(f"most_{r}") for r, low in FLOOR.items()]
    sketched = cut(sketched.select(*groups, "level", "n", *[F.col(r)[1].alias(f"upper_{r}") for r in FLOOR], *own), "fences")
    out = sketched.filter(F.col("level") == 2 ** len(groups) - 1).select(*[f"most_{r}" for r in FLOOR])
    for k in range(1, len(groups) + 1):  # from the corpus down; the level of a rollup's first k groups has the others' bits set
        wide = out.select(*[F.col(g).alias(f"of_{g}") for g in groups[: k - 1]], *[F.col(f"most_{r}").alias(f"wide_{r}") for r in FLOOR])
        fine = sketched.filter(F.col("level") == 2 ** (len(groups) - k) - 1)
        same = F.lit(True)
        for g in groups[: k - 1]:
            same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
        enough = F.col("n") >= least_rows
        chosen = [F.when(enough & (F.lit(k == 1) | (F.col(f"upper_{r}") <= F.col(f"wide_{r}"))), F.col(f"most_{r}")).otherwise(F.col(f"wide_{r}")).alias(f"most_{r}") for r in FLOOR]
        out = fine.join(wide, same).select(*groups[:k], *chosen)
    return out


def apply_rules(docs: DataFrame, groups: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Texts are read once: the counts are written, and both the sketches and the join read them.
    """
    names = tuple(f"group_{i}" for i in range(len(groups)))
    keyed = docs.select(F.col(id_col), F.col(text_col), *[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)])
    rates = with_rates(cut(base_counts(keyed, id_col, text_col, names), "counts"))
    limits = thresholds(rates, names)
    same = [rates[n].eqNullSafe(limits[n]) for n in names]
    joined = rates.join(limits, same[0] if len(same) == 1 else same[0] & same[1] if len(same) == 2 else F.expr("true") if not same else same, "left")
    passes = F.lit(True)
    for r in FLOOR:
        passes = passes & F.coalesce(F.col(r) <= F.col(f"most_{r}"), F.lit(True))
    return joined.select(rates[id_col], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & passes).alias("kept"))


#: What apply_rules computes on documents, for DuckDB. Thresholds are exact quantiles; the sketches are, too, for levels under ACCURACY rows.
RULES_SQL = r"""
with words as (
  select doc_id, lang, source, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
grams as (
  select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words)),
starts as (select doc_id, i from grams qualify count(*) over (partition by doc_id, g) > 1),
covered as (
  select doc_id, count(distinct i + k) as n from starts, (values (0), (1), (2)) as v(k) group by doc_id),
lines as (
  select doc_id, count(*) - count(distinct l) as n
  from (select doc_id, unnest(string_split(t, chr(10))) as l from words)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
counts as (
  select w.doc_id, w.lang, w.source, len(w.w)::bigint as n_words,
    length(regexp_replace(w.t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from words w left join lines l using (doc_id) left join covered c using (doc_id)),
rates as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    n_symbols / greatest(word_chars, 1)::double as symbol_rate, n_dup_lines * 20 / greatest(n_words, 1)::double as dup_line_rate,
    n_repeat_words / greatest(n_words, 1)::double as repeat_rate, word_chars / greatest(n_words, 1)::double as word_length
  from counts),
long as (
  unpivot (select doc_id, lang, source, symbol_rate, dup_line_rate, repeat_rate, word_length from rates where not base_failed)
  on symbol_rate, dup_line_rate, repeat_rate, word_length into name rate value x),
levels as (
  select 2 as level, lang, source, rate, x from long union all
  select 1, lang, null, rate, x from long union all
  select 0, null, null, rate, x from long),
ranked as (
  select level, lang, source, rate, x, row_number() over (partition by level, lang, source, rate order by x) as r,
    count(*) over (partition by level, lang, source, rate) as n from levels),
quartiles as (
  select level, lang, source, rate, max(n) as n, min(x) filter (r >= ceil(n * 0.25)) as q1, min(x) filter (r >= ceil(n * 0.75)) as q3
  from ranked group by all),
own as (
  select *, q3 + 3.0 * greatest(q3 - q1, case rate when 'symbol_rate' then 0.02 when 'word_length' then 1.0 else 0.1 end) as most
  from quartiles),
by_language as (
  select l.lang, l.rate, case when l.n >= 20 then l.most else c.most end as most
  from own l join own c on l.rate = c.rate and l.level = 1 and c.level = 0),
fences as (
  select g.lang, g.source, g.rate, case when g.n >= 20 and g.q3 <= l.most then g.most else l.most end as most
  from own g join by_language l on g.level = 2 and g.lang is not distinct from l.lang and g.rate = l.rate),
beyond as (select distinct l.doc_id from long l join fences f on l.lang is not distinct from f.lang and l.source is not distinct from f.source and l.rate = f.rate where l.x > f.most)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and b.doc_id is null as kept
from rates left join beyond b using (doc_id)
"""
