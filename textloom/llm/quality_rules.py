"""Quality rules as a short-circuit cascade, in Spark SQL functions only.

The base figures of each text are computed in one projection. The further rules reject on ratios; what they count beyond the base
is part of their own condition, so a document that an earlier rule rejects never pays for it. Their cost and selectivity are
estimated on a bounded sample, and they are tried in order of rejections per cost in one CASE, so a document stops at the first
rule that rejects it. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, materialise, one_each, spread

#: Documents on which costs and selectivities are estimated, and how often each is judged to time a rule.
SAMPLE_ROWS, REPEATS = 1000, 5
LEAST_WORDS = 50

_W = r"[^\\x20\\x09-\\x0D]+"

#: Start positions of the 3-word windows found twice or more, from the sorted windows ``s``.
_STARTS = """array_sort(filter(transform(sequence(1, size(s)), k ->
  if((k > 1 and s[k - 2].h = s[k - 1].h and s[k - 2].t = s[k - 1].t) or (k < size(s) and s[k].h = s[k - 1].h and s[k].t = s[k - 1].t), s[k - 1].i, null)),
  x -> x is not null))"""
#: Windows are sorted by hash and then by their words, so equal ones are neighbours whatever the hash does. Each lambda over a
#: one-element array gives a value a name, so that it is computed once.
_REPEATS = f"""case when size(w) < 4 then 0 else
  transform(array(sort_array(transform(sequence(1, size(w) - 2), i -> struct(xxhash64(w[i - 1], w[i], w[i + 1]) as h, concat_ws(' ', w[i - 1], w[i], w[i + 1]) as t, i as i)))), s ->
    aggregate({_STARTS}, struct(0 as upto, 0 as n), (a, p) -> struct(p + 3 as upto, a.n + p + 3 - greatest(p, a.upto) as n)).n)[0] end"""
_MEASURE = f"""transform(array(regexp_extract_all(text, '{_W}', 0)), w -> struct(
  cast(size(w) as bigint) as n_words,
  cast({_REPEATS} as bigint) as n_repeat_words))[0]"""

#: Further rules: (name, SQL condition that rejects). They may read the base figures and the text ``text``.
RULES = (
    ("symbols", "5 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("few_distinct", f"12 * size(array_distinct(regexp_extract_all(text, '{_W}', 0))) < n_words"),
    ("dup_lines", f"n_dup_lines > 0 and 2 * n_dup_lines > size(filter(split(text, '\\n', -1), l -> l rlike '{_W}'))"),
    ("shouting", r"10 * (char_length(text) - char_length(regexp_replace(text, '\\p{Lu}', ''))) > 4 * word_chars"),
    ("exclaiming", "3 * (char_length(text) - char_length(replace(text, '!', ''))) > n_words"),
)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base figures. A null text counts as empty."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        F.expr(_MEASURE).alias("m"),
        F.expr(r"cast(char_length(translate(text, ' \t\n\u000b\u000c\r', '')) as bigint)").alias("word_chars"),
        F.expr("cast(char_length(text) - char_length(translate(text, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr(f"transform(array(filter(split(text, '\\n', -1), l -> l rlike '{_W}')), x -> cast(size(x) - size(array_distinct(x)) as bigint))[0]").alias("n_dup_lines"),
    )
    return rows.select("doc_id", "text", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")


BASE_FAILED = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words"


def estimated(docs: DataFrame, rules: tuple = RULES, sample_rows: int = SAMPLE_ROWS, repeats: int = REPEATS) -> list[tuple[str, int, float]]:
    """(name, rejections, seconds a document) of each rule on a sample of documents that pass the base.

    All rejections come from one job. A rule's time is that of judging every document ``repeats`` times in a single task less that of
    as many trivial judgements, so that starting the job counts for nothing.
    """
    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).distinct()
    # At most ``sample_rows`` ids are broadcast, so no text but theirs is shuffled. A repeated id counts once.
    own = one_each(docs.select("doc_id", binary_text()).join(F.broadcast(chosen), "doc_id", "left_semi")).select("doc_id", F.col("text").cast("string").alias("text"))
    table = materialise(measured(own), "rules").where(f"not ({BASE_FAILED})")
    n, *rejected = table.agg(F.count("*"), *[F.expr(f"count_if({condition})") for _, condition in rules]).first()
    again = table.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).coalesce(1)

    def seconds(condition: str) -> float:
        began = time.perf_counter()
        again.agg(F.expr(f"count_if({condition})")).first()
        return time.perf_counter() - began

    if not n:
        return [(name, 0, 0.0) for name, _ in rules]
    floor = min(seconds("n_words < 0") for _ in range(3))
    return [(name, k, max(min(seconds(condition) for _ in range(2)) - floor, 0.0) / (n * repeats)) for (name, condition), k in zip(rules, rejected, strict=True)]


def ordered(docs: DataFrame, rules: tuple = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """Rules by estimated rejections per cost, best first; equals by cost. Ties and an empty sample keep the given order."""
    # Half a microsecond is what times differ by from run to run.
    worth = {name: (-rejected / max(cost, 5e-7), cost) for name, rejected, cost in estimated(docs, rules, sample_rows)}
    return sorted(rules, key=lambda r: worth[r[0]])


def judge(docs: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no word and fails the base. Repeated rows each come back, other columns are ignored, an empty table
    gives no rows.
    """
    docs = spread(docs)
    rules = ordered(docs) if rules is None else rules
    cascade = "case when base_failed then false " + " ".join(f"when {condition} then false" for _, condition in rules) + " else true end"
    rows = measured(docs).withColumn("base_failed", F.expr(BASE_FAILED))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(cascade).alias("kept"))


#: DuckDB SQL for ``judge`` over the table documents.
ORACLE = r"""
with d as (select rowid as r, doc_id, coalesce(text, '') as text from (select *, row_number() over () as rowid from documents)),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select r, i from (select r, i, count(*) over (partition by r, t) as c from g) where c > 1),
cov as (select r, count(*) as n from (select distinct r, i + unnest([0, 1, 2]) as j from rep) group by r),
m as (select w.r, doc_id, text, len(w)::bigint as n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as l, coalesce(cov.n, 0)::bigint as n_repeat_words,
  len(list_distinct(w))::bigint as n_distinct from w left join cov on w.r = cov.r),
f as (select *, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l)::bigint as n_lines,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 5 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 14 * n_words or 12 * n_distinct < n_words or 2 * n_dup_lines > n_lines
    or 10 * (len(text) - len(regexp_replace(text, '\p{Lu}', '', 'g'))) > 4 * word_chars or 3 * (len(text) - len(replace(text, '!', ''))) > n_words) as kept
from f
"""
