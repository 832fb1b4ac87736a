"""Queries over the driver's tables and the DuckDB SQL that checks them.

``documents`` stand for files: their path is made of source, id and language. ``conversations`` are ledgers, ``events`` timed
artifacts. Where a rule needs text that the tables lack (fences, style words, packs), both sides build it from the same rows.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cost, paths, text
from ..operators import analysis, chunks, corpus, finalise, ledger, switches, validate, writing
from ..sources import ignored, models, packed, splits
from ..streaming import retention
from ..workspace import removed, shared_folder, shuffles_dropped, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PRICE_IN, PRICE_OUT = paths.PROVIDERS["anthropic"][1:3]
CHUNKS = chunks.ChunkConfig(1000, 100)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files."""
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".ts").when(F.col("lang") == "de", ".rs").otherwise(".txt")
    path = F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), ext)
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), path.alias("path"), "source", F.coalesce("text", F.lit("")).alias("original_content"))
    return docs.withColumn("language", paths.language(F.col("path")))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files, without their surplus white space."""
    return corpus.compressed(_sources(spark, sf))


_F = """f as (select *, strlen(original_content)::bigint as original_size, strlen(compressed_content)::bigint as compressed_size,
  case when path like '%.py' then 'python' when path like '%.ts' then 'typescript' when path like '%.rs' then 'rust' end as language from (
  select *, case when len(ls) > 0 then array_to_string(ls, chr(10)) || chr(10) else '' end as compressed_content from (
  select *, [y for y in [trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g')) for x in string_split(original_content, chr(10))] if y <> ''] as ls from (
  select doc_id as ord, source, source || '/doc' || doc_id || case lang when 'en' then '.py' when 'fr' then '.ts' when 'de' then '.rs' else '.txt' end as path,
  coalesce(text, '') as original_content from documents))))"""
_TOK = "((strlen(compressed_content) + 3) // 4)"


@query(f"with {_F} select ord, path, compressed_content, compressed_size from f")
def whitespace_compress(spark, sf):
    return _files(spark, sf).select("ord", "path", "compressed_content", "compressed_size")


@query("select doc_id, ((strlen(text) + 3) // 4)::bigint as tokens_up, (strlen(text) // 4)::bigint as tokens_down, len([w for w in regexp_split_to_array(text, '\\s+') if w <> ''])::bigint as words from documents")
def token_estimates(spark, sf):
    c = F.col("text")
    return _table(spark, sf, "documents").select("doc_id", text.tokens_up(c).alias("tokens_up"), text.tokens_down(text.byte_size(c)).alias("tokens_down"), text.word_count(c).alias("words"))


@query(f"with {_F} select coalesce(language, 'unknown') as language, count(*) as files, sum(original_size)::bigint as original_size, sum(compressed_size)::bigint as compressed_size, sum{_TOK}::bigint as tokens, case when sum(compressed_size) < sum(original_size) and sum(compressed_size) > 0 then trunc((1.0::double - sum(compressed_size)::double / sum(original_size)::double) * 100)::int end as reduction_percent, sum{_TOK}::double / 1000.0::double * 0.003::double + (4096 + 500 * 3)::double / 1000.0::double * 0.015::double as estimated_cost from f group by 1")
def dry_run_report(spark, sf):
    return corpus.dry_run(_files(spark, sf), 3, PRICE_IN, PRICE_OUT)


@query(f"with {_F} select count(*) as total_files, sum(original_size)::bigint as total_original_size, sum(compressed_size)::bigint as total_compressed_size, sum(compressed_size)::double / sum(original_size)::double as compression_ratio from f")
def corpus_metadata(spark, sf):
    return corpus.metadata(_files(spark, sf))


@query(f"with {_F} select language, count(*) as files from f where language is not null group by 1")
def language_histogram(spark, sf):
    return corpus.language_histogram(_files(spark, sf))


@query(f"""with {_F}, m as (select original_size, case when source in ('src1', 'src3') then 'none' when language = 'python' and instr(original_content, chr(10)) > 0 then 'structural' else 'whitespace' end as compression_method,
  case when source in ('src1', 'src3') then original_size when language = 'python' and instr(original_content, chr(10)) > 0 then strlen(split_part(original_content, chr(10), 1)) else compressed_size end as compressed_size from f)
select compression_method, count(*) as files, sum(original_size)::bigint as original_size, sum(compressed_size)::bigint as compressed_size from m group by 1""")
def method_breakdown(spark, sf):
    """Two projects without compression; elsewhere the first line stands for an outline, which texts of a single line don't have."""
    c = F.col("original_content")
    outline = F.when((F.col("language") == "python") & c.contains("\n"), F.substring_index(c, "\n", 1))
    return corpus.method_breakdown(corpus.compressed(_sources(spark, sf), outline, ~F.col("source").isin("src1", "src3")))


@query(f"with {_F}, t as (select coalesce(language, 'unknown') as language, path, {_TOK}::bigint as tokens, row_number() over (partition by coalesce(language, 'unknown') order by {_TOK} desc, path) as rank from f) select language, count(*) as files, sum(tokens)::bigint as tokens, string_agg(path || ':' || tokens, ',' order by rank) filter (where rank <= 3) as top_files, greatest(count(*) - 3, 0)::bigint as more from t group by 1")
def tokens_by_language(spark, sf):
    return corpus.by_language(_files(spark, sf))


@query("with h as (select source as language, count(*) as files from documents group by 1), r as (select *, row_number() over (order by files desc, language) as k from h) select case when k <= 3 then language else 'other' end as language, sum(files)::bigint as files from r group by 1")
def language_top3_other(spark, sf):
    return corpus.top_languages(_table(spark, sf, "documents").groupBy(F.col("source").alias("language")).agg(F.count("*").alias("files")))


@query(f"with {_F} select source || '/' || ord // 100 as project, sha256(string_agg('--- ' || path || ' ---' || chr(10) || compressed_content || chr(10) || chr(10), '' order by ord)) as sha256 from f group by 1")
def formatted_corpus(spark, sf):
    """Projects of a hundred files at most."""
    files = _files(spark, sf).withColumn("project", F.concat("source", F.lit("/"), F.expr("ord div 100").cast("string")))
    return corpus.formatted_corpus(files, "project").select("project", F.sha2(F.col("corpus").cast("binary"), 256).alias("sha256"))


_LEDGER = "l as (select conv_id, turn, len(text)::bigint as input_tokens, (strlen(text) // 4)::bigint as output_tokens from conversations)"


def _ledger(spark, sf):
    return _table(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("input_tokens"), text.tokens_down(text.byte_size(F.col("text"))).alias("output_tokens"))


@query(f"with {_LEDGER}, r as (select *, sum(input_tokens) over w as running_in, sum(output_tokens) over w as running_out, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as m from l window w as (partition by conv_id order by turn rows unbounded preceding)) select conv_id, turn, running_in::bigint as running_in, running_out::bigint as running_out, running_in::double / 1000.0::double * 0.003::double + running_out::double / 1000.0::double * 0.015::double as running_cost, (running_in::double / 1000.0::double * 0.003::double + running_out::double / 1000.0::double * 0.015::double) - ((running_in - input_tokens)::double / 1000.0::double * 0.003::double + (running_out - output_tokens)::double / 1000.0::double * 0.015::double) as cost_delta, k || ' of ' || m as place from r")
def running_cost(spark, sf):
    return ledger.running_cost(_ledger(spark, sf), "conv_id", "turn", PRICE_IN, PRICE_OUT)


@query(f"with {_LEDGER}, s as (select conv_id, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, count(*) as operations from l group by 1), t as (select *, input_tokens + output_tokens as total_tokens, input_tokens::double / 1000.0::double * 0.003::double + output_tokens::double / 1000.0::double * 0.015::double as total_cost from s) select *, total_cost / operations as average_cost from t")
def ledger_summary(spark, sf):
    return ledger.summary(_ledger(spark, sf), PRICE_IN, PRICE_OUT, "conv_id")


@query("with l as (select conv_id, role as operation, sum(len(text))::bigint as input_tokens, sum(strlen(text) // 4)::bigint as output_tokens, count(*) as operations from conversations group by 1, 2), t as (select *, input_tokens + output_tokens as total_tokens, input_tokens::double / 1000.0::double * 0.003::double + output_tokens::double / 1000.0::double * 0.015::double as total_cost from l) select *, total_cost / operations as average_cost from t")
def call_ledger(spark, sf):
    """Calls of each conversation by operation, as the cost report of a run has them."""
    calls = _table(spark, sf, "conversations").select("conv_id", F.col("role").alias("operation"), F.char_length("text").cast("long").alias("input_tokens"), text.tokens_down(text.byte_size(F.col("text"))).alias("output_tokens"))
    return ledger.summary(calls, PRICE_IN, PRICE_OUT, "conv_id", "operation")


_CHUNKS = """n as (select doc_id, text, len(text)::bigint as n, case when len(text) <= 1000 then 1 else ceil(len(text) / 900.0)::bigint end as k from documents),
w as (select doc_id, text, n, i::int as chunk_id, case when i = 0 then 0 else i * 900 - 100 end::bigint as start, case when i = 0 then least(n, 1000) else least(n, (i + 1) * 900) end::bigint as "end" from (select *, unnest(range(k)) as i from n))"""


@query(f"""with {_CHUNKS} select doc_id, chunk_id, start, "end", substr(text, start + 1, "end" - start) as content, "end" - start as token_count, case when chunk_id = 0 then 0 else least(100, "end" - start) end::bigint as overlap_token_count from w""")
def chunk_text(spark, sf):
    return chunks.chunked(_table(spark, sf, "documents"), "doc_id", "text", CHUNKS)


@query(f"""with {_CHUNKS}, t as (select *, substr(text, greatest("end" - 100, start) + 1, "end" - greatest("end" - 100, start)) as tail from w),
z as (select *, case when "end" < n and contains(tail, chr(10)) then "end" - instr(reverse(tail), chr(10)) + 1 else "end" end::bigint as e from t)
select doc_id, chunk_id, start, e as "end", substr(text, start + 1, e - start) as content, e - start as token_count, case when chunk_id = 0 then 0 else least(100, e - start) end::bigint as overlap_token_count from z""")
def chunk_newlines(spark, sf):
    return chunks.chunked(_table(spark, sf, "documents"), "doc_id", "text", CHUNKS, newline_within=100)


@query(f"""with {_CHUNKS}, g as (select doc_id, count(*) as chunks, sum("end" - start)::bigint as chunk_tokens from w group by 1), h as (select *, (chunk_tokens + case when chunks > 1 then 10000 else 0 end + 1000)::bigint as input_tokens, (chunks * 4096 + case when chunks > 1 then 4096 else 0 end + 1000)::bigint as output_tokens from g) select *, input_tokens::double / 1000.0::double * 0.003::double + output_tokens::double / 1000.0::double * 0.015::double as estimated_cost from h""")
def pre_run_breakdown(spark, sf):
    return ledger.pre_run(chunks.chunked(_table(spark, sf, "documents"), "doc_id", "text", CHUNKS), "doc_id", 2, PRICE_IN, PRICE_OUT)


def _by_characters(key: str, texts: str) -> str:
    """SQL for chunks of the texts of ``key`` (a table or query with key and t), character by character with its bytes: a chunk begins with the first character from
    its window's start on and ends with the last that fits."""
    return f"""txt as ({texts}), ch as (select {key}, j, substr(t, j::int, 1) as c from (select {key}, t, unnest(range(1, len(t) + 1)) as j from txt)),
pos as (select {key}, j, sum(strlen(c)) over (partition by {key} order by j rows unbounded preceding) as e, strlen(c) as w from ch), cp as (select {key}, j, (e - w)::bigint as s, e::bigint as e from pos),
win as (select {key}, t, n, i::bigint as i, case when i = 0 then 0 else i * 3600 - 400 end::bigint as lo from (select {key}, t, strlen(t) as n, unnest(range(case when strlen(t) <= 4000 then 1 else ceil(strlen(t) / 3600.0)::bigint end)) as i from txt)),
beg as (select win.{key}, t, i, n, cp.j, cp.s from win asof join cp on win.{key} = cp.{key} and cp.s >= win.lo), fin as (select beg.{key}, i, beg.t, beg.j as a, beg.s, cp.j as b, cp.e from beg asof join cp on beg.{key} = cp.{key} and cp.e <= beg.s + 4000)
select {key}, i::int as chunk_id, s as start, e as "end", substr(t, a::int, (b - a + 1)::int) as content, ((e - s + 3) // 4)::bigint as token_count, case when i = 0 then 0 else (greatest(least(i * 3600, e) - s, 0) + 3) // 4 end::bigint as overlap_token_count from fin"""


@query(f"""with {_F}, ent as (select source, ord, '--- ' || path || ' ---' || chr(10) || compressed_content || chr(10) || chr(10) as e from f), {_by_characters("source", "select source, string_agg(e, '' order by ord) as t from ent group by 1")}""")
def chunk_tokens(spark, sf):
    return chunks.token_chunks(_files(spark, sf).withColumn("entry", text.corpus_entry(F.col("path"), F.col("compressed_content"))), "source", "ord", "entry", CHUNKS)


@query(f"""with {_by_characters("doc_id", "select doc_id, '--- content ---' || chr(10) || coalesce(text, '') || chr(10) || chr(10) as t from documents")}""")
def text_chunks(spark, sf):
    """Each document cut by itself."""
    return chunks.text_chunks(_table(spark, sf, "documents"), "doc_id", "text", CHUNKS.size)


@query("select conv_id, turn, text as analysis, 'anthropic' as provider, 'm' as model, 0 as formats from conversations where role = 'assistant'")
def parsed_analyses(spark, sf):
    """Answers as rules that no format has been made of."""
    answers = _table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return analysis.parsed(answers, "anthropic", "m").drop("made").withColumn("formats", F.size("formats"))


@query(f"with {_F} select source, sum((strlen(path) + 3) // 4 + (strlen(compressed_content) + 3) // 4)::bigint as corpus_tokens, sum((strlen(original_content) + 3) // 4)::bigint as original_tokens from f group by 1")
def corpus_tokens(spark, sf):
    return corpus.token_totals(_files(spark, sf), "source")


@query("with p(provider, context_limit, i, o) as (values ('anthropic', 200000, 0.003::double, 0.015::double), ('openai', 128000, 0.0025::double, 0.010::double), ('ollama', 100000, 0.0::double, 0.0::double), ('openrouter', 128000, 0.0::double, 0.0::double)), t as (select source, (sum(strlen(text)) // 4)::bigint as tokens from documents group by 1) select source, provider, tokens, tokens > context_limit as needs_chunks, tokens::double / 1000.0::double * i + 4096.0::double / 1000.0::double * o as cost from t, p")
def provider_cost_matrix(spark, sf):
    totals = _table(spark, sf, "documents").groupBy("source").agg(text.tokens_down(F.sum(text.byte_size(F.col("text")))).alias("tokens"))
    prices = F.explode(F.array(*[F.struct(F.lit(k).alias("provider"), F.lit(v[0]).alias("limit"), F.lit(v[1]).alias("i"), F.lit(v[2]).alias("o")) for k, v in paths.PROVIDERS.items()]))
    out = totals.select("source", "tokens", prices.alias("p"))
    return out.select("source", "p.provider", "tokens", (F.col("tokens") > F.col("p.limit")).alias("needs_chunks"), cost.cost(F.col("tokens"), cost.ANALYSIS_TOKENS, F.col("p.i"), F.col("p.o")).alias("cost"))


@query(r"""with t as (select doc_id, text || ' Api_key apikey=abcdefgh12 bearer ABCDEFGHIJ sk-' || doc_id || '-abcdefgh' as t from documents) select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(api[_-]?key\s*[:=]\s*)["'']?[A-Za-z0-9_\-]{8,}["'']?', '\1[REDACTED]', 'g'), '(token\s*[:=]\s*)["'']?[A-Za-z0-9_\-\.]{8,}["'']?', '\1[REDACTED]', 'g'), '(?i)(bearer\s+)[A-Za-z0-9_\-\.]{8,}', '\1[REDACTED]', 'g'), 'sk-[A-Za-z0-9_\-]{8,}', '[REDACTED]', 'g') as redacted from t""")
def redact_secrets(spark, sf):
    t = F.concat("text", F.lit(" Api_key apikey=abcdefgh12 bearer ABCDEFGHIJ sk-"), F.col("doc_id").cast("string"), F.lit("-abcdefgh"))
    return _table(spark, sf, "documents").select("doc_id", text.redacted(t).alias("redacted"))


_RAGGED = "replace(text, chr(10), case doc_id % 3 when 0 then '  ' || chr(13) || chr(10) when 1 then chr(9) || chr(13) else ' ' || chr(10) end) || repeat(chr(10), (doc_id % 4)::int)"


@query(f"with t as (select doc_id, regexp_replace(regexp_replace({_RAGGED}, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g') as t from documents) select doc_id, case when t = '' then t when t like '%' || chr(10) || chr(10) then left(t, len(t) - 1) when t like '%' || chr(10) then t else t || chr(10) end as normalised from t")
def normalize_content(spark, sf):
    ending = F.when(F.col("doc_id") % 3 == 0, "  \r\n").when(F.col("doc_id") % 3 == 1, "\t\r").otherwise(" \n")
    ragged = F.concat(F.replace("text", F.lit("\n"), ending), F.repeat(F.lit("\n"), (F.col("doc_id") % 4).cast("int")))
    return _table(spark, sf, "documents").select("doc_id", text.normalised(ragged).alias("normalised"))


_PATHS = "p as (select page_id, regexp_replace(url, '^[a-z]+://', '') || (['.ts', '.py', '/.env', '.tar.gz', '', '.RS', '.hpp', '/x.go'])[(page_id % 8 + 1)::int] as path from pages)"


def _paths(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, (".ts", ".py", "/.env", ".tar.gz", "", ".RS", ".hpp", "/x.go"))), (F.col("page_id") % 8 + 1).cast("int"))
    return _table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), tail).alias("path"))


@query(f"with {_PATHS}, e as (select page_id, path, nullif(regexp_extract(path, '[^/]\\.([^./]+)$', 1), '') as ext from p) select page_id, path, ext as extension, case when ext in ('ts','tsx') then 'typescript' when ext in ('js','jsx') then 'javascript' when ext = 'py' then 'python' when ext = 'rs' then 'rust' when ext = 'go' then 'go' when ext = 'java' then 'java' when ext in ('c','h') then 'c' when ext in ('cpp','hpp','cc','cxx') then 'cpp' when ext = 'rb' then 'ruby' when ext = 'php' then 'php' end as language from e")
def extension_language(spark, sf):
    c = F.col("path")
    return _paths(spark, sf).select("page_id", "path", paths.extension(c).alias("extension"), paths.language(c).alias("language"))


@query(f"with {_PATHS} select page_id, path from p where (regexp_matches(path, '\\.(ts|py|go)$') or path like '%.hpp') and not (path like '%1._%' or path like '%3.__')")
def include_exclude(spark, sf):
    return _paths(spark, sf).where(paths.kept_path(F.col("path"), ["**/*.{ts,py,go}", "*.hpp"], ["*1.?*", "**/*3.??"]))


_ENDS = ("/a.log", "/keep.log", "/build/x.o", "/src/build.py", "/a/tmp/b/c.txt", "/d1.md", "/notes.txt", "/src/gen/z.py")


#: Each node with the rules that match it, which are written out by hand here: five of the root, three of every site whose name begins with "blog.".
@query(rf"""with p as (select distinct regexp_replace(url, '^[a-z]+://', '') || ({list(_ENDS)})[(page_id % 8 + 1)::int] as path from pages),
s as (select path, string_split(path, '/') as x from p), up as (select path, array_to_string(x[1:i], '/') as node, i = len(x) as file, starts_with(path, 'blog.') as blog, x[i] as name from (select path, x, unnest(range(1, len(x) + 1)) as i from s)),
n as (select distinct node, file, blog, name, contains(node, '/') as below from up),
m as (select node, 0 as k, false as keep from n where name like '%.log' union all select node, 1, true from n where name = 'keep.log' union all select node, 2, false from n where not file and name = 'build'
 union all select node, 3, false from n where regexp_matches(node, '(^|/)tmp/') union all select node, 4, false from n where regexp_matches(name, '^d[0-9][.]md$')
 union all select node, 100, false from n where blog and below and regexp_matches(name, '^note.[.]txt$') union all select node, 101, true from n where blog and below and name = 'a.log'
 union all select node, 102, false from n where blog and not file and regexp_matches(node, '/src/gen$')),
v as (select node, arg_max(keep, k) as keep from m group by 1) select distinct path from up join v on up.node = v.node where not keep""")
def ignored_paths(spark, sf):
    """Files of many sites under the ignore files of the root and of some sites."""
    pages = _table(spark, sf, "pages")
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    rows = pages.select(F.concat(bare, F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % 8 + 1).cast("int"))).alias("path"))
    site = F.split_part(bare, F.lit("/"), F.lit(1))
    own = pages.select(site.alias("folder")).where(F.col("folder").startswith("blog.")).distinct().withColumn("content", F.lit("note?.txt\n!a.log\r\n\n**/src/gen/\n"))
    root = spark.createDataFrame([("", "# what tools make\n*.log\n!keep.log\nbuild/\n**/tmp/**\nd[0-9].md  \n")], "folder string, content string")
    return ignored.ignored(rows, ignored.rules(root.unionByName(own)))


#: Rules of many projects: document d is a format of project d div 6, with marks around its whole text.
_RENDERED = """r as (select doc_id, (['cursor','claude','copilot','windsurf','aider','generic'])[(doc_id % 6 + 1)::int] || ':' || (doc_id // 6) as format,
  case doc_id % 7 when 0 then '---' || chr(10) || 'description: x' || chr(10) || '---' || chr(10) when 1 then '---' || chr(10) else '' end
  || case doc_id % 5 when 0 then '# Title' || chr(10) when 1 then '```' || chr(10) when 2 then 'Use tabs. ' else '' end
  || case doc_id % 4 when 0 then 'use spaces, 4 space indent, single quotes ' when 1 then 'line length: 100 and snake_case, double quotes; omit semicolons. ' when 2 then 'always use semicolons, camelCase ' else 'dont use semicolons, Max width=88, single quotes' || chr(10) || '2-' || chr(10) || 'spaces ' end
  || coalesce(text, '')
  || case when doc_id % 3 = 0 then ' see `src0/doc' || (doc_id % 40) || '.py` or lib/none' || doc_id || '.rs, http://a/b.c and v1.2/x.y Kotlin kotlin KOTLIN' else '' end as content from documents)"""


def _rendered(spark, sf):
    d = F.col("doc_id")
    kinds = F.element_at(F.array(*map(F.lit, ("cursor", "claude", "copilot", "windsurf", "aider", "generic"))), (d % 6 + 1).cast("int"))
    content = F.concat(
        F.when(d % 7 == 0, "---\ndescription: x\n---\n").when(d % 7 == 1, "---\n").otherwise(""),
        F.when(d % 5 == 0, "# Title\n").when(d % 5 == 1, "```\n").when(d % 5 == 2, "Use tabs. ").otherwise(""),
        F.when(d % 4 == 0, "use spaces, 4 space indent, single quotes ").when(d % 4 == 1, "line length: 100 and snake_case, double quotes; omit semicolons. ").when(d % 4 == 2, "always use semicolons, camelCase ").otherwise("dont use semicolons, Max width=88, single quotes\n2-\nspaces "),
        F.coalesce("text", F.lit("")),
        F.when(d % 3 == 0, F.concat(F.lit(" see `src0/doc"), (d % 40).cast("string"), F.lit(".py` or lib/none"), d.cast("string"), F.lit(".rs, http://a/b.c and v1.2/x.y Kotlin kotlin KOTLIN"))).otherwise(""),
    )
    return _table(spark, sf, "documents").select("doc_id", F.concat(kinds, F.lit(":"), F.expr("doc_id div 6").cast("string")).alias("format"), content.alias("content"))


_BOTH = "regexp_matches(content, '(?i)\\buse\\s+tabs\\b') and regexp_matches(content, '(?i)\\buse\\s+spaces\\b')"


@query(f"with {_RENDERED} select format, ((len(content) - len(replace(content, '```', ''))) // 3) % 2 = 1 as fence_open, trim(regexp_replace(content, '\\s+', ' ', 'g')) = '' as is_empty, contains(content, '# ') as has_heading, {_BOTH} as contradiction from r")
def content_rules(spark, sf):
    c = F.col("content")
    return _rendered(spark, sf).select("format", text.fence_unbalanced(c).alias("fence_open"), validate.empty(c).alias("is_empty"), c.contains("# ").alias("has_heading"), validate.contradiction(c).alias("contradiction"))


_SYNTAX = """k as (select format, split_part(format, ':', 1) as kind, content, trim(regexp_replace(content, '\\s+', ' ', 'g')) = '' as e, ((len(content) - len(replace(content, '```', ''))) // 3) % 2 = 1 as o, case when starts_with(content, '---') then substr(content, 4) end as b from r),
syn as (select format, 'error' as severity, 'syntax' as layer, 'content is empty' as message from k where e union all select format, 'error', 'syntax', 'code fence is not closed' from k where not e and o
union all select format, 'error', 'schema', 'frontmatter is not closed' from k where kind = 'cursor' and b is not null and instr(b, '---') = 0
union all select format, 'warning', 'schema', 'frontmatter has no description' from k where kind = 'cursor' and instr(b, '---') > 0 and not contains(substr(b, 1, instr(b, '---') - 1), 'description:')
union all select format, 'error', 'schema', 'no heading' from k where kind = 'claude' and not contains(content, '# ') union all select format, 'error', 'schema', 'content is empty' from k where e and kind in ('copilot', 'windsurf', 'aider', 'generic'))"""


@query(f"with {_RENDERED}, {_SYNTAX} select format, severity, layer, message from syn")
def syntax_findings(spark, sf):
    return validate.syntax(_rendered(spark, sf)).drop("location")


_REFS = f"""x as (select distinct format, unnest(regexp_extract_all(content, '(?:^|[\\s`"''])([A-Za-z0-9_./-]+\\.[A-Za-z0-9]+)(?:[\\s`"'',;:)]|$)', 1)) as ref from r),
refs as (select * from x where not (starts_with(ref, 'http') or starts_with(ref, 'ftp') or contains(ref, '://') or regexp_matches(ref, '^v[012]\\.') or regexp_matches(ref, '\\.(com|org|io|dev)$')) and contains(ref, '/')),
files as (select distinct source || '/doc' || doc_id || case lang when 'en' then '.py' when 'fr' then '.ts' when 'de' then '.rs' else '.txt' end as path from documents),
loose as (select format, ref from refs where not exists (select 1 from files where path = ref or ends_with(ref, path) or ends_with(path, ref)))"""


@query(f"with {_RENDERED}, {_REFS} select format, ref from refs")
def path_refs(spark, sf):
    return validate.path_references(_rendered(spark, sf))


@query(f"with {_RENDERED}, {_REFS} select format, string_agg(ref, ',' order by encode(ref)) as refs from refs group by 1")
def sorted_paths(spark, sf):
    refs = F.array_join(validate.named_paths(F.col("content")), ",")
    return _rendered(spark, sf).select("format", refs.alias("refs")).where("refs <> ''")


@query(f"with {_RENDERED}, {_REFS} select format, ref from loose")
def dangling_refs(spark, sf):
    return validate.dangling(validate.path_references(_rendered(spark, sf)), _files(spark, sf))


_CONV = r"""c as (select format, case when regexp_matches(content, '(?i)\buse\s+tabs\b') then 'tabs' when regexp_matches(content, '(?i)\buse\s+spaces\b') then 'spaces' end as indentation_style, try_cast(nullif(regexp_extract(content, '(?i)(\d+)[\s-]*(?:space|indent)', 1), '') as bigint) as iw,
concat_ws(',', case when regexp_matches(content, '(?i)\bcamel\s*case\b') then 'camelCase' end, case when regexp_matches(content, '(?i)\bsnake\s*[_\s]?case\b') then 'snake_case' end) as naming, try_cast(nullif(regexp_extract(content, '(?i)(?:max(?:imum)?|line)\s*(?:line\s*)?(?:length|width|chars?)\s*(?:of\s*|:\s*|=\s*)?(\d+)', 1), '') as bigint) as ll,
case when regexp_matches(content, '(?i)\b(?:always\s+use|require|use)\s+semicolons?\b') then 'use' when regexp_matches(content, '(?i)\b(?:no|omit|avoid|don''?t\s+use)\s+semicolons?\b') then 'no' end as semicolons, case when regexp_matches(content, '(?i)\bsingle\s+quotes?\b') then 'single' when regexp_matches(content, '(?i)\bdouble\s+quotes?\b') then 'double' end as quote_style from r),
s as (select * exclude (ll, iw), case when iw <= 4294967295 then iw end as indent_width, case when ll between 40 and 500 then ll end as line_length from c)"""


@query(f"with {_RENDERED}, {_CONV} select format, indentation_style, indent_width, naming, line_length, semicolons, quote_style from s")
def convention_extraction(spark, sf):
    return validate.conventions(_rendered(spark, sf))


def _long(names: tuple[str, ...]) -> str:
    return " union all ".join(f"select format, split_part(format, ':', 2) as project, '{n}' as name, {n}::varchar as value from s" for n in names)


_CONFLICTS = f"lc as ({_long(validate.CONFLICTING)}), conflicts as (select project, name, string_agg(format || '=' || value, ', ' order by encode(format || '=' || value)) as stated from lc where value is not null group by all having count(distinct value) > 1)"
_MISSING = f"lm as ({_long(validate.REQUIRED)}), missing as (select project, name, string_agg(format, ', ' order by encode(format)) filter (where value is null) as without from lm group by project, name having count(*) >= 2 and count(value) > count(*) // 2 and count(value) < count(*))"


@query(f"with {_RENDERED}, {_CONV}, {_CONFLICTS} select project, name, stated from conflicts")
def cross_format_conflicts(spark, sf):
    return validate.conflicts(validate.conventions(_rendered(spark, sf)))


@query(f"with {_RENDERED}, {_CONV}, {_MISSING} select project, name, without from missing")
def cross_format_missing(spark, sf):
    return validate.missing(validate.conventions(_rendered(spark, sf)))


_UNREAL = "unreal as (select format, 'kotlin' as language, ((len(content) - len(regexp_replace(lower(content), '\\bkotlin\\b', '', 'g'))) // 6)::bigint as mentions from r where regexp_matches(lower(content), '(?s)\\bkotlin\\b.*\\bkotlin\\b.*\\bkotlin\\b'))"


@query(f"with {_RENDERED}, {_UNREAL} select format, language, mentions from unreal")
def language_reality(spark, sf):
    return validate.language_mentions(_rendered(spark, sf), _files(spark, sf))


@query("""with j as (select event_id, case event_id % 6 when 0 then props when 1 then props || ' x' when 2 then '{}' when 3 then 'null' when 4 then '[' || props || ']' else '{"a": ' end as c from events)
select event_id, case when not json_valid(c) then 'syntax' when json_type(c) = 'NULL' or c = '{}' then 'schema' end as problem from j""")
def json_validity(spark, sf):
    e, p = F.col("event_id"), F.col("props")
    content = F.when(e % 6 == 0, p).when(e % 6 == 1, F.concat(p, F.lit(" x"))).when(e % 6 == 2, "{}").when(e % 6 == 3, "null").when(e % 6 == 4, F.concat(F.lit("["), p, F.lit("]"))).otherwise('{"a": ')
    rows = _table(spark, sf, "events").select("event_id", content.alias("content"))
    return rows.select("event_id", validate.json_problem(F.col("content")).alias("problem"))


@query("select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc)::int as age_rank from events qualify age_rank > 5")
def retention_newest5(spark, sf):
    return writing.expired_backups(_table(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "age_rank")


@query("select event_id, user_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) > 5")
def retention_stream(spark, sf):
    """The same as a stream: every event that a newer one of its user pushes out of the newest five."""
    retention.ready(spark)
    home = f"{shared_folder(spark)}/retention-{uuid.uuid4().hex}"
    events = spark.readStream.schema(_table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")  # a pattern, since a plain path would have to be a folder
    out = retention.expired(events, "user_id", "ts", "event_id")
    out.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{home}/out").select("event_id", "user_id")


@query("with n as (select max(ts) - interval 1 hour as t from events) select count_if(t - ts > interval 24 hours)::bigint as deleted, count_if(t - ts <= interval 24 hours and ts <= t)::bigint as kept, count_if(ts > t)::bigint as skipped from events, n")
def age_cleanup(spark, sf):
    events = _table(spark, sf, "events")
    now = events.agg(F.max("ts")).first()[0]  # one value
    return writing.cleanup_counts(events, F.col("ts"), F.lit(now) - F.expr("interval 1 hour"))


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1")
def last_write_wins(spark, sf):
    return writing.last_write(_table(spark, sf, "events"), "user_id", "event_id", "event_type", "value")


#: Requests by users; outputs that errors name are overridden, and those that purchases name exist.
_REQ = """d(format, p) as (values ('cursor', '.cursor/rules/project.mdc'), ('claude', 'CLAUDE.md'), ('copilot', '.github/copilot-instructions.md'), ('windsurf', '.windsurfrules'), ('aider', '.aider.conf.yml'), ('generic', 'AI_RULES.md'), ('json', 'AI_RULES.json')),
e as (select event_type, value, (['cursor','claude','copilot','windsurf','aider','generic','json'])[(user_id % 7 + 1)::int] as format, (['prompt','overwrite','skip','smart-merge','whatever'])[((props->>'$.k')::int % 5 + 1)::int] as strategy, coalesce(value, 0) >= 20 as interactive from events),
o as (select format, 'docs/' || format || '.md' as override from e where event_type = 'error' and value > 30 group by 1), x as (select distinct case when value > 20 then 'docs/' || format || '.md' else p end as path from e join d using (format) where event_type = 'purchase' and value > 15),
q as (select e.*, coalesce(override, p) as path from e join d using (format) left join o using (format))"""


@query(f"""with {_REQ}, a as (select q.*, x.path is not null as e from q left join x on q.path = x.path)
select format, path, e as exists, strategy, interactive, case when not e then 'create' when strategy in ('overwrite', 'skip') then strategy when not interactive then 'error' when strategy = 'smart-merge' then 'merge' else 'ask' end as action, count(*) as requests from a group by all""")
def conflict_actions(spark, sf):
    pick = lambda i, xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    k = F.get_json_object("props", "$.k").cast("int")
    rows = _table(spark, sf, "events").select("event_type", "value", pick(F.col("user_id"), tuple(paths.FORMATS)).alias("format"), pick(k, (*writing.STRATEGIES, "whatever")).alias("strategy"), (F.coalesce("value", F.lit(0.0)) >= 20).alias("interactive"))
    own = F.concat(F.lit("docs/"), "format", F.lit(".md"))
    overrides = rows.where("event_type = 'error' and value > 30").select("format", own.alias("override")).distinct()
    existing = rows.where("event_type = 'purchase' and value > 15").select(F.when(F.col("value") > 20, own).otherwise(paths.output_path(F.col("format"), F.lit(None).cast("string"))).alias("path")).distinct()
    planned = writing.planned_writes(rows.select("format", "strategy", "interactive"), overrides, existing)
    return planned.groupBy(*planned.columns).agg(F.count("*").alias("requests"))


@query("select conv_id, turn, least(1000 * pow(2, least(turn, 10)), 60000)::bigint as delay_ms, least(round(0.7::double + 0.1::double * (turn - 1), 6), 0.9::double) as temperature from conversations")
def retry_schedule(spark, sf):
    a = F.col("turn")
    return _table(spark, sf, "conversations").select("conv_id", "turn", cost.backoff_ms(a).alias("delay_ms"), cost.fix_temperature(a).alias("temperature"))


#: Pages as packs: their names end as their addresses' lengths say, and their texts hold what pages hold, with marks of packs in some.
_MARKED = """m as (select page_id, regexp_replace(url, '[?#].*', '') || (['.xml', '.JSON', '.markdown', '', '/x', '', ''])[(len(url) % 7 + 1)::int] as path,
  case when contains(html, '***') then replace(html, '<title>', '<file path="t">') when contains(html, '###') then chr(10) || '## File: t' || html when len(html) % 3 = 0 then '  {"h": ' || html else html end as content from pages)"""


@query(f"""with {_MARKED}, e as (select *, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) as ext from m) select page_id, case when ext = 'xml' then 'xml' when ext = 'json' then 'json' when ext in ('md', 'markdown') then 'markdown'
  when contains(content, '<file path=') then 'xml' when left(ltrim(content), 1) in ('{{', '[') then 'json' when contains(content, '## File:') then 'markdown' else 'unknown' end as kind from e""")
def format_detect(spark, sf):
    h, u = F.col("html"), F.col("url")
    path = F.concat(F.regexp_replace(u, "[?#].*", ""), F.element_at(F.array(*map(F.lit, (".xml", ".JSON", ".markdown", "", "/x", "", ""))), (F.char_length(u) % 7 + 1).cast("int")))
    content = F.when(h.contains("***"), F.replace(h, F.lit("<title>"), F.lit('<file path="t">'))).when(h.contains("###"), F.concat(F.lit("\n## File: t"), h)).when(F.char_length(h) % 3 == 0, F.concat(F.lit('  {"h": '), h)).otherwise(h)
    return _table(spark, sf, "pages").select("page_id", paths.packed_format(path, content).alias("kind"))


#: Packs of at most 30 whole texts. Those that Markdown fences or XML can't carry unchanged go into JSON, in either of its forms.
_PACK = r"""select pack, (row_number() over (partition by pack order by case when pack like '%.json' and doc_id // 30 % 2 = 1 then encode(path) end, doc_id) - 1)::int as ord, path, content from (select doc_id, 'pack' || (doc_id // 30) || (['.md','.json','.xml'])[kind + 1] as pack, source || '/' || doc_id || '.txt' as path, content
  from (select doc_id, source, coalesce(text, '') as content, case when regexp_matches(coalesce(text, ''), '[`\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]') then 1 else doc_id % 3 end::int as kind from documents))"""


@query(_PACK)
def packed_files(spark, sf):
    t = F.coalesce("text", F.lit(""))
    kind = F.when(t.rlike(r"[`\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]"), 1).otherwise(F.col("doc_id") % 3).cast("int")
    docs = _table(spark, sf, "documents").select("doc_id", F.expr("doc_id div 30").alias("pack"), kind.alias("kind"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), t.alias("t"))
    escaped = F.replace(F.replace(F.replace("t", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    body = F.when(F.col("doc_id") % 2 == 0, escaped).when(F.col("t").contains("]]>"), escaped).otherwise(F.concat(F.lit("<![CDATA["), "t", F.lit("]]>")))
    part = F.when(F.col("kind") == 0, F.concat(F.lit("## File: "), "path", F.lit("\n\n```text\n"), "t", F.lit("```\n\n"))).when((F.col("kind") == 1) & (F.col("pack") % 2 == 1), F.regexp_replace(F.to_json(F.create_map("path", "t")), r"(?s)^\{(.*)\}\z", "$1")).when(F.col("kind") == 1, F.to_json(F.struct("path", F.col("t").alias("content")))).otherwise(F.concat(F.lit('<file path="'), "path", F.lit('">'), body, F.lit("</file>")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("p")))), lambda r: r["p"])
    packs = docs.groupBy("pack", "kind").agg(parts.alias("parts"))
    name = F.concat(F.lit("pack"), F.col("pack").cast("string"), F.element_at(F.array(F.lit(".md"), F.lit(".json"), F.lit(".xml")), F.col("kind") + 1))
    table = F.concat(F.lit('{"files": {'), F.array_join("parts", ","), F.lit("}}"))
    content = F.when(F.col("kind") == 0, F.array_join("parts", "")).when((F.col("kind") == 1) & (F.col("pack") % 2 == 1), table).when(F.col("kind") == 1, F.concat(F.lit("["), F.array_join("parts", ","), F.lit("]"))).otherwise(F.concat(F.lit("<files>"), F.array_join("parts", ""), F.lit("</files>")))
    return packed.parsed(packs.select(name.alias("path"), content.alias("content")))


#: Each document in a pack of every kind that can carry it unchanged.
_SPLIT = r"""select kind, pack, (row_number() over (partition by kind, pack order by doc_id) - 1)::int as ord, path, content from (select doc_id, doc_id // 2000 as pack, source || '/' || doc_id || '.txt' as path, coalesce(text, '') as content from documents), (values ('array'), ('map'), ('markdown'), ('xml')) k(kind)
  where kind in ('array', 'map') or kind = 'markdown' and not contains(content, '`') or kind = 'xml' and not regexp_matches(content, '[\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]')"""


#: Packs of all kinds hold texts four times, as they are, and so take several times the disk of a compressed table. They are written and read in so many parts at most, each of so
#: many packs at least; those of a part are deleted when it has been read.
WAVES, LEAST_PACKS = 8, 8


def _waves(docs: DataFrame, size: int) -> list[Column]:
    """Which documents are in each part: whole packs of ``size`` ids, in order of ids, so that a table in that order is read once in all."""
    d, pack = F.col("doc_id"), F.expr(f"doc_id div {size}")
    n, last = docs.agg(F.countDistinct(pack), F.max(pack)).first()
    waves = min(WAVES, n // LEAST_PACKS)
    found = docs.agg(F.percentile_approx(pack, [i / waves for i in range(1, waves)])).first()[0] if waves > 1 else []
    bounds = sorted({(b + 1) * size for b in found if 0 <= b < last})  # below zero "div" isn't a floor; no part is empty
    if not bounds:
        return [F.lit(True)]
    return [d.isNull() | (d < bounds[0]), *[(d >= a) & (d < b) for a, b in itertools.pairwise(bounds)], d >= bounds[-1]]


@query(_SPLIT)
def pack_splits(spark, sf):
    """Packs of two thousand documents, written as files and read again in ranges much shorter than a pack."""
    docs, done = _table(spark, sf, "documents"), []
    with shuffles_dropped(spark):
        for held in _waves(docs, 2000):
            home = f"{shared_folder(spark)}/packs-{uuid.uuid4().hex}"
            _packs(docs.where(held), 2000).write.partitionBy("kind", "pack").text(home)
            found = splits.read(spark, f"{home}/*/*", 1 << 16, lambda df: staged(df, "ranges"))
            at = lambda name: F.regexp_extract("pack", f"/{name}=([^/]+)/", 1)
            rows = found.select(at("kind").alias("kind"), at("pack").cast("long").alias("pack"), "ord", "path", "content")
            # The same text from packs of all kinds stands side by side, and takes little more room than once.
            done.append(staged(rows.repartition("path").sortWithinPartitions("path"), "parsed", compression="zstd"))
            removed(spark, home)
    return functools.reduce(DataFrame.unionByName, done)


def _packs(docs: DataFrame, size: int) -> DataFrame:
    """(kind, pack, value): the lines of packs, in order."""
    t = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.expr(f"doc_id div {size}").alias("pack"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), t.alias("t"))
    kinds = F.explode(F.array(*map(F.lit, ("array", "map", "markdown", "xml")))).alias("kind")
    carried = (F.col("kind").isin("array", "map")) | (F.col("kind") == "markdown") & ~F.col("t").contains("`") | (F.col("kind") == "xml") & ~F.col("t").rlike(r"[\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]")
    docs = docs.repartition("pack").select("*", kinds).where(carried)  # before texts are there four times
    escaped = F.replace(F.replace(F.replace("t", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    body = F.when((F.col("doc_id") % 2 == 0) | F.col("t").contains("]]>"), escaped).otherwise(F.concat(F.lit("<![CDATA["), "t", F.lit("]]>")))
    whole = Window.partitionBy("kind", "pack").orderBy("doc_id")
    first, last = F.lag("doc_id").over(whole).isNull(), F.lead("doc_id").over(whole).isNull()
    comma = F.when(first, "").otherwise(",")
    value = (
        F.when(F.col("kind") == "array", F.concat(comma, F.to_json(F.struct("path", F.col("t").alias("content")))))
        .when(F.col("kind") == "map", F.concat(comma, F.regexp_replace(F.to_json(F.create_map("path", "t")), r"(?s)^\{(.*)\}\z", "$1")))
        .when(F.col("kind") == "markdown", F.concat(F.lit("## File: "), "path", F.lit("\n\n```text\n"), "t", F.lit("```\n")))
        .otherwise(F.concat(F.lit('<file path="'), "path", F.lit('">'), body, F.lit("</file>")))
    )
    opening = F.when(F.col("kind") == "array", "[").when(F.col("kind") == "map", '{"files": {').when(F.col("kind") == "markdown", "# Pack").otherwise("<files>")
    closing = F.when(F.col("kind") == "array", "]").when(F.col("kind") == "map", "}}").when(F.col("kind") == "markdown", "").otherwise("</files>")
    lines = docs.select("kind", "pack", "doc_id", F.concat(F.when(first, F.concat(opening, F.lit("\n"))).otherwise(""), value, F.when(last, F.concat(F.lit("\n"), closing)).otherwise("")).alias("value"))
    return lines.sortWithinPartitions("kind", "pack", "doc_id").drop("doc_id")


_SAID = "m as (select doc_id, coalesce(text, '') || (['Rate limit reached', 'network unreachable', 'HTTP 503', 'HTTP 404 not found', 'Server Error in model', 'invalid key'])[(doc_id % 6 + 1)::int] as t from documents)"


@query(f"with {_SAID} select doc_id, regexp_matches(t, '(?i)rate limit|network|timed? ?out|connection') or regexp_matches(t, 'HTTP 50[0-4]|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout|(?i:server error)') as retry from m")
def retryable_errors(spark, sf):
    messages = ("Rate limit reached", "network unreachable", "HTTP 503", "HTTP 404 not found", "Server Error in model", "invalid key")
    m = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, messages)), (F.col("doc_id") % 6 + 1).cast("int")))
    return _table(spark, sf, "documents").select("doc_id", paths.retryable(m).alias("retry"))


_NAMED = "p as (select doc_id, coalesce(text, '') || (['Python and Rust', ' TypeScript', ' C++ code', 'gpt-4o', ' claude python', ' trusty', ' golang', ' a C# file', ' JAVA', ' javascript o1'])[(doc_id % 10 + 1)::int] as t from documents)"


@query(f"""with {_NAMED} select doc_id, case when regexp_matches(lower(t), '\\brust\\b') then 'rust' when regexp_matches(lower(t), '\\btypescript\\b') then 'typescript' when regexp_matches(lower(t), '\\bjavascript\\b') then 'javascript' when regexp_matches(lower(t), '\\bpython\\b') then 'python' when regexp_matches(lower(t), '\\b(go|golang)\\b') then 'go' when regexp_matches(lower(t), '\\bjava\\b') then 'java' when regexp_matches(lower(t), '\\bc\\+\\+') then 'cpp' when regexp_matches(lower(t), '\\bc#') then 'csharp' else 'text' end as primary_language,
case when contains(lower(t), 'o1') or contains(lower(t), 'gpt-4o') then 'o200k' when contains(lower(t), 'claude') then 'anthropic' else 'cl100k' end as tokenizer from p""")
def primary_language(spark, sf):
    names = ("Python and Rust", " TypeScript", " C++ code", "gpt-4o", " claude python", " trusty", " golang", " a C# file", " JAVA", " javascript o1")
    t = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 10 + 1).cast("int")))
    return _table(spark, sf, "documents").select("doc_id", paths.primary_language(t).alias("primary_language"), paths.tokenizer_family(t).alias("tokenizer"))


@query("select doc_id, case when s >= 1048576 then printf('%.1f MB', s / 1048576.0) when s >= 1024 then printf('%.1f KB', s / 1024.0) else s || ' B' end as size, case when t >= 600 then t // 600 || 'm ' || (t % 600) // 10 || '.' || t % 10 || 's' else t // 10 || '.' || t % 10 || 's' end as duration from (select doc_id, (strlen(text) * 7)::bigint as s, (strlen(text) * 7 + 50)::bigint // 100 as t from documents)")
def size_texts(spark, sf):
    s = text.byte_size(F.col("text")) * 7
    return _table(spark, sf, "documents").select("doc_id", text.size_text(s).alias("size"), text.duration_text(s).alias("duration"))


_HIST = "h as (select source, lang as language, count(*) as files from documents where lang is not null group by all)"


@query(f"with {_HIST} select source, string_agg(language || ' (' || files || ')', ', ' order by encode(language || ' (' || files || ')')) as languages from h group by 1")
def language_list(spark, sf):
    histogram = _table(spark, sf, "documents").where("lang is not null").groupBy("source", F.col("lang").alias("language")).agg(F.count("*").alias("files"))
    return corpus.language_list(histogram, "source")


@query(f"with {_F} select ord, '--- ' || path || ' ---' || chr(10) || compressed_content || chr(10) || chr(10) as entry from f")
def corpus_entries(spark, sf):
    return _files(spark, sf).select("ord", text.corpus_entry(F.col("path"), F.col("compressed_content")).alias("entry"))


@query(f"with {_PATHS} select page_id, path as normalised from p")
def path_normalize(spark, sf):
    return _paths(spark, sf).select("page_id", paths.normalised_path(F.translate("path", "/", "\\")).alias("normalised"))


@query("""select doc_id, (['always','auto','files','manual','auto',null])[(n_chars % 6 + 1)::int] as rule_type, case when lang = 'en' then 'always' else 'auto' end as default_rule_type,
  case lang when 'en' then 'anthropic' when 'de' then 'openai' when 'fr' then 'ollama' else 'other' end as provider, case lang when 'en' then 200000 when 'de' then 128000 else 100000 end::bigint as context_limit from documents""")
def rule_types(spark, sf):
    n, lang = F.col("n_chars"), F.col("lang")
    names = F.element_at(F.array(*map(F.lit, ("ALWAYS", "Auto Attached", "specific-files", "manual", "intelligent", "none"))), (n % 6 + 1).cast("int"))
    provider = F.when(lang == "en", "anthropic").when(lang == "de", "openai").when(lang == "fr", "ollama").otherwise("other")
    default = paths.default_rule_type(F.when(lang == "en", "claude").otherwise("cursor"))
    return _table(spark, sf, "documents").select("doc_id", paths.rule_type(names).alias("rule_type"), default.alias("default_rule_type"), provider.alias("provider"), paths.context_limit(provider).alias("context_limit"))


@query("with t as (select conv_id, turn, len(text)::bigint as i, (strlen(text) // 4)::bigint as o from conversations) select conv_id, turn, i::double / 1000.0::double * 0.003::double as input_cost, o::double / 1000.0::double * 0.015::double as output_cost, i::double / 1000.0::double * 0.003::double + o::double / 1000.0::double * 0.015::double as total_cost from t")
def cost_split(spark, sf):
    e = cost.estimate(F.col("input_tokens"), F.col("output_tokens"), F.lit(PRICE_IN), F.lit(PRICE_OUT))
    return _ledger(spark, sf).select("conv_id", "turn", e.alias("e")).select("conv_id", "turn", "e.*")


@query("with t as (select doc_id, strlen(text) // 4 as n, (doc_id * 37 % 9001) // 4 as x from documents) select doc_id, (n + x)::double / 1000.0::double * 0.003::double + greatest(n, x)::double / 1000.0::double * 0.015::double as total_cost from t")
def merge_cost(spark, sf):
    e = cost.merge_estimate(F.col("doc_id") * 37 % 9001, text.byte_size(F.col("text")), F.lit(PRICE_IN), F.lit(PRICE_OUT))
    return _table(spark, sf, "documents").select("doc_id", e["total_cost"].alias("total_cost"))


@query("select event_id, value / 100.0::double between 0 and 1 and value - 50 >= 0 as valid from events where value is not null")
def state_checks(spark, sf):
    return _table(spark, sf, "events").where("value is not null").select("event_id", cost.state_valid(F.col("value") / 100.0, F.col("value") - 50).alias("valid"))


@query("select event_id, case when event_type = 'error' then 'skipped' when value > 30 then 'merged' when (props->>'$.k')::int > 60 then 'new' when user_id % 2 = 1 then 'backup' else 'overwritten' end as status from events")
def write_statuses(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return _table(spark, sf, "events").select("event_id", writing.write_status(F.col("event_type") == "error", F.col("value") > 30, k > 60, F.col("user_id") % 2 == 1).alias("status"))


@query("select doc_id, case lang when 'en' then 'claude' when 'de' then 'cursor' when 'fr' then 'aider' else 'generic' end as format from documents where lang is null or lang not in ('en', 'de')")
def existing_not_generated(spark, sf):
    """Outputs by language beside those that are being made: all formats with texts of over a thousand characters in English or German."""
    lang = F.col("lang")
    rows = _table(spark, sf, "documents").select("doc_id", "n_chars", F.when(lang == "en", "claude").when(lang == "de", "cursor").when(lang == "fr", "aider").otherwise("generic").alias("format"))
    return writing.not_generated(rows, rows.where("n_chars > 1000 and format in ('claude', 'cursor')")).select("doc_id", "format")


_FOUND = f"""{_RENDERED}, {_SYNTAX}, {_REFS}, {_CONV}, {_CONFLICTS}, {_MISSING}, {_UNREAL},
found as (select format, severity from syn union all select format, 'warning' from loose union all select format, 'error' from r where {_BOTH} union all select format, 'warning' from unreal
union all select 'cross-format:' || project, 'error' from conflicts union all select 'cross-format:' || project, 'error' from missing)"""


@query(f"""with {_FOUND}, n as (select format, count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings from found group by 1), f as (select format from r union all select distinct format from found where starts_with(format, 'cross-format'))
select f.format, coalesce(errors, 0) = 0 as passed, coalesce(errors, 0)::bigint as errors, coalesce(warnings, 0)::bigint as warnings from f left join n on f.format = n.format""")
def validation_results(spark, sf):
    rows = _rendered(spark, sf)
    return validate.results(rows, validate.findings(rows, _files(spark, sf)))


@query(f"with {_RENDERED}, {_REFS} select format, 'warning' as severity, 'path is not in the corpus' as message, ref as location from loose union all select format, 'warning', 'tabs and spaces are both prescribed', null from r where {_BOTH}")
def smoke_findings(spark, sf):
    return validate.smoke(_rendered(spark, sf), _files(spark, sf)).select("format", "severity", "message", "location")


@query(f"""with {_RENDERED}, t as (select format, regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g') as t from r), n as (select format, case when t = '' then t when t like '%' || chr(10) || chr(10) then left(t, len(t) - 1) when t like '%' || chr(10) then t else t || chr(10) end as t from t),
f as (select *, regexp_extract(t, '(?s)^(---\\n.*?\\n---\\n)', 1) as front from n) select format, front || '<!-- generated 2024-01-01 by p m; 7 + 5 tokens, $0.1235 -->' || chr(10) || substr(t, len(front) + 1) as content from f""")
def metadata_header(spark, sf):
    return finalise.finalised(_rendered(spark, sf), "p", "m", "2024-01-01", (7, 5, 0.12345))


_NEEDS = "case split_part(r.format, ':', 1) when 'cursor' then 'Begin with frontmatter that has a description.' when 'claude' then 'Use Markdown with headings.' when 'copilot' then 'Write plain Markdown instructions.' when 'windsurf' then 'Write short plain rules.' when 'aider' then 'Write conventions as plain text.' else 'Write Markdown for any tool.' end"


@query(f"""with {_FOUND}, e as (select format, string_agg(distinct message, chr(10) order by encode(message)) as errors from (select format, message from syn where severity = 'error' union all select format, 'tabs and spaces are both prescribed' from r where {_BOTH}) group by 1)
select r.format, sha256('The following ' || r.format || ' rules have these problems:' || chr(10) || errors || chr(10) || {_NEEDS} || chr(10) || 'Return the corrected rules in full.' || chr(10) || chr(10) || content) as prompt from r join e on r.format = e.format""")
def fix_requests(spark, sf):
    """Prompts of the formats that failed, with their errors; those that passed are asked nothing."""
    rows = _rendered(spark, sf)
    prompts = analysis.fix_requests(rows, validate.syntax(rows).unionByName(validate.contradictions(rows)))
    return prompts.select("format", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt"))


@query(f"""with {_F}, a as (select source as key, count(*) as n, string_agg(original_content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by ord) as analyses from f group by source, ord // 20) select key, n, sha256(analyses) as analyses from a""")
def merge_inputs(spark, sf):
    """Analyses of twenty chunks at most, in the order of the chunks, as they are put to the model."""
    parts = _files(spark, sf).select(F.concat("source", F.lit("/"), F.expr("ord div 20").cast("string")).alias("key"), F.col("ord").alias("chunk_id"), F.col("original_content").alias("text"))
    return analysis.merge_inputs(parts, "key").select(F.regexp_extract("key", r"(?s)^(.*)/", 1).alias("key"), "n", F.sha2(F.col("analyses").cast("binary"), 256).alias("analyses"))


@query(f"""with {_F} select ord, sha256('You describe the conventions of a code base for an assistant.' || chr(10) || 'Files: 3. Languages: ' || coalesce(language, '{{{{chunk}}}}') || '. Size after compression: 50.0 % of the original.' || chr(10) || 'Focus: x' || chr(10) || 'State naming, layout, error handling, testing and style rules that the following part shows.' || chr(10) || chr(10) || compressed_content) as prompt from f""")
def analysis_prompts(spark, sf):
    """One pass over the template: a variable's name in a value stays text."""
    rows = _files(spark, sf).select("ord", F.lit(3).alias("file_count"), F.coalesce("language", F.lit("{{chunk}}")).alias("languages"), F.lit(0.5).alias("compression_ratio"), F.col("compressed_content").alias("content"))
    return rows.select("ord", F.sha2(analysis.analysis_prompt("x").cast("binary"), 256).alias("prompt"))


#: Parts as models: what they cost for a token is listed as text, for some of them badly or not at all.
_LISTED = "select p_name || ' ' || p_partkey as model, case when p_size % 5 = 0 then 'free' when p_size % 5 < 4 then '0.' || lpad((round(p_retailprice * 100))::bigint::varchar, 9, '0') end as i, case when p_size % 3 = 0 then '0.25' when p_size % 3 = 1 then '' end as o from part"


@query(f"select model, coalesce(try_cast(i as double) * 1000, 0.0::double) as price_in, coalesce(try_cast(o as double) * 1000, 0.0::double) as price_out from ({_LISTED}) union all select 'unlisted', 0.0::double, 0.0::double")
def model_prices(spark, sf):
    n = F.col("p_size")
    i = F.when(n % 5 == 0, "free").when(n % 5 < 4, F.concat(F.lit("0."), F.lpad(F.round(F.col("p_retailprice") * 100).cast("long").cast("string"), 9, "0")))
    o = F.when(n % 3 == 0, "0.25").when(n % 3 == 1, "")
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    parts = _table(spark, sf, "part")
    entry = F.struct(name.alias("id"), F.struct(i.alias("prompt"), o.alias("completion")).alias("pricing"))
    listing = parts.select(F.to_json(F.struct(F.array(entry).alias("data"))).alias("body"))
    wanted = parts.select(name.alias("model")).union(spark.createDataFrame([("unlisted",)], "model string"))
    return models.priced(wanted, listing)


@query("select p_name || ' ' || p_partkey as model, p_size <= 35 as found from part")
def models_installed(spark, sf):
    """Small parts are installed, plainly or as the latest; large ones under another tag."""
    n = F.col("p_size")
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    tag = F.when(n <= 15, "").when(n <= 35, ":latest").otherwise(":7b")
    parts = _table(spark, sf, "part")
    listing = parts.select(F.to_json(F.struct(F.array(F.struct(F.concat(name, tag).alias("name"))).alias("models"))).alias("body"))
    return models.installed(parts.select(name.alias("model")), listing)


_LEVELS = """with l as (select (conv_id // 20)::varchar as project, coalesce(role, 'none') as operation, (turn % 3 + 1)::varchar as attempt, len(text)::bigint as i, (strlen(text) // 4)::bigint as o from conversations),
g as (select project, operation, attempt, (grouping(project) + grouping(operation) + grouping(attempt))::int as level, count(*) as operations, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens from l group by rollup (project, operation, attempt))
select *, input_tokens::double / 1000.0::double * 0.003::double + output_tokens::double / 1000.0::double * 0.015::double as total_cost from g"""


@query(_LEVELS)
def ledger_rollup(spark, sf):
    """Calls by project, operation and attempt, and all sums of these."""
    calls = _table(spark, sf, "conversations").select(F.expr("conv_id div 20").alias("project"), F.col("role").alias("operation"), (F.col("turn") % 3 + 1).alias("attempt"), F.char_length("text").cast("long").alias("input_tokens"), text.tokens_down(text.byte_size(F.col("text"))).alias("output_tokens"))
    return ledger.rollup(calls, PRICE_IN, PRICE_OUT, "project", "operation", "attempt")


_SWITCHED = ", ".join(f"case when o.project is not null then coalesce(o.{c}, true) else coalesce(p.{c}, u.{c}, true) end as {c}" for c in validate.CHECKS)


@query(f"""with d as (select doc_id, coalesce(source, 'nobody') as user, doc_id // 6 as project, (['cursor','claude','copilot','windsurf','aider','generic'])[(doc_id % 6 + 1)::int] as format, lang, n_chars from documents),
u as (select user, bool_and(n_chars < 20000) as paths, null::boolean as contradictions, bool_and(lang <> 'es') as reality, null::boolean as consistency from d group by 1),
p as (select project, bool_and(case when lang = 'de' then false end) as paths, bool_and(case when n_chars > 500 then n_chars < 3000 end) as contradictions, null::boolean as reality, bool_and(lang = 'en') as consistency from d group by 1),
o as (select project, format, null::boolean as paths, bool_and(lang <> 'fr') as contradictions, bool_and(case when n_chars > 2000 then false end) as reality, null::boolean as consistency from d where n_chars % 5 = 0 group by 1, 2)
select d.user, d.project, d.format, {_SWITCHED} from (select distinct user, project, format from d) d left join u on d.user = u.user left join p on d.project = p.project left join o on d.project = o.project and d.format = o.format""")
def format_switches(spark, sf):
    """Checks of the formats of many projects, from settings of users and projects and overrides of single formats."""
    d = F.col("doc_id")
    kinds = F.element_at(F.array(*map(F.lit, ("cursor", "claude", "copilot", "windsurf", "aider", "generic"))), (d % 6 + 1).cast("int"))
    docs = _table(spark, sf, "documents").select(F.coalesce("source", F.lit("nobody")).alias("user"), F.expr("doc_id div 6").alias("project"), kinds.alias("format"), "lang", "n_chars")
    none = F.lit(None).cast("boolean")
    n, lang = F.col("n_chars"), F.col("lang")
    users = docs.select("user", (n < 20000).alias("paths"), none.alias("contradictions"), (lang != "es").alias("reality"), none.alias("consistency"))
    projects = docs.select("project", F.when(lang == "de", False).alias("paths"), F.when(n > 500, n < 3000).alias("contradictions"), none.alias("reality"), (lang == "en").alias("consistency"))
    overrides = docs.where(n % 5 == 0).select("project", "format", none.alias("paths"), (lang != "fr").alias("contradictions"), F.when(n > 2000, False).alias("reality"), none.alias("consistency"))
    return switches.resolved(docs.select("user", "project", "format").distinct(), users, projects, overrides)


def _failing(c: str) -> str:
    """SQL for whether the text in column ``c`` has an error."""
    fence = f"((len({c}) - len(replace({c}, '```', ''))) // 3) % 2 = 1"
    both = _BOTH.replace("content", c)
    front = f"kind = 'cursor' and starts_with({c}, '---') and instr(substr({c}, 4), '---') = 0"
    return f"({fence} or kind = 'claude' and not contains({c}, '# ') or {both} or {front} or trim(regexp_replace({c}, '\\s+', ' ', 'g')) = '')"


@query(f"""with recursive {_RENDERED}, s as (select *, split_part(format, ':', 1) as kind from r), it(format, kind, content, k, bad) as (
select format, kind, content, 0, {_failing('content')} from s union all select format, kind, c, k + 1, {_failing('c')} from (select format, kind, k, case when ((len(content) - len(replace(content, '```', ''))) // 3) % 2 = 1 then content || chr(10) || '```'
  when kind = 'claude' and not contains(content, '# ') then '# Rules' || chr(10) || content when {_BOTH} then regexp_replace(content, '(?i)\\buse\\s+tabs\\b', 'no tabs', 'g')
  else coalesce(nullif(case when starts_with(content, '---') then substr(content, 4) else content end, ''), 'Rules') end as c from it where bad and k < 3))
select format, max(k)::int as attempts, sha256(arg_max(content, k)) as content from it group by format""")
def fix_rounds(spark, sf):
    """Rules of many projects, sent back until they pass or three attempts are over; each attempt takes out one flaw."""
    desk = analysis.Desk(analysis.RepairProvider, f"{shared_folder(spark)}/desk-{uuid.uuid4().hex}", 8)
    find = lambda rows: validate.syntax(rows).unionByName(validate.contradictions(rows))
    rules, _, _ = analysis.fixed(_rendered(spark, sf), find, desk)
    return rules.select("format", "attempts", F.sha2(F.col("content").cast("binary"), 256).alias("content"))
