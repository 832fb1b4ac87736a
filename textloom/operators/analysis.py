"""Model calls over chunk tables: map, merge, format refinement, fix loop. The provider is pluggable; answers are stored once.

All calls go over a ``Desk``. Requests carry the digest of their prompt; answered digests are read from the store and skipped, answers
are written before anything reads them, and every call is a row of the desk's ledger. A call that fails is a row too, so it doesn't
take its neighbours' answers with it: the wave's answers are stored, and then the failure is raised.
"""

from __future__ import annotations

import random
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cost import FIRST_DELAY_MS, MAX_RETRIES, MOST_DELAY_MS, cost
from ..functions.text import byte_size, tokens_down
from ..workspace import staged

ANALYSIS_MAX_TOKENS, ANALYSIS_TEMPERATURE = 4096, 0.3
MOST_TOKENS = 2**31 - 1

ANALYSIS_TEMPLATE = """You describe the conventions of a code base for an assistant.
Files: {{file_count}}. Languages: {{languages}}. Size after compression: {{compression_ratio}} % of the original.
{{focus_section}}State naming, layout, error handling, testing and style rules that the following part shows.

{{chunk}}"""
MERGE_TEMPLATE = """Below are {{count}} analyses of one code base. Write one analysis: bring them together, say nothing twice, combine related
points, settle contradictions, and keep what only one of them says. Don't mention that there were parts.

{{analyses}}"""
FORMAT_TEMPLATE = """Rewrite the analysis as rules for {{format}} (rule type {{rule_type}}, primary language {{primary_language}}).
{{requirements}}

{{analysis}}"""
FIX_TEMPLATE = """The following {{format}} rules have these problems:
{{errors}}
{{requirements}}
Return the corrected rules in full.

{{content}}"""
SMART_MERGE_TEMPLATE = """Below are the rules that a file holds and new rules for it. Write the file anew: keep what was added by hand, take over what
is new, replace what the new rules contradict, and say nothing twice.

Existing:
{{existing_rules}}

New:
{{new_rules}}"""
CONFLICT_TEMPLATE = """Rules of other tools already exist. Write the {{format}} rules so that they neither repeat nor contradict them.

Existing:
{{existing_rules}}

New:
{{new_analysis}}"""
REQUIREMENTS = {
    "cursor": "Begin with frontmatter that has a description.",
    "claude": "Use Markdown with headings.",
    "copilot": "Write plain Markdown instructions.",
    "windsurf": "Write short plain rules.",
    "aider": "Write conventions as plain text.",
    "generic": "Write Markdown for any tool.",
    "json": "Return one JSON object with at least one member.",
}


def rendered(template: str, **values: Column) -> Column:
    """A template with its variables filled in one pass: text that comes in by one variable is never read as another."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    unknown = set(parts[1::2]) - set(values)
    if unknown:
        raise ValueError(f"no value for {sorted(unknown)}")
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


@dataclass(frozen=True)
class Options:
    max_tokens: int = ANALYSIS_MAX_TOKENS
    temperature: float | None = ANALYSIS_TEMPERATURE

    def for_merge(self) -> Options:
        return Options(min(2 * self.max_tokens, MOST_TOKENS), self.temperature)


@dataclass(frozen=True)
class Answer:
    text: str
    input_tokens: int
    output_tokens: int


class ProviderError(Exception):
    def __init__(self, message: str, retry: bool = False, after_ms: int | None = None) -> None:
        super().__init__(message)
        self.retry, self.after_ms = retry, after_ms


class Provider(Protocol):
    def complete(self, prompt: str, options: Options) -> Answer: ...


class EchoProvider:
    """Answers with the first words of the prompt: deterministic, for tests and dry runs."""

    def complete(self, prompt: str, options: Options) -> Answer:
        text = " ".join(prompt.split()[-12:])
        return Answer(text, (len(prompt.encode()) + 3) // 4, (len(text.encode()) + 3) // 4)


def with_retries(call: Callable[[], Answer], retries: int = MAX_RETRIES, first_ms: int = FIRST_DELAY_MS, most_ms: int = MOST_DELAY_MS, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: random.uniform(0.75, 1.25)) -> Answer:
    """Up to ``retries`` more tries of a call that fails in a way that may pass; a delay that the server asks for replaces ours."""
    for attempt in range(retries + 1):
        try:
            return call()
        except ProviderError as e:
            if not e.retry or attempt == retries:
                raise
            delay = min(first_ms * 2 ** min(attempt, 10), most_ms) if e.after_ms is None else e.after_ms
            sleep(delay * jitter() / 1000)
    raise AssertionError


#: Prompts that a task of a wave asks one after another; what a lost task asks again at most, unless answers come fast.
PER_TASK = 8
#: A wave may hold half as many prompts as all before it, if that is more, as long as its tasks ask for about so many seconds and bytes at most.
TASK_SECONDS, TASK_BYTES = 60, 64 << 20
#: Prompts lie at places drawn by their digests, so that a range of places is a wave.
PLACES = 2**31
STORED = "digest string, text string, input_tokens long, output_tokens long, error string"
CALL = "operation string, item string, attempt int, digest string, input_tokens long, output_tokens long"


class Desk:
    """Where a run's calls go. ``provider`` makes a client on the worker, one for each task; ``store`` is a folder that all executors
    share. At most ``concurrency`` prompts are asked at a time, in waves of ``concurrency`` tasks. Waves grow while answers come fast,
    so their number grows as the logarithm of the prompts', and each reads its own prompts only."""

    def __init__(self, provider: Callable[[], Provider], store: str, concurrency: int = 4) -> None:
        self.provider, self.store, self.concurrency = provider, store, concurrency
        self._calls: list[DataFrame] = []

    def _stored(self, spark: SparkSession) -> DataFrame:
        # Each call of ``completed`` adds folders, since Spark takes two reads of one folder for the same table even if files came between.
        spark.createDataFrame([], STORED).write.mode("ignore").parquet(f"{self.store}/answers/none")
        return spark.read.schema(STORED).parquet(f"{self.store}/answers/*").where("error is null")

    def ledger(self, spark: SparkSession) -> DataFrame:
        """A row for each call that the results rest on (operation, item, attempt, digest, input_tokens, output_tokens)."""
        return reduce(DataFrame.unionByName, self._calls, spark.createDataFrame([], CALL))

    def completed(self, requests: DataFrame, operation: str, item: Column, options: Options = Options(), attempt: int = 1) -> DataFrame:
        """Requests (key columns, prompt) with text, input_tokens, output_tokens. Only prompts that the store lacks are sent, each once."""
        spark, provider = requests.sparkSession, self.provider
        mark = uuid.uuid4().hex
        digest = F.sha2(F.concat(F.col("prompt"), F.lit(f"\n{options}")).cast("binary"), 256)
        requests = requests.withColumn("item", item.cast("string")).withColumn("digest", digest)
        requests.write.parquet(f"{self.store}/requests/{mark}")
        requests = spark.read.schema(requests.schema).parquet(f"{self.store}/requests/{mark}")

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = provider()
            for b in batches:
                rows = []
                for d, p in zip(b["digest"], b["prompt"], strict=True):
                    try:
                        a = with_retries(lambda p=p: client.complete(p, options))
                        rows.append((d, a.text, a.input_tokens, a.output_tokens, None))
                    except Exception as e:  # stored as a row, and raised by the driver
                        rows.append((d, None, 0, 0, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["digest", "text", "input_tokens", "output_tokens", "error"])

        fresh = requests.select("digest", "prompt").dropDuplicates(["digest"]).join(self._stored(spark).select("digest"), "digest", "left_anti")
        fresh = fresh.withColumn("place", F.pmod(F.xxhash64("digest"), F.lit(PLACES))).sortWithinPartitions("place")
        fresh.write.parquet(f"{self.store}/requests/{mark}-new")
        fresh = spark.read.schema(fresh.schema).parquet(f"{self.store}/requests/{mark}-new")
        n, held = fresh.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("prompt")), F.lit(0))).first()
        least = self.concurrency * PER_TASK
        size, done, wave = least, 0, 0
        while done < n:
            path, started = f"{self.store}/answers/{mark}-{wave}", time.monotonic()
            here = (F.col("place") >= PLACES * done // n) & (F.col("place") < PLACES * min(n, done + size) // n)
            fresh.where(here).select("digest", "prompt").repartition(self.concurrency, F.xxhash64("digest", F.lit(1))).mapInPandas(ask, STORED).write.parquet(path)
            if failed := spark.read.schema(STORED).parquet(path).where("error is not null").orderBy("digest").limit(1).collect():
                raise ProviderError(failed[0]["error"].removeprefix("ProviderError: "))
            done, wave = done + size, wave + 1
            fast = int(size * TASK_SECONDS / (time.monotonic() - started))
            size = max(least, min(done // 2, fast, TASK_BYTES * self.concurrency * n // max(1, held)))
        answers = self._stored(spark).drop("error").dropDuplicates(["digest"])
        out = requests.join(answers, "digest")
        out.write.parquet(f"{self.store}/calls/{mark}")
        out = spark.read.schema(out.schema).parquet(f"{self.store}/calls/{mark}")
        self._calls.append(out.groupBy("digest").agg(F.min("item").alias("item"), F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens")).select(F.lit(operation).alias("operation"), "item", F.lit(attempt).alias("attempt"), "digest", "input_tokens", "output_tokens"))
        return out.drop("digest", "prompt", "item")


def analysis_prompt(focus: str = "") -> Column:
    """The prompt for a chunk (content) of a corpus (file_count, languages, compression_ratio)."""
    return rendered(ANALYSIS_TEMPLATE, file_count=F.col("file_count").cast("string"), languages=F.col("languages"), compression_ratio=F.format_string("%.1f", F.col("compression_ratio") * 100), focus_section=F.lit(f"Focus: {focus}\n" if focus else ""), chunk=F.col("content"))


def analysed(chunks: DataFrame, key: str, facts: DataFrame, desk: Desk, focus: str = "") -> DataFrame:
    """(key, chunk_id, text, tokens) of each chunk (key, chunk_id, content). ``facts`` (key, file_count, languages, compression_ratio)
    describe each corpus; a prompt holds its chunk only, never the whole corpus."""
    rows = chunks.join(facts, key)
    return desk.completed(rows.select(key, "chunk_id", analysis_prompt(focus).alias("prompt")), "analysis", F.concat(key, F.lit(" "), F.col("chunk_id") + 1))


def parsed(answers: DataFrame, provider: str, model: str, made: Column | None = None) -> DataFrame:
    """Answers (text and others) as rules without any format yet: their columns, analysis, provider, model, made (now, if it isn't given) and formats, an
    empty map from formats to contents. An answer is taken as it is; nothing in it can fail."""
    empty = F.create_map().cast("map<string,string>")
    return answers.withColumnRenamed("text", "analysis").select("*", F.lit(provider).alias("provider"), F.lit(model).alias("model"), (F.current_timestamp() if made is None else made).alias("made"), empty.alias("formats"))


def merge_inputs(parts: DataFrame, key: str) -> DataFrame:
    """key, n, analyses: the texts of a corpus's chunks (key, chunk_id, text) in their order. An analysis is short, and one prompt has to hold them all."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda r: r["text"]), "\n\n---\n\n")
    return parts.groupBy(key).agg(F.count("*").alias("n"), joined.alias("analyses"))


def merged(parts: DataFrame, key: str, desk: Desk) -> DataFrame:
    """(key, analysis): one chunk's analysis as it is, several merged by one more call."""
    groups = merge_inputs(parts, key)
    single = groups.where("n = 1").select(key, F.col("analyses").alias("analysis"))
    several = groups.where("n > 1")
    if several.isEmpty():
        return single
    prompt = rendered(MERGE_TEMPLATE, count=F.col("n").cast("string"), analyses=F.col("analyses"))
    called = desk.completed(several.select(key, prompt.alias("prompt")), "merge", F.col(key), Options().for_merge())
    return single.unionByName(called.select(key, F.col("text").alias("analysis")))


def _requirements(format_: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in REQUIREMENTS.items() for x in kv])
    return F.coalesce(F.element_at(kinds, F.split_part(format_, F.lit(":"), F.lit(1))), F.lit(REQUIREMENTS["generic"]))


def formatted(analyses: DataFrame, formats: DataFrame, desk: Desk) -> DataFrame:
    """(format, content) for one analysis and the formats (format, rule_type, primary_language): one call each."""
    rows = formats.crossJoin(F.broadcast(analyses.select("analysis").limit(1)))  # one row
    prompt = rendered(FORMAT_TEMPLATE, format=F.col("format"), rule_type=F.col("rule_type"), primary_language=F.col("primary_language"), requirements=_requirements(F.col("format")), analysis=F.col("analysis"))
    return desk.completed(rows.select("format", prompt.alias("prompt")), "format", F.col("format"), Options(temperature=None)).select("format", F.col("text").alias("content"))


def summed_up(existing: DataFrame) -> DataFrame:
    """One row (existing): the rules (ord, content) of other tools as a prompt holds them; none if there are no such rules."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda r: r["content"]), "\n\n")
    return existing.agg(text.alias("existing")).where("existing <> ''")


def deconfliction_cost(rules: DataFrame, others: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """One row (input_tokens, output_tokens, total_cost): each format's rules are read with all others', and about as much as they hold is written."""
    sizes = rules.crossJoin(F.broadcast(others)).select(tokens_down(byte_size(F.col("existing"))).alias("held"), tokens_down(byte_size(F.coalesce("content", F.lit("")))).alias("own"))  # one row of others
    sums = sizes.agg(F.coalesce(F.sum(F.col("held") + F.col("own")), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("own"), F.lit(0)).alias("output_tokens"))
    return sums.withColumn("total_cost", cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(price_in), F.lit(price_out)))


def deconflicted(rules: DataFrame, existing: DataFrame, desk: Desk) -> DataFrame:
    """Rules (format, content) rewritten against the existing rules (ord, content) of other tools; as they are where there are none."""
    others = summed_up(existing)
    if others.isEmpty():
        return rules.select("format", "content")
    rows = rules.crossJoin(F.broadcast(others))  # one row
    prompt = rendered(CONFLICT_TEMPLATE, format=F.col("format"), existing_rules=F.col("existing"), new_analysis=F.col("content"))
    return desk.completed(rows.select("format", prompt.alias("prompt")), "deconflict", F.col("format"), Options(temperature=None)).select("format", F.col("text").alias("content"))


def smart_merged(pairs: DataFrame, desk: Desk) -> DataFrame:
    """(format, content): new rules merged by the model with what their file holds, for (format, existing, content)."""
    prompt = rendered(SMART_MERGE_TEMPLATE, existing_rules=F.col("existing"), new_rules=F.col("content"))
    return desk.completed(pairs.select("format", prompt.alias("prompt")), "smart merge", F.col("format")).select("format", F.col("text").alias("content"))


def fix_requests(rules: DataFrame, found: DataFrame) -> DataFrame:
    """format, prompt of the rules (format, content) that have errors among the findings (format, severity, message)."""
    errors = found.where("severity = 'error'").groupBy("format").agg(F.array_join(F.array_sort(F.collect_set("message")), "\n").alias("errors"))
    prompt = rendered(FIX_TEMPLATE, format=F.col("format"), errors=F.col("errors"), requirements=_requirements(F.col("format")), content=F.coalesce("content", F.lit("")))
    return rules.join(errors, "format").select("format", prompt.alias("prompt"))


class RepairProvider:
    """Takes one flaw at a time out of the rules that a fix prompt holds: deterministic, for tests and queries without a model."""

    def complete(self, prompt: str, options: Options) -> Answer:
        head, _, content = prompt.partition("Return the corrected rules in full.\n\n")
        if content.count("```") % 2:
            text = content + "\n```"
        elif head.startswith("The following claude") and "# " not in content:
            text = "# Rules\n" + content
        elif re.search(r"(?i)\buse\s+tabs\b", content) and re.search(r"(?i)\buse\s+spaces\b", content):
            text = re.sub(r"(?i)\buse\s+tabs\b", "no tabs", content)
        else:
            text = content.removeprefix("---") or "Rules"
        return Answer(text, len(prompt) // 4, len(text) // 4)


def fixed(rules: DataFrame, find: Callable[[DataFrame], DataFrame], desk: Desk, retries: int = MAX_RETRIES, stage: Callable[[DataFrame, str], DataFrame] = staged) -> tuple[DataFrame, int, bool]:
    """Rules (format, content, attempts) whose failed formats were sent back with their errors up to ``retries`` times, then the attempts made and whether all
    are clean.

    ``find`` gives findings (format, severity, message) of rules; those over all formats together belong to no format and aren't sent. The rules
    that fail are the work set, staged each round; a round reads them alone. Rules that pass retire to tables of their own, and the
    loop ends when the set is empty.
    """
    attempts, done = 0, []
    work = rules.select("format", "content", F.lit(0).alias("attempts"))
    while True:
        work = stage(work, f"work-{attempts}")
        errors = stage(find(work.select("format", "content")).where("severity = 'error'").select("format", "severity", "message"), f"errors-{attempts}")
        failing = errors.select("format").distinct()
        done.append(work.join(failing, "format", "left_anti"))
        work = work.join(failing, "format")
        clean = work.isEmpty()
        if clean or attempts == retries:
            return reduce(DataFrame.unionByName, [*done, work]), attempts, clean
        attempts += 1
        options = Options(temperature=min(0.7 + 0.1 * (attempts - 1), 0.9))
        new = desk.completed(fix_requests(work, errors), "fix", F.col("format"), options, attempts)
        work = new.select("format", F.col("text").alias("content"), F.lit(attempts).alias("attempts"))
