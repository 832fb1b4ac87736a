"""The whole run: corpus in, analysis, formats, validation, finalised and written out."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import cost, paths, text, tokens
from ..functions.cost import pricing
from ..operators import analysis, chunks, corpus, finalise, ledger, reports, structure, validate, writer, writing
from ..operators.providers import SERVICES
from ..progress import Progress
from ..sources import outputs, splits, tree
from ..state import State
from ..workspace import DAY, Workspace, ensure_ignored, sweep


@dataclass
class Result:
    report: DataFrame
    written: list[writer.Written]
    results: DataFrame | None = None
    #: Findings of the validation, as a report.
    findings: DataFrame | None = None
    #: Warnings of the check after finalising; they never stop a run.
    smoke: DataFrame | None = None
    cost: float = 0.0
    #: The ledger of all model calls.
    calls: DataFrame | None = None
    summary: list[str] = field(default_factory=list)
    #: What the run before saved.
    previous: State | None = None


#: Answers to whether rules are fitted to those of other tools.
DECISIONS = ("go", "skip", "cancel")


class Declined(Exception):
    """The run was called off, by its cost or by formats that failed validation."""


def files_of(spark: SparkSession, root: str, config: Config, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(ord, path, language, original_content) of a tree or a packed file; the content of files that aren't UTF-8 is null."""
    if config.packed_file:
        rows = splits.read(spark, config.packed_file, stage=stage)
        return rows.select(F.col("ord").cast("long"), "path", paths.language(F.col("path")).alias("language"), F.col("content").alias("original_content"))
    tree.register(spark)
    reader = spark.read.format("tree").option("include", ",".join(config.include)).option("exclude", ",".join(config.exclude)).option("on_unreadable", config.on_unreadable)
    return reader.load(root).select("ord", "path", "language", F.col("content").alias("original_content"))


def compressed(spark: SparkSession, root: str, config: Config, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Files with their compressed texts. Those of a pack, and all without ``compress``, stay byte for byte what they are."""
    files = files_of(spark, root, config, stage)
    if config.packed_file or not config.compress:
        return corpus.compressed(files, compress=False)
    return corpus.compressed(files, structure.structural(F.col("original_content"), F.col("language")))


def planned(spark: SparkSession, root: str, config: Config, interactive: bool) -> DataFrame:
    """format, path, action of each output, from the driver's look at what exists: a handful of rows."""
    overrides = dict(config.output_paths) | ({config.formats[0]: config.output} if config.output else {})
    known = [p for p in {*paths.FORMATS.values(), *overrides.values()} if os.path.exists(os.path.join(root, p))]
    requests = spark.createDataFrame([(f, config.on_conflict, interactive) for f in config.formats], "format string, strategy string, interactive boolean")
    return writing.planned_writes(requests, spark.createDataFrame(list(overrides.items()), "format string, override string"), spark.createDataFrame([(p,) for p in known], "path string"))


def run(spark: SparkSession, root: str, config: Config, provider: Callable[[], analysis.Provider] = analysis.EchoProvider, work: str | None = None, timestamp: str = "", confirm: Callable[[float, list[str]], bool] | None = None, on_failure: Callable[[list[str]], bool] | None = None, ask: Callable[[str, str], str] | None = None, home: str | None = None, progress: Callable[[str], None] = lambda step: None, choose: Callable[[float, list[str]], str] | None = None) -> Result:
    """``work`` is a folder that all executors share; stage tables and model answers are kept there, and answers aren't paid for twice.
    ``home`` (``work`` by default) is the driver's folder for the state.

    ``confirm`` is asked with the expected cost and what it is made of, unless the configuration says not to; ``on_failure`` with the
    formats that still fail validation, whether to write them; ``ask`` what to do about a file that exists (see ``writer.CHOICES``); ``choose`` whether rules are
    fitted to those of other tools, at that cost (see ``DECISIONS``).
    Without them a run goes on, writes, and ends at a conflict. Conflicts are settled before anything is paid for.
    """
    with Progress(spark, progress) as steps:
        return _run(spark, root, config, provider, work, timestamp, confirm, on_failure, ask, home, steps, choose)


def _run(spark: SparkSession, root: str, config: Config, provider, work: str | None, timestamp: str, confirm, on_failure, ask, home: str | None, progress: Progress, choose) -> Result:
    began = time.monotonic()
    if work is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a work folder that the driver and all executors share")
        work = os.path.join(root, ".textloom")
        if os.path.isdir(root) and not config.dry_run:
            ensure_ignored(root, ".textloom/")
    price = {r["provider"]: r for r in pricing(spark).collect()}[config.provider]
    price_in, price_out = price["price_in"], price["price_out"]
    if config.dry_run:
        return Result(corpus.dry_run(compressed(spark, root, config).where("original_content is not null"), len(config.formats), price_in, price_out), [])
    space, desk = Workspace(home or work, f"{work}/stages"), analysis.Desk(provider, work, config.concurrency)
    space.clean(DAY)
    sweep(spark, work, DAY)
    previous = space.load_state()
    if previous:
        progress.say(f"last run {previous.last_run}, ${previous.cost_spent:.4f}")
    settled = writer.settled(planned(spark, root, config, ask is not None).collect(), ask)

    progress("files")
    read = F.col("original_content").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(read, c)), F.lit(0))
    scanned = space.stage(
        compressed(spark, root, config, lambda df: space.stage(df, "pack")), "files", total_files=F.count_if(read), left_out=F.count_if(~read), total_original_size=total(F.col("original_size")),
        total_compressed_size=total(F.col("compressed_size")), original_tokens=total(text.tokens_up(F.col("original_content"))),
    )
    files, sizes = scanned.where(read), space.metrics["files"]
    sizes["compression_ratio"] = sizes["total_compressed_size"] / sizes["total_original_size"] if sizes["total_original_size"] else 0.0
    report = corpus.dry_run(files, len(config.formats), price_in, price_out)
    if not sizes["total_files"]:
        raise ValueError(f"no file to read in {config.packed_file or root}")
    languages = (corpus.language_list(corpus.language_histogram(files)).first() or {"languages": ""})["languages"]
    facts = spark.createDataFrame([("corpus", sizes["total_files"], languages, sizes["compression_ratio"])], "key string, file_count long, languages string, compression_ratio double")

    progress("chunks")
    entries = files.select(F.lit("corpus").alias("key"), "ord", text.corpus_entry(F.col("path"), F.col("compressed_content")).alias("entry"))
    parts = space.stage(chunks.token_chunks(entries, "key", "ord", "entry", config.chunks, config.tokenizer, lambda df: space.stage(df, "index")), "chunks", chunks=F.count("*"), chunk_tokens=F.coalesce(F.sum("token_count"), F.lit(0)))
    made = space.metrics["chunks"]
    if confirm and not config.no_confirm:
        known = spark.range(1).select(*[F.lit(made[c]).cast("long").alias(c) for c in ("chunks", "chunk_tokens")])
        expected = ledger.expected(known, len(config.formats), price_in, price_out).first()
        before = sizes["original_tokens"]
        if config.tokenizer:
            before = files.agg(F.sum(tokens.exact_tokens(F.col("original_content"), config.tokenizer, False))).first()[0]
        if not confirm(expected["estimated_cost"], reports.cost_lines(expected, sizes["total_files"], languages, before, paths.PROVIDERS[config.provider][4])):
            raise Declined("the run was not confirmed")

    progress("analysis")
    whole = analysis.merged(analysis.analysed(parts.select("key", "chunk_id", "content"), "key", facts, desk, config.description or ""), "key", desk)
    formats = spark.createDataFrame([(f, "always" if f == "claude" else config.rule_type) for f in config.formats], "format string, rule_type string")
    primary = whole.select(paths.primary_language(F.col("analysis")).alias("primary_language"))

    progress("formats")
    rules = formats.select("format").join(analysis.formatted(whole, formats.crossJoin(F.broadcast(primary)), desk), "format", "left")

    def find(rows: DataFrame) -> DataFrame:
        if not config.validate:
            return spark.createDataFrame([], validate.FINDING)
        return validate.findings(rows, files, config.format_checks, config.checks, config.formats, space.stage) if config.semantic_validation else validate.syntax(rows)

    progress("validation")
    if config.retry_on_validation_failure:
        rules = analysis.fixed(rules, find, desk, config.max_retries, space.stage)[0].drop("attempts")
    rules, found = space.stage(rules, "rules"), space.stage(find(rules), "findings")
    results = space.stage(validate.results(rules, found), "results")
    failed = sorted(r["format"] for r in results.where("not passed").collect())
    if failed and (config.on_failure == "cancel" or config.on_failure == "ask" and on_failure and not on_failure(failed)):
        raise Declined("formats failed validation: " + ", ".join(failed))
    if absent := sorted(r["format"] for r in rules.where("content is null").collect()):
        raise ValueError("formats were not rendered: " + ", ".join(absent))

    progress("finalisation")
    if config.finalise and config.deconflict:
        rules = _deconflicted(rules, outputs.of_other_tools(spark, root, formats), config, desk, price_in, price_out, choose)
    rules = _merged_with_files(spark, root, config, rules, settled, desk, price_in, price_out, confirm)
    spent = ledger.summary(desk.ledger(spark), price_in, price_out).first()
    author = ("echo", "without a model") if provider is analysis.EchoProvider else (config.provider, config.model or SERVICES[config.provider].model)
    if config.finalise:
        rules = finalise.finalised(rules, *author, timestamp, (spent["input_tokens"], spent["output_tokens"], spent["total_cost"]), config.normalise, config.header)
    smoke = validate.smoke(rules, files)

    progress("writing")
    written = writer.write(spark.createDataFrame(settled, "format string, path string, action string").join(rules, "format"), root)
    space.save_state(State(last_run=timestamp, file_conflict_action=config.on_conflict, output_files=tuple(w.path for w in written), cost_spent=spent["total_cost"], original_bytes=sizes["total_original_size"], compression_ratio=min(1.0, sizes["compression_ratio"])))
    done = [(w.format, w.path, w.status, os.path.getsize(os.path.join(root, w.path))) for w in written]
    summary = reports.success_lines(done, sizes["total_files"], made["chunk_tokens"], sizes["compression_ratio"], spent["total_cost"], time.monotonic() - began, sizes["left_out"]) + ([f"Last run: {previous.last_run}, ${previous.cost_spent:.4f}"] if previous else [])
    return Result(report, written, results, reports.validation(results, found), smoke, spent["total_cost"], desk.ledger(spark), summary, previous)


def _deconflicted(rules: DataFrame, existing: DataFrame, config: Config, desk: analysis.Desk, price_in: float, price_out: float, choose: Callable[[float, list[str]], str] | None) -> DataFrame:
    """Rules beside those of other tools, once that is paid for knowingly: it may be skipped, or called off with the run."""
    names = [r["path"] for r in existing.select("path").orderBy("path").collect()]
    if names and choose and not config.no_confirm:
        expected = analysis.deconfliction_cost(rules, analysis.summed_up(existing), price_in, price_out).first()
        lines = [f"Rules of other tools stay in the project: {', '.join(names)}", f"To fit the new ones to them: {expected['input_tokens']:,} tokens in, about {expected['output_tokens']:,} out"]
        answer = choose(expected["total_cost"], lines)
        if answer not in DECISIONS:
            raise ValueError(f"no such answer: {answer}")
        if answer == "cancel":
            raise Declined("fitting the rules to those of other tools was called off")
        if answer == "skip":
            return rules.select("format", "content")
    return analysis.deconflicted(rules, existing, desk)


def _merged_with_files(spark: SparkSession, root: str, config: Config, rules: DataFrame, settled: list[tuple[str, str, str]], desk: analysis.Desk, price_in: float, price_out: float, confirm) -> DataFrame:
    """Rules with those of files that are to be merged rewritten by the model, once that is confirmed."""
    held = {}
    for format_, path, action in settled:
        if action == "merge":
            with open(os.path.join(root, path), encoding="utf-8") as f:
                held[format_] = f.read()
    if not held:
        return rules
    pairs = spark.createDataFrame(list(held.items()), "format string, existing string").join(rules, "format")
    if confirm and not config.no_confirm:
        e = cost.merge_estimate(text.byte_size(F.col("existing")), text.byte_size(F.col("content")), F.lit(price_in), F.lit(price_out))
        expected = pairs.agg(F.sum(e["total_cost"])).first()[0]
        if not confirm(expected, [f"Smart merge of {', '.join(sorted(held))}: ${expected:.4f}"]):
            raise Declined("the merge was not confirmed")
    new = analysis.smart_merged(pairs, desk).withColumnRenamed("content", "merged")
    return rules.join(new, "format", "left").select("format", F.coalesce("merged", "content").alias("content"))
