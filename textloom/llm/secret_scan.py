"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio.

Two order-2 character models are trained from labelled samples: random strings (values that the base patterns caught in a bounded
sample of documents, and strings drawn from a seeded generator) and ordinary identifiers (words and numbers of the same documents,
words joined as identifiers are, and fillers such as one repeated character). Every run of token characters outside the base spans
is scored, whatever characters it has. A stretch of it is a secret if the random model explains it much better than the other: the
stretch of the greatest ratio, then the same again on either side of it. So a key behind a long path or name is still found.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_each, slices, table, texts_of

#: Base patterns (fixed values), in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Documents of the sample that the models are trained on.
SAMPLE_ROWS = 2000
#: Strings drawn for the random model, and the seed.
DRAWN, SEED = 4000, 20240
#: Shortest run of token characters that is scored, shortest stretch of it that may be a secret (its ends may look ordinary), and the
#: ratio (nats) from which it is one: in all and for each character.
LEAST_RUN, LEAST_STRETCH, LEAST_RATIO, LEAST_MEAN = 16, 12, 14.0, 0.7
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_INDEX = {c: i + 1 for i, c in enumerate(ALPHABET)}
STATES = len(ALPHABET) + 1  # 0 stands for the start
_NUMBERED = bytes(_INDEX.get(chr(i), 0) for i in range(256))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of base matches, by start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def transitions(strings: Iterable[str]) -> Counter:
    """Counts of (character before last, last, next) over the alphabet."""
    out: Counter = Counter()
    for s in strings:
        x = [0, 0, *(_INDEX[c] for c in s if c in _INDEX)]
        out.update(zip(x, x[1:], x[2:], strict=False))
    return out


def drawn_strings(n: int = DRAWN, seed: int = SEED) -> list[str]:
    """Random strings over the alphabets that keys use."""
    draw = random.Random(seed)
    alphabets = ("0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits)
    return ["".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(16, 48))) for i in range(n)]


def joined_words(words: list[str]) -> list[str]:
    """Identifiers made of words: snake, kebab and camel case, constants, paths, and words with a number."""
    out = []
    for i in range(0, len(words) - 2, 3):
        a, b, c = words[i : i + 3]
        out += [f"{a}_{b}_{c}", f"{a}-{b}-{c}", f"{a}{b.capitalize()}{c.capitalize()}", f"{a}_{b}".upper(), f"{a}/{b}/{c}", f"{a}_{b}{i % 100}"]
    return out


def fillers() -> list[str]:
    """Runs that are no word and no secret: one character again and again, the alphabet and the digits in order."""
    ordered = (string.ascii_lowercase, string.ascii_uppercase, string.digits)
    return [c * 64 for c in ALPHABET] + [x * 2 for x in ordered] + [x[::-1] * 2 for x in ordered]


_COUNTS = pa.schema([("label", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32()), ("n", pa.int64())])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of the labelled strings of documents: 1 for values of base matches, 0 for words elsewhere."""
    counts = (Counter(), Counter())
    for b in slices(batches, 1):
        for raw in b.column(1).to_pylist():
            text = raw.decode("utf-8", "replace")
            spans = base_spans(text)
            counts[1].update(transitions(text[v:end] for _, _, end, v in spans))
            for start, _, end, _ in reversed(spans):
                text = text[:start] + " " + text[end:]
            words = re.findall(r"[A-Za-z]{2,}", text)
            counts[0].update(transitions(words))
            counts[0].update(transitions(re.findall(r"(?<![A-Za-z0-9])[0-9]{1,15}(?![A-Za-z0-9])", text)))
            counts[0].update(transitions(joined_words(words)))
    rows = [(label, *k, n) for label in (0, 1) for k, n in counts[label].items()]
    if rows:
        yield table(_COUNTS, list(map(list, zip(*rows, strict=True))))


def log_ratios(ordinary: Counter, secret: Counter) -> np.ndarray:
    """log P(next | two before) under the random model less the same under the ordinary one; each backs off to its order-1 and order-0 model."""
    out = []
    for counts in (secret, ordinary):
        n = np.zeros((STATES,) * 3)
        for k, v in counts.items():
            n[k] = v
        zero = n.sum((0, 1)) + 1.0
        zero[0] = 0
        zero /= zero.sum()
        one = n.sum(0)
        one = (one + 8 * zero) / (one.sum(1, keepdims=True) + 8)
        two = (n + 8 * one[None]) / (n.sum(2, keepdims=True) + 8)
        two[:, :, 0] = 1
        out.append(np.log(two))
    return (out[0] - out[1]).astype(np.float32)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log-ratio table from a sample of ``sample_rows`` documents (those of the smallest id hashes) and drawn strings."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = one_each(texts_of(docs).join(F.broadcast(chosen.distinct()), "doc_id")).select("doc_id", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    rows = texts.mapInArrow(_count_batches, "label int, a int, b int, c int, n long").groupBy("label", "a", "b", "c").agg(F.sum("n").alias("n")).collect()
    counts = (Counter(), transitions(drawn_strings()))
    for r in rows:  # at most 2 * STATES ** 3
        counts[r["label"]][r["a"], r["b"], r["c"]] += r["n"]
    if not counts[0]:
        counts[0].update(transitions(joined_words("the quick brown fox jumps over the lazy dog".split())))
    counts[0].update(transitions(fillers()))
    return log_ratios(*counts)


def ratios_of(run: str, table_: np.ndarray) -> np.ndarray:
    """The log ratio of each character of a run, given the two before it."""
    x = np.frombuffer(b"\0\0" + run.encode("ascii").translate(_NUMBERED), np.uint8)
    return table_[x[:-2], x[1:-1], x[2:]]


def best_stretches(r: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) of a run that are secrets by its log ratios: the one of the greatest sum, then the same on either side."""
    out, todo = [], [(0, len(r))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST_STRETCH or np.maximum(r[lo:hi], 0).sum() < LEAST_RATIO:
            continue
        total = np.r_[0.0, np.cumsum(r[lo:hi], dtype=np.float64)]
        gain = total - np.minimum.accumulate(total)
        end = int(np.argmax(gain))
        start = int(np.argmin(total[: end + 1]))
        if gain[end] < LEAST_RATIO:
            continue
        if end - start >= LEAST_STRETCH and gain[end] >= LEAST_MEAN * (end - start):
            out.append((lo + start, lo + end))
        todo += [(lo, lo + start), (lo + end, hi)]
    return sorted(out)


def secret_spans(text: str, table_: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Base spans, and random stretches between them, as (start, kind, end, start of the value)."""
    base = base_spans(text)
    more, at = [], 0
    for start, _, end, _ in [*base, (len(text), 0, len(text), 0)]:
        for m in _RUN.finditer(text, at, max(at, start)):
            more += [(m.start() + lo, 3, m.start() + hi, m.start() + lo) for lo, hi in best_stretches(ratios_of(m.group(), table_))]
        at = max(at, end)
    return sorted(base + more)


def listed(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def redact(text: str, spans: list[tuple[int, int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with the values of all spans replaced; overlapping values become one mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for v, e in sorted((v, e) for _, _, e, v in spans):
        if merged and v <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([v, e])
    for v, e in merged:
        out += [text[at:v], mark]
        at = e
    return "".join([*out, text[at:]])


_SCANNED = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_random", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string()), ("text_sha256", pa.string())])


def _scan_batches(table_: np.ndarray, with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        rows = []
        for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = raw.decode("utf-8", "replace")
            spans = secret_spans(text, table_)
            n = Counter(k for _, k, _, _ in spans)
            base = listed([s for s in spans if s[1] < 3])
            rows.append((doc, n[0], n[1], n[2], n[3], hashlib.sha256(base.encode()).hexdigest(), listed(spans), redact(text, spans) if with_text and spans else None, hashlib.sha256(raw).hexdigest() if with_text else None))
        yield table(_SCANNED, list(map(list, zip(*rows, strict=True))) if rows else [[]] * len(_SCANNED))


def scan(docs: DataFrame, ratios: np.ndarray | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans and, if asked for, the redacted text (null if nothing was found) and text_sha256 of the text before.

    A null text is empty: counts 0, no spans. Repeated rows each come back, a null doc_id stays null, other columns are ignored, an
    empty table gives no rows. ``ratios`` is a trained table; without it one is trained on a bounded sample of ``docs``.
    """
    ratios = train(docs) if ratios is None else ratios
    texts = texts_of(docs)
    out = texts.mapInArrow(partial(_scan_batches, ratios, with_text), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string, text_sha256 string")
    return out if with_text else out.drop("redacted", "text_sha256")
