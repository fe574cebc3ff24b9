"""Secret scan: fixed patterns, and spans that character Markov models call random.

Two first-order character models are trained from labelled samples: one of
random strings (values that the patterns find in a bounded sample; strings from
a seeded generator over the usual alphabets are its prior, and weigh as PRIOR
strings do together, or as they are if fewer values than that are found) and one of ordinary identifiers (all other long tokens of
the sample, and names made of its words by a seeded generator: paths, dates,
constants, numbered names, runs of the alphabet). A quarter of either kind is
held out, and the bound on the mean log-likelihood ratio for each character is
the least that at most FALSE_ALARMS of the held-out ordinary strings pass, and
LEAST_BOUND at least. A token of LEAST characters or more, or as long a part of
one outside the pattern spans, is a secret if it is over the bound; shorter ones
are never judged by the models. One without any letter (a number, a rule of
signs) is none.

A null text counts as empty and has no span. Rows are independent, so repeated
rows, null ids and very long texts need no special care; other columns come
through as they are; an empty table gives no rows, and a model trained on the
generator alone.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_rows, fresh, narrow, table

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")
#: Tokens that the models judge.
LEAST = 16
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST)
LETTER = re.compile("[A-Za-z]")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
INDEX = {c: i + 1 for i, c in enumerate(ALPHABET)}
#: Documents that the models are trained on, at most, and bytes of each, and of all of them together, at most.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_SUM = 2_000, 100_000, 20 << 20
#: Labelled strings that the generator's strings count for.
PRIOR = 50.0
#: Share of held-out ordinary strings that may be over the bound, and the least that the bound can be.
FALSE_ALARMS, LEAST_BOUND = 0.002, 0.25
#: Made ordinary names of each kind, and what they weigh as together beside the tokens of the sample.
MADE, MADE_WEIGHT = 400, 4_000.0
#: Usual parts of paths and names, beside the words of the documents.
USUAL = (
    "usr local lib python share bin etc home var log data config src main test index user admin public static assets include system service server client module package version release build docs "
    "images node modules java scala spark hadoop http https www html json yaml utf name value key list map table column row file path time date year month day hour minute second total count number "
    "first last next previous open close read write update delete insert select from where group order by and or not the of to in for with max min buffer size length width height default timeout error warning debug info"
).split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of what the fixed patterns find, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Markov:
    """Log-likelihood ratio of random against ordinary for each pair of characters (0: the start), and the bound on its mean.

    false_alarms and hits: shares of held-out ordinary and random strings over the bound.
    """

    ratio: np.ndarray
    bound: float = LEAST_BOUND
    false_alarms: float = 0.0
    hits: float = 0.0

    def score(self, token: str) -> float:
        at = [0, *(INDEX[c] for c in token)]
        return float(self.ratio[at[:-1], at[1:]].mean())

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of kind 3: tokens, or their parts outside the other spans, that look random."""
        out = []
        for m in TOKEN.finditer(text):
            parts, at = [], m.start()
            for a, _, b in taken:
                if a < m.end() and at < b:
                    parts.append((at, a))
                    at = b
            for a, b in [*parts, (at, m.end())]:
                own = text[a:b]
                if b - a >= LEAST and LETTER.search(own) and self.score(own) > self.bound:
                    out.append((a, 3, b))
        return out


def _counts(tokens: list[str], weight: float = 1.0) -> np.ndarray:
    """How often each pair of characters occurs."""
    seen = np.zeros((len(INDEX) + 1, len(INDEX) + 1))
    for t in tokens:
        at = [0, *(INDEX[c] for c in t)]
        np.add.at(seen, (at[:-1], at[1:]), weight)
    return seen


def _log_rates(seen: np.ndarray, smooth: float) -> np.ndarray:
    seen = seen + smooth
    seen[:, 0] = 0
    return np.log(np.maximum(seen, 1e-12) / seen.sum(axis=1, keepdims=True))


def drawn(n: int, seed: int = 7) -> list[str]:
    """Random strings over the alphabets that keys are written in."""
    rnd = random.Random(seed)
    alphabets = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase]
    return ["".join(rnd.choices(alphabets[i % len(alphabets)], k=rnd.randint(16, 48))) for i in range(n)]


def named(words: list[str], n: int = MADE, seed: int = 11) -> list[str]:
    """Ordinary names of LEAST characters or more, n of each kind: paths, dates, constants, numbered names, runs."""
    rnd = random.Random(seed)
    words = [w for w in words if w.isascii()] or USUAL
    word = lambda: rnd.choice(USUAL if rnd.random() < 0.5 else words)
    number = lambda: str(rnd.choice([rnd.randint(0, 9), rnd.randint(10, 99), rnd.randint(1900, 2099), rnd.randint(0, 999_999)]))
    runs = [string.ascii_lowercase, string.ascii_uppercase, string.digits, "qwertyuiopasdfghjklzxcvbnm", string.ascii_letters + string.digits, "abcdef0123456789", "0123456789ABCDEF"]

    def joined(sep: str, make=word, change=lambda w: w) -> str:
        out = change(make())
        while len(out) < LEAST:
            out += sep + change(make())
        return out

    def date() -> str:
        d, t = f"{rnd.randint(1980, 2040)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", [f"{rnd.randint(0, 59):02d}" for _ in range(3)]
        return rnd.choice([f"{d}T{'-'.join(t)}Z", f"{d}T{''.join(t)}Z", f"{d.replace('-', '')}T{''.join(t)}Z", f"{d}_{'-'.join(t)}_{word()}", f"{word()}-{d}-{word()}", f"{word()}_{d.replace('-', '')}_{number()}_{word()}"])

    def run() -> str:
        of = rnd.choice(runs) * 3
        at, size = rnd.randint(0, len(of) // 3), rnd.randint(LEAST, 40)
        return of[at : at + size]

    kinds = [
        lambda: rnd.choice(["/", ""]) + joined("/"), lambda: joined("/", change=str.capitalize), date, lambda: joined("_", change=str.upper), lambda: joined("", change=str.upper), lambda: joined("-", change=str.upper), lambda: joined("_", lambda: word() + rnd.choice(["", number()])),
        lambda: joined("-", lambda: rnd.choice([word(), number()])) + word(), lambda: joined("", change=str.capitalize) + rnd.choice(["", number()]), lambda: joined("_"), lambda: joined("-"), lambda: joined(""), lambda: joined("=", lambda: rnd.choice([word(), word() + "+" + number()])), run,
    ]
    return [kind() for kind in kinds for _ in range(n)]


def labelled(texts: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Random strings and ordinary identifiers of sampled texts, by the fixed patterns, and names made of their words."""
    secret, plain, words = [], [], {}
    for text in texts:
        spans = base_spans(text)
        secret += [t for a, _, b in spans for t in re.findall(r"[A-Za-z0-9+/_=-]{16,}", text[a:b])]
        plain += [m.group() for m in TOKEN.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
        found = re.findall(r"[A-Za-z]{2,12}", text)
        for i in range(0, len(found), max(1, len(found) // 100)):
            words[found[i].lower()] = None
    return secret, plain, named(list(words))


def _held_out(token: str) -> bool:
    return zlib.crc32(token.encode()) % 4 == 0


def train(texts: list[str]) -> Markov:
    secret, plain, made = labelled(texts)
    prior = drawn(4_000)
    own = sorted(set(secret))
    kept = lambda tokens: [t for t in tokens if not _held_out(t)]
    random_pairs = _counts(kept(own)) + _counts(kept(prior), PRIOR / len(prior) if len(own) >= PRIOR else 1.0)
    # Each character over and over is ordinary too.
    ordinary = _counts(kept(plain)) + _counts(kept(made), MADE_WEIGHT / len(made)) + _counts([c * 32 for c in ALPHABET])
    model = Markov(_log_rates(random_pairs, 0.05) - _log_rates(ordinary, 0.5))
    # Strings of the sample are what they are called by the patterns; those that the generators made are so for certain.
    judged = np.sort([model.score(t) for t in made if _held_out(t) and LETTER.search(t)])
    model.bound = max(LEAST_BOUND, float(judged[min(len(judged) - 1, int(len(judged) * (1 - FALSE_ALARMS)))]) + 1e-9)
    model.false_alarms = float((judged > model.bound).mean())
    model.hits = float(np.mean([model.score(t) > model.bound for t in prior if _held_out(t)]))
    return model


def sample_texts(docs: DataFrame, n: int = SAMPLE_DOCS) -> list[str]:
    """A text of each of at most n documents, chosen by a hash of doc_id: the same rows whatever the partitions. Texts of over SAMPLE_BYTES are not among them, nor what is left when SAMPLE_SUM bytes are full."""
    docs = narrow(docs).where("doc_id IS NOT NULL")
    # Ids alone are sorted and sent around; n rows at most are broadcast.
    few = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = docs.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return [r.text for r in bounded_rows(rows, SAMPLE_SUM)]


def find_secrets(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """docs (all its columns) and, in the last three places, kinds, starts, ends: all spans of each text by start, then kind as in KINDS, then markov.

    Underscores are added to the names of those that docs has. A null text comes back empty.
    """
    model = model or train(sample_texts(docs))
    added = fresh(docs, "kinds", "starts", "ends")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KINDS, "markov"]
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                text = x.as_py()
                base = base_spans(text)
                every = sorted(base + model.spans(text, base))
                rows.append(([names[k] for _, k, _ in every], [a for a, _, _ in every], [b for _, _, b in every]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.list_(t)) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True))], [*batch.schema.names, *added])

    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    narrow(docs)  # ships the package
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scan, f"{out}, `{added[0]}` array<string>, `{added[1]}` array<bigint>, `{added[2]}` array<bigint>")


def redacted(docs: DataFrame, mark: str = "[SECRET]", model: Markov | None = None) -> DataFrame:
    """docs with each span of a secret (overlapping ones joined) replaced by the mark; n_chars follows where there is one."""
    columns = docs.columns
    model = model or train(sample_texts(docs))

    def cut(text: str) -> str:
        base = base_spans(text)
        done, parts = 0, []
        for start, _, end in sorted(base + model.spans(text, base)):
            if start >= done:
                parts += [text[done:start], mark]
            done = max(done, end)
        return "".join([*parts, text[done:]])

    def blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([cut(t.as_py() or "") for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in columns], columns)

    out = docs.mapInArrow(blank, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"))
    model = train(sample_texts(docs))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, kinds, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "kinds", "starts", "ends")), strict=True):
                shown = [f"{k}:{a}:{b}" for k, a, b in zip(kinds, starts, ends, strict=True)]
                base = ",".join(s for s, k in zip(shown, kinds, strict=True) if k in KINDS)
                rows.append((doc_id, *(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(shown)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.string(),) * 2, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return find_secrets(docs, model).drop("text").mapInArrow(digest, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
