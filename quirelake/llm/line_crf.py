"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Features of a line are shares of character classes,
of repeated and very long words, and its length; those of the lines before and
after it are features too. Forward and backward passes give each line's
marginal of being good; their mean, weighted by line length, is the document's
quality, which a logistic function of one variable brings to a probability.

The field is trained on a bounded sample of labelled documents (SAMPLE_DOCS of
them, none of over SAMPLE_BYTES), whose lines all
carry their document's label, by gradient ascent on the penalised conditional
log-likelihood. Only the text is an input of a score.

A null or empty text is one empty line. Texts are worked through together, about
a megabyte at a time; one of over LONG bytes alone, in blocks of lines, and a
line of over LONG bytes in blocks of words, with what goes on from block to
block carried over. Its chain is summed up in stretches side by side. So beside
the text itself, some bytes for each line and for each different word of a line
are held. Nothing is cut. Repeated
rows score alike; null ids are carried through, and are no training rows; other
columns come through as they are; an empty table gives no rows. With no labels
every document scores one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_rows, fresh, narrow, table

#: Labelled documents that the field is trained on, at most, and bytes of each, and of all of them together, at most.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_SUM = 3_000, 100_000, 20 << 20
STEPS, RATE, PENALTY = 300, 0.05, 1e-3
SPACE, LOWER, UPPER, DIGIT, STOP, COMMA, BANG, MARKUP, OTHER, HIGH = range(10)


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER)
    kind[128:] = HIGH
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[ord("a") : ord("z") + 1] = LOWER
    kind[ord("A") : ord("Z") + 1] = UPPER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[ord(c) for c in ".;:"]] = STOP
    kind[ord(",")] = COMMA
    kind[[ord(c) for c in "!?"]] = BANG
    kind[[ord(c) for c in "|<>{}[]\\^~_=+/"]] = MARKUP
    return kind.astype(np.uint8)


CLASSES = _classes()
#: Counts of three classes side by side in a 64-bit word, 21 bits each, summed over BLOCK bytes at most.
PACKED = [np.where(CLASSES == a, 1, 0).astype(np.uint64) | np.where(CLASSES == b, 1 << 21, 0).astype(np.uint64) | np.where(CLASSES == c, 1 << 42, 0).astype(np.uint64) for a, b, c in ((SPACE, LOWER, UPPER), (DIGIT, STOP, COMMA), (BANG, MARKUP, OTHER))]
BLOCK = 1 << 20
#: Bytes over which a text, or a line, goes by blocks. Stretches of a long chain that are added up at a time.
LONG, STRETCHES = 4 << 20, 256
N_OWN = 16
ODD = np.uint64(0x9E3779B97F4A7C15)


def _segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values from each start to the next; starts ascend strictly."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of every line (lines x N_OWN), line lengths in bytes, and for each text its number of lines."""
    raws = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(raws), np.uint8)
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.zeros(0, np.int64)
    text_ends = np.cumsum([len(r) for r in raws])
    n_lines = np.diff(np.concatenate([[0], np.searchsorted(breaks, text_ends - 1, side="right")]))
    lengths = breaks - starts
    counts = np.zeros((len(starts), 10))
    # Pieces of lines of BLOCK bytes at most, so that 21 bits hold a count.
    pieces = np.unique(np.concatenate([starts, np.arange(0, len(raw), BLOCK)]))
    owner = np.searchsorted(starts, pieces, side="right") - 1
    for k, lut in enumerate(PACKED):
        sums = _segment_sums(lut[raw], pieces)
        for j in range(3):
            np.add.at(counts[:, 3 * k + j], owner, ((sums >> np.uint64(21 * j)) & np.uint64((1 << 21) - 1)).astype(np.float64))
    counts[:, 9] = lengths + 1 - counts[:, :9].sum(axis=1)
    counts[:, SPACE] -= 1  # the line break
    # Words: bytes between spaces. A word's hash is a sum over its bytes of a mixed value, shifted by its place in the word.
    word = CLASSES[raw] != SPACE
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    same = np.zeros((len(starts), 2))
    n_words, long_words = np.zeros(len(starts)), np.zeros(len(starts))
    if len(first):
        place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(raw)]])))
        mixed = (raw.astype(np.uint64) + np.uint64(1)) * (ODD + place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
        mixed[~word] = 0
        hashes = _segment_sums(mixed, first)
        line = np.searchsorted(starts, first, side="right") - 1
        n_words += np.bincount(line, minlength=len(starts))
        long_words += np.bincount(line, weights=(last - first) > 20, minlength=len(starts))
        for j, lag in enumerate((1, 2)):
            again = np.zeros(len(first), bool)
            again[lag:] = (hashes[lag:] == hashes[:-lag]) & (line[lag:] == line[:-lag])
            same[:, j] = np.bincount(line, weights=again, minlength=len(starts))
        again = np.zeros(len(first), bool)
        order = np.lexsort((hashes, line))
        repeat = (hashes[order][1:] == hashes[order][:-1]) & (line[order][1:] == line[order][:-1])
        again[order[1:]] = repeat
        seen = np.bincount(line, weights=again, minlength=len(starts))
    else:
        seen = np.zeros(len(starts))
    return _own_features(counts, lengths, n_words, long_words, same, seen), lengths.astype(np.float64), n_lines


def _own_features(counts: np.ndarray, lengths: np.ndarray, n_words: np.ndarray, long_words: np.ndarray, same: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Features of lines (lines x N_OWN) from what was counted in them."""
    size, words = np.maximum(lengths, 1), np.maximum(n_words, 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER] + counts[:, HIGH], 1)
    return np.stack(
        [
            *(np.sqrt(counts[:, k] / size) for k in (SPACE, DIGIT, STOP, COMMA, BANG, MARKUP, OTHER, HIGH)),
            np.sqrt(counts[:, UPPER] / letters), (counts[:, OTHER] + counts[:, MARKUP] + counts[:, BANG]) / words,
            same[:, 0] / words, same[:, 1] / words, seen / words, long_words / words, np.log1p(lengths) / 8, (lengths == 0).astype(float),
        ],
        axis=1,
    )


def long_line_features(raw: memoryview) -> np.ndarray:
    """Own features of one line (bytes without its break), block by block: a word that goes on in the next block is carried over."""
    counts, n_words, long_words, same = np.zeros(10), 0, 0, np.zeros(2)
    seen, recent = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    size, total = 0, np.uint64(0)  # bytes of the word that is open, and their sum
    for a in range(0, len(raw) + 1, BLOCK):
        block = np.frombuffer(raw[a : a + BLOCK], np.uint8)
        last = a + BLOCK > len(raw)
        counts += np.bincount(CLASSES[block], minlength=10)
        word = CLASSES[block] != SPACE
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        first, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes, sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(first):
            sizes = ends - first
            place = np.arange(len(block)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(block)]])))
            if first[0] == 0:
                place[: ends[0]] += size
            mixed = (block.astype(np.uint64) + np.uint64(1)) * (ODD + place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1))
            mixed ^= mixed >> np.uint64(29)
            mixed[~word] = 0
            hashes = _segment_sums(mixed, first)
            if first[0] == 0:
                hashes[:1] += total
                sizes[0] += size
                size, total = 0, np.uint64(0)
        if size:  # the word ended where the block began
            hashes, sizes = np.concatenate([[total], hashes]), np.concatenate([[size], sizes])
            size, total = 0, np.uint64(0)
        if len(hashes) and len(block) and word[-1] and not last:
            size, total, hashes, sizes = int(sizes[-1]), hashes[-1], hashes[:-1], sizes[:-1]
        n_words += len(hashes)
        long_words += int((sizes > 20).sum())
        chain = np.concatenate([recent, hashes])
        for j, lag in enumerate((1, 2)):
            new = np.arange(max(lag, len(recent)), len(chain))
            same[j] += (chain[new] == chain[new - lag]).sum()
        recent = chain[-2:]
        seen = np.union1d(seen, hashes)
    one = lambda v: np.array([v], float)
    return _own_features(counts[None, :], one(len(raw)), one(n_words), one(long_words), same[None, :], one(n_words - len(seen)))


def blocks_of_lines(raw: memoryview) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Own features and lengths of the lines of a text (bytes with a break at the end), about BLOCK bytes at a time."""
    at, n = 0, len(raw)
    while at < n:
        end = min(at + BLOCK, n)
        cut = bytes(raw[at:end]).rfind(b"\n")
        if cut >= 0:
            own, lengths, _ = line_features([bytes(raw[at : at + cut]).decode("utf-8", "surrogatepass")])
            at += cut + 1
        else:
            # A line longer than a block: where does it end?
            while (cut := bytes(raw[end : end + BLOCK]).find(b"\n")) < 0:
                end += BLOCK
            line, at = raw[at : end + cut], end + cut + 1
            own = long_line_features(line) if len(line) > LONG else line_features([bytes(line).decode("utf-8", "surrogatepass")])[0]
            lengths = np.array([float(len(line))])
        yield own, lengths


def chain_mean(emit: np.ndarray, weight: np.ndarray, trans: np.ndarray) -> float:
    """The mean marginal of good of one chain, weighted: forward and backward over stretches side by side, of which only the ends are kept."""
    n = len(emit)
    size = max(1, int(np.sqrt(n)))
    starts = np.arange(0, n, size)

    def stretch(first: int, last: int) -> np.ndarray:
        """Log-potentials of stretches first to last - 1 as columns of positions, NaN beyond the end of the chain."""
        out = np.full((last - first) * size, np.nan)
        own = emit[first * size : min(last * size, n)]
        out[: len(own)] = own
        return out.reshape(-1, size)

    # What each stretch makes of being bad or good in the place before it: 2 x 2 for each.
    many = len(starts)
    through = np.empty((many, 2, 2))
    for a in range(0, many, STRETCHES):
        x = stretch(a, min(a + STRETCHES, many))
        m = np.where(np.eye(2, dtype=bool), 0.0, -np.inf)[None].repeat(len(x), axis=0)
        for t in range(size):
            live = ~np.isnan(x[:, t])
            own = np.stack([np.zeros(live.sum()), x[live, t]], axis=1)
            moved = np.stack([np.logaddexp(m[live, :, 0] + trans[0, k], m[live, :, 1] + trans[1, k]) for k in (0, 1)], axis=2)
            if a == 0 and t == 0:
                moved[0] = m[0]  # no step leads into the first line
            m[live] = moved + own[:, None, :]
        through[a : a + len(x)] = m
    before, after = np.zeros((many, 2)), np.zeros((many, 2))  # forward into a stretch, backward out of it
    for i in range(1, many):
        got = np.logaddexp(before[i - 1, 0] + through[i - 1, 0], before[i - 1, 1] + through[i - 1, 1])
        before[i] = got - got.max()
    for i in range(many - 2, -1, -1):
        got = np.logaddexp(through[i + 1, :, 0] + after[i + 1, 0], through[i + 1, :, 1] + after[i + 1, 1])
        after[i] = got - got.max()
    total = 0.0
    for a in range(0, many, STRETCHES):
        x = stretch(a, min(a + STRETCHES, many))
        k = len(x)
        fore, back = np.zeros((k, size, 2)), np.zeros((k, size, 2))
        f = before[a : a + k].copy()
        for t in range(size):
            live = ~np.isnan(x[:, t])
            own = np.stack([np.zeros(k), np.nan_to_num(x[:, t])], axis=1)
            moved = np.logaddexp(f[:, :1] + trans[0], f[:, 1:] + trans[1])
            if a == 0 and t == 0:
                moved[0] = 0.0
            f = np.where(live[:, None], moved + own, f)
            fore[:, t] = f
        b = after[a : a + k].copy()
        for t in range(size - 1, -1, -1):
            live = ~np.isnan(x[:, t])
            back[:, t] = b
            nxt = np.stack([np.zeros(k), np.nan_to_num(x[:, t])], axis=1) + b
            b = np.where(live[:, None], np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:]), b)
        both = fore + back
        good = np.exp(both[..., 1] - np.logaddexp(both[..., 0], both[..., 1])).ravel()
        own = weight[a * size : (a + k) * size]
        total += float(good[: len(own)] @ own)
    return total / float(weight.sum())


def with_neighbours(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Each line's own features, those of the line before and after it (zero at the ends, which are marked), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    starts = np.cumsum(n_lines) - n_lines
    begins, ends = np.zeros((len(own), 1)), np.zeros((len(own), 1))
    begins[starts], ends[starts + n_lines - 1] = 1, 1
    before[starts], after[starts + n_lines - 1] = 0, 0
    return np.concatenate([own, before, after, begins, ends, np.ones((len(own), 1))], axis=1)


def marginals(emit: np.ndarray, trans: np.ndarray, n_lines: np.ndarray, steps: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once.

    emit: log-potential of good for each line (bad has 0); trans: 2 x 2. Returns
    for each line the marginal of good, for each line the marginals of the step
    into it (lines x 2 x 2, zero at a chain's start; none without steps), and each
    chain's log partition.
    """
    n = len(emit)
    starts = np.cumsum(n_lines) - n_lines
    order = np.argsort(-n_lines, kind="stable")
    sizes, at = n_lines[order], starts[order]
    own = np.stack([np.zeros(n), emit], axis=1)
    fore, back = np.zeros((n, 2)), np.zeros((n, 2))
    most = int(sizes[0]) if len(sizes) else 0
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(most)]  # chains of more than t lines
    for t in range(most):
        i = at[: live[t]] + t
        fore[i] = own[i] if t == 0 else own[i] + np.logaddexp(fore[i - 1, :1] + trans[0], fore[i - 1, 1:] + trans[1])
    for t in range(most - 2, -1, -1):
        i = at[: live[t + 1]] + t
        nxt = own[i + 1] + back[i + 1]
        back[i] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
    ends = starts + n_lines - 1
    log_z = np.logaddexp(fore[ends, 0], fore[ends, 1])
    of = np.repeat(log_z, n_lines)
    good = np.exp(np.minimum(fore[:, 1] + back[:, 1] - of, 0))
    if not steps:
        return good, np.zeros((0, 2, 2)), log_z
    step = np.zeros((n, 2, 2))
    inner = np.ones(n, bool)
    inner[starts] = False
    j = np.flatnonzero(inner)
    step[j] = np.exp(np.minimum(fore[j - 1][:, :, None] + trans + (own[j] + back[j])[:, None, :] - of[j][:, None, None], 0))
    return good, step, log_z


@dataclass
class LineField:
    weights: np.ndarray
    trans: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal of good for each line, line lengths, lines of each text."""
        own, lengths, n_lines = line_features(texts)
        x = (with_neighbours(own, n_lines) - self.centre) / self.spread
        return marginals(x @ self.weights, self.trans, n_lines, steps=False)[0], lengths, n_lines

    def mean_marginal(self, texts: list[str]) -> np.ndarray:
        good, lengths, n_lines = self.lines(texts)
        starts = np.cumsum(n_lines) - n_lines
        weight = lengths + 1
        return _segment_sums(good * weight, starts) / _segment_sums(weight, starts)

    def long_mean_marginal(self, text: str) -> float:
        """mean_marginal of one text, without its features all at once: a line's potential is a sum over itself and its neighbours."""
        raw = memoryview(text.encode("utf-8", "surrogatepass") + b"\n")
        scale = self.weights / self.spread
        base = float(-self.centre @ scale + scale[-1])
        parts, sizes = [], []
        for own, lengths in blocks_of_lines(raw):
            parts.append(np.stack([own @ scale[:N_OWN], own @ scale[N_OWN : 2 * N_OWN], own @ scale[2 * N_OWN : 3 * N_OWN]]))
            sizes.append(lengths)
        here, next_has, last_has = np.concatenate(parts, axis=1)
        emit = here + base
        emit[1:] += next_has[:-1]
        emit[:-1] += last_has[1:]
        emit[0] += scale[3 * N_OWN]
        emit[-1] += scale[3 * N_OWN + 1]
        return chain_mean(emit, np.concatenate(sizes) + 1, self.trans)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if len(texts) == 1 and len(texts[0]) > LONG:
            m = np.array([self.long_mean_marginal(texts[0])])
            return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.mean_marginal(texts) + self.shift, -30, 30)))


def _adam(grad, params: list[np.ndarray], steps: int, rate: float) -> None:
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(params, grad(*params), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def portions(texts: list[str]) -> Iterator[list[str]]:
    """texts, about a megabyte at a time."""
    own, held = [], 0
    for t in texts:
        own.append(t)
        held += len(t)
        if held >= BLOCK:
            yield own
            own, held = [], 0
    if own:
        yield own


def train(texts: list[str], labels: list[int]) -> LineField:
    """Fits the field, then the logistic function of the mean marginal."""
    n = N_OWN * 3 + 3
    if not texts or len(set(labels)) < 2:
        rate = float(np.mean(labels)) if labels else 0.5
        rate = min(max(rate, 0.01), 0.99)
        return LineField(np.zeros(n), np.zeros((2, 2)), np.zeros(n), np.ones(n), 0.0, float(np.log(rate / (1 - rate))))
    # Features of some texts at a time: finding them takes far more memory than they do.
    own, _, n_lines = (np.concatenate(c) for c in zip(*map(line_features, portions(texts)), strict=True))
    x = with_neighbours(own, n_lines)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    centre[-1], spread[-1] = 0, 1
    x = (x - centre) / spread
    y = np.repeat(np.array(labels, float), n_lines)
    # A document counts once however many lines it has, and both labels count alike.
    share = np.bincount(np.array(labels, int), minlength=2) / len(labels)
    doc_weight = np.array([0.5 / share[k] for k in labels]) / n_lines
    w = np.repeat(doc_weight, n_lines)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(n_lines) - n_lines] = False
    j = np.flatnonzero(inner)
    seen = np.zeros((len(y), 2, 2))
    seen[j, y[j - 1].astype(int), y[j].astype(int)] = 1

    def grad(weights, trans):
        good, step, _ = marginals(x @ weights, trans, n_lines)
        return x.T @ (w * (y - good)) / len(labels) - PENALTY * weights, ((seen - step) * w[:, None, None]).sum(axis=0) / len(labels) - PENALTY * trans

    weights, trans = np.zeros(n), np.zeros((2, 2))
    _adam(grad, [weights, trans], STEPS, RATE)
    field = LineField(weights, trans, centre, spread)
    m, z = np.concatenate([field.mean_marginal(some) for some in portions(texts)]), np.array(labels, float)

    def slope(line):
        p = 1 / (1 + np.exp(-np.clip(line[0] * m + line[1], -30, 30)))
        return (np.array([((z - p) * m).mean(), (z - p).mean()]) - 1e-4 * line,)

    line = np.array([6.0, -3.0])
    _adam(slope, [line], 2_000, 0.05)
    field.slope, field.shift = float(line[0]), float(line[1])
    return field


def held_out(doc_id):
    """Column: rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_DOCS) -> tuple[list[str], list[int]]:
    """At most n labelled rows that aren't held out, by a hash of doc_id, but none of over SAMPLE_BYTES, and none when SAMPLE_SUM is full; a document with labels of both kinds counts as bad."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # n rows at most: a proven bound for the broadcast.
    few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    texts = narrow(docs).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = bounded_rows(texts, SAMPLE_SUM)
    return [r.text for r in rows], [int(r.quality > 0) for r in rows]


def fitted(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_DOCS) -> LineField:
    return train(*sample(docs, labels, n))


def scored(docs: DataFrame, field: LineField) -> DataFrame:
    """docs (all its columns) and the score, as quality_score in the last place; underscores are added where docs has such a column."""
    (name,) = fresh(docs, "quality_score")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = np.zeros(len(texts))
            start, held = 0, 0
            for i, t in enumerate(texts):
                if len(t) > LONG and i > start:
                    out[start:i] = field.score(texts[start:i])
                    start, held = i, 0
                held += len(t)
                if held >= 1 << 20 or i == len(texts) - 1:
                    out[start : i + 1] = field.score(texts[start : i + 1])
                    start, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    narrow(docs)  # ships the package
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(each, f"{out}, `{name}` double")


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"))
    field = fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored(docs, field).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
