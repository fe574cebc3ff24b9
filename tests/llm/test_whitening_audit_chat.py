"""Whitening, filter audit and chat formatting against plain numpy and Python, on small odd tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import chat, filter_audit, queries, whitening

VECTORS = "vec_id long, embedding array<float>, x string, i int"


# Whitening -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("made", ["random", "clusters", "rank", "equal", "wilkinson", "tiny"])
def test_components_of_matrices(made):
    r = np.random.default_rng(5)
    q, _ = np.linalg.qr(r.normal(size=(48, 48)))
    a = {
        "random": lambda: np.cov(r.normal(size=(40, 200))), "clusters": lambda: q @ np.diag([7.0] * 5 + [7 - 1e-9] * 3 + [3.0] * 10 + [1e-9] * 30) @ q.T,
        "rank": lambda: np.cov(r.normal(size=(30, 6))), "equal": lambda: np.eye(20) * 4, "wilkinson": lambda: np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1), "tiny": lambda: 1e-200 * np.cov(r.normal(size=(9, 50))),
    }[made]()
    a = (a + a.T) / 2
    values, vectors = whitening.leading_components(a, 16)
    size = np.abs(np.linalg.eigvalsh(a)).max()
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][: len(values)]).max() < 1e-13 * size
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def by_hand(rows: list) -> tuple[list, np.ndarray]:
    """Kept (vec_id, x) with Python's whole numbers, and the covariance of the distinct ones."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(x) for _, x in kept), default=0)
    kept = [(i, tuple(x + [1_000_000] * (size - len(x)))) for i, x in kept]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    return [(i, n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), [(n * c - s) / n for c, s in zip(x, sums, strict=True)]) for i, x in kept], off.T @ off / n


def test_whitening(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1 + j) for j in range(20)]) for i in range(150)]
    rows += [(7, rows[3][1]), (7, rows[4][1]), (None, rows[5][1]), (300, rows[6][1][:19] + [0.004]), (301, rows[6][1][:19]), (302, None), (303, [1.0, None] * 10), (304, [float("nan")] * 20), (305, [float("inf")] + [0.0] * 19), (306, []), (307, [300.0] * 20)] + [(400 + i, rows[0][1]) for i in range(80)]
    spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], VECTORS).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op11_whitening"](spark, str(tmp_path)).collect()
    want, covariance = by_hand(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert Counter((g.vec_id, g.component) for g in got) == Counter((w[0], k) for w in want for k in range(1, 17))
    key = lambda i, far: (repr(i), far)
    found: dict = {}
    for g in got:
        assert g.n == want[0][1] and abs(g.explained - values[g.component - 1] / np.trace(covariance)) < 1e-9 and g.identity_error < 1e-6
        found.setdefault(key(g.vec_id, g.deviation), {})[g.component] = g.whitened
    assert {key(i, far) for i, _, far, _ in want} == set(found)
    signs = {}
    for i, _, far, off in want:
        for k in range(1, 17):
            expected = float(np.dot(off, vectors[:, k - 1]) / math.sqrt(values[k - 1]))
            have = found[key(i, far)][k]
            if k not in signs and abs(expected) > 0.1:
                signs[k] = np.sign(expected * have)
            assert abs(have * signs.get(k, 1) - expected) < 1e-5 or abs(abs(have) - abs(expected)) < 1e-5


def test_whitening_of_little(spark):
    frame = lambda rows: whitening.prepared(spark.createDataFrame([(i, v, "", 0) for i, v in rows], VECTORS))
    assert whitening.fitted(frame([])) is None and whitening.fitted(frame([(1, None), (2, [])])) is None
    one = frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(g.vec_id, g.component, g.n, g.deviation, g.whitened, g.explained) for g in whitening.whitened(one, whitening.fitted(one)).orderBy("vec_id", "component").collect()] == [(i, k, 1, 0, None, 0.0) for i in (1, 2) for k in (1, 2)]
    # Entries near the ends of 64 bits: exact digits where a long can't hold them; 3e38 has no x.
    large = [(1, [1e17, 1.0]), (2, [-1e17, 0.5]), (3, [0.0, 2.0]), (4, [3e38, 0.0])]
    got = whitening.whitened(frame(large), whitening.fitted(frame(large))).where("component = 1").orderBy("vec_id").collect()
    want, _ = by_hand(large[:3])
    assert [(g.vec_id, g.deviation, g.deviation_digits) for g in got] == [(i, far if far < 1 << 63 else None, None if far < 1 << 63 else str(far)) for i, _, far, _ in want]
    assert got[0].identity_error < 1e-6


# Filter audit ----------------------------------------------------------------------------------------


def audit_by_hand(docs: list, labels: list) -> Counter:
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
        fails = {f for f, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)), strict=True) if bad}
        rows.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, steps, shares = [r for r in rows if r[0] == part], [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shares[f] += len(gone)
                steps.append((f, (part, "".join(order), k, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))))
        out += [(*s, shares[f]) for f, s in steps]
    return Counter(out)


def test_filter_audit(spark, tmp_path):
    r = random.Random(9)
    text = lambda: " ".join(r.choice(["word%d" % r.randint(0, 400), "a", "B", "é"]) for _ in range(r.randint(150, 260))) + r.choice(["", "", " $", "X" * 90])
    docs = [(i, text(), r.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [(100 + i, docs[i % 4][1], r.choice(["en", "fr"])) for i in range(25)] + [(101, docs[0][1], "en"), (3, docs[3][1], "en"), (None, docs[1][1], "en"), (None, None, "en"), (200, "", "en"), (201, None, "de"), (200, "", "en"), (202, "  \x1c x\x0b\x0c\r", "en"), (203, "w " * 300, "de")]
    labels = [(i, r.randint(0, 1), r.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, part string, mask int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op12_filter_audit"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == audit_by_hand(docs, labels)
    nothing = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    assert filter_audit.audit(filter_audit.cells(nothing, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect() == []


def test_words_by_blocks(monkeypatch):
    text = ("one two\tthree\x0bone  é\r\n" * 500 + "last").encode()
    want = filter_audit.words_of(text)
    for block in (1, 7, 100):
        monkeypatch.setattr(filter_audit, "BLOCK", block)
        assert filter_audit.words_of(text) == want == (2501, 5)
        assert filter_audit.words_of(b" a b ") == (2, 2) and filter_audit.words_of(b"") == (0, 0)


def test_gray_code_walk_against_sums():
    r = np.random.default_rng(3)
    masks, weights = np.arange(32), r.integers(0, 1 << 40, (32, 3))
    kept = filter_audit.survivors(masks, weights, 5)
    for s in range(32):
        assert (kept[s] == weights[masks & s == 0].sum(axis=0)).all()


# Chat formatting -------------------------------------------------------------------------------------

ODD = ["", "plain", "back\\slash \\", "\\\\n", "<|start|>user\nx<|end|>\n", "</s>[INST] ok [/INST]", "<<<SYS>>", "<|start|", "|><|end|>\\", "é 😀\n\n", "<\\|end|>", "[" * 3 + "INST]", "<s" + "<s>" + ">"]


def test_template_is_reversible():
    r = random.Random(1)
    pieces = [*chat.CONTROLS, "\\", "\n", "<", "[", "|>", "a", "é", ">"]
    for k in range(400):
        said = [(r.choice(["user", "assistant", "", "a\nb", "<|end|>\\"]), ODD[k] if k < len(ODD) else "".join(r.choices(pieces, k=r.randint(0, 9)))) for _ in range(3)]
        made = [chat.turn(*s) for s in said]
        whole = "".join(t for t, _, _ in made)
        assert chat.turns(whole) == said and all(chat.unescaped(t[a:b]) == s for (t, a, b), (_, s) in zip(made, said, strict=True))
        # What the texts say is no control string of the result: only the template's own are.
        assert sum(whole.count(c) for c in chat.CONTROLS) == 2 * len(said)


def test_chats(spark, tmp_path):
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", None, "system"]), r.choice([*ODD, None])) for c in (1, 2, None, 5) for t in range({1: 600, 2: 5, None: 3, 5: 1}[c])]
    rows += [(2, 3, "assistant", "tie"), (2, 3, "assistant", "tie"), (2, None, "user", "first")]
    spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, tree string, leaf int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {g.conv_id: g for g in queries.QUERIES["op13_chat_format"](spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", ODD[5]), (-1, 1, "assistant", ODD[5])]
    assert set(got) == {x[0] for x in rows}
    for c, g in got.items():
        own = sorted(((t, role or "", text or "") for i, t, role, text in rows if i == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        learned = "".join(text for _, role, text in own if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (g.n_turns, g.turns_sha256) == (len(own), digest("".join(f"{role}\n{text}\n" for _, role, text in own)))
        assert (g.loss_chars, g.loss_sha256) == (len(learned), digest(learned))
        assert g.formatted_chars == sum(len(chat.turn(role, text)[0]) for _, role, text in own)


def test_reply_trees(spark, monkeypatch):
    # Tree 1: 1 - 2 - {3, 4 - 5}, 1 - 6; tree 2: a chain of 40; tree 3: a cycle 1 - 2 with 3 below it, a root 4, a message 5 whose parent is missing.
    rows = [(1, 1, None, 0.5), (1, 2, 1, 1.0), (1, 3, 2, 9.0), (1, 4, 2, None), (1, 5, 4, 9.0), (1, 6, 1, 2.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (3, 3, 2, 1.0), (3, 4, None, 1.0), (3, 5, 77, 1.0)] + [(2, i, i - 1 if i else None, 0.0) for i in range(40)]
    messages = spark.createDataFrame([(*x, "assistant" if x[1] % 2 else "user", f"m{x[1]}") for x in rows], "tree long, message long, parent long, score double, role string, text string").repartition(3)
    got: dict = {}
    for p in chat.formatted(messages, segment=16).orderBy("tree", "rank", "segment").collect():
        assert [p.text[a:b] for a, b in zip(p.starts, p.ends, strict=True)] == [t for role, t in chat.turns(p.text) if role == "assistant"]
        got.setdefault((p.tree, p.rank, p.leaf, p.score), []).append([t for _, t in chat.turns(p.text)])
    chain = [f"m{i}" for i in range(40)]
    assert got == {(1, 1, 3, 10.5): [["m1", "m2", "m3"]], (1, 2, 5, 10.5): [["m1", "m2", "m4", "m5"]], (1, 3, 6, 2.5): [["m1", "m6"]], (2, 1, 39, 0.0): [chain[:16], chain[16:32], chain[32:]], (3, 1, 4, 1.0): [["m4"]], (3, 2, 5, 1.0): [["m5"]]}
    best = chat.formatted(messages, best=1, segment=64)
    assert sorted((p.tree, p.leaf) for p in best.collect()) == [(1, 3), (2, 39), (3, 4)]
    assert {(p.tree, p.n_turns, p.formatted_chars) for p in chat.read_back(best).collect()} == {(p.tree, len(chat.turns(p.text)), len(p.text)) for p in best.collect()}
    assert chat.formatted(messages.where("false")).collect() == []
