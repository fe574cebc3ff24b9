"""The pipeline's stages on the small table, against what each is to keep."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from quirelake.llm import line_crf, secrets
from quirelake.llm.common import vocabulary, written
from quirelake.llm.wordcache import encoder

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, D), "test")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.keys() <= before.keys() and len(after) == docs.count()
        bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
        if name == "quality":
            gone = before.keys() - after.keys()
            assert sum(labels.get(i) == 1 for i in gone) <= 2 and sum(labels.get(i) == 0 for i in after) <= 2
        elif name == "exact":
            assert {bare(t) for t in after.values()} == {bare(t) for t in before.values()} and len({bare(t) for t in after.values()}) == len(after)
        elif name == "near":
            assert all(after[i] == before[i] for i in after)
        else:
            assert after.keys() == before.keys()
            assert not any(secrets.base_spans(t) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if "[SECRET]" not in after[i])
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    lengths, e = defaultdict(int), encoder(vocabulary("byte_bpe_50k.json"))
    for r in packed:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(e.encode(t)) // 4 + 1 for i, t in before.items()}


def shingles(text: str) -> Counter:
    """Runs of five words, or all of fewer."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def test_run_against_plain_python(spark):
    """All stages after the classifier, done by hand on all documents: the same pieces, with the ids that the tokenizers library gives."""
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "secrets", "packing"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    field = line_crf.fitted(docs, spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "quality"))
    kept = {r.doc_id: r.text for r in docs.collect() if field.score([r.text])[0] >= 0.5}
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    first: dict = {}
    for i, t in kept.items():
        first[bare(t)] = min(first.get(bare(t), (0, 1 << 62)), (-len(t), i))
    kept = {i: kept[i] for _, i in first.values()}
    bags, least = {i: shingles(t) for i, t in kept.items()}, {i: i for i in kept}
    pairs = [(i, j) for i, j in itertools.combinations(sorted(kept), 2) if bags[i] and 5 * (bags[i] & bags[j]).total() >= 4 * (bags[i] | bags[j]).total()]
    for _ in kept:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    kept = {i: t for i, t in kept.items() if least[i] == i}
    # The secrets' models learn from what the stage is given.
    given = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    model = secrets.train(secrets.sample_texts(given))
    for i, t in kept.items():
        spans, done = sorted((a, b) for a, _, b in [*secrets.base_spans(t), *model.spans(t, secrets.base_spans(t))]), []
        for a, b in spans:
            if done and a < done[-1][1]:
                done[-1][1] = max(done[-1][1], b)
            else:
                done.append([a, b])
        for a, b in reversed(done):
            kept[i] = kept[i][:a] + "[SECRET]" + kept[i][b:]
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in kept.items()}
    found, bins = defaultdict(dict), defaultdict(list)
    for r in corpus_pipeline.run(spark, D).collect():
        found[r.doc_id][r.piece] = (r.start, r.length)
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(kept) < docs.count() and found.keys() == ids.keys()
    for i, own in found.items():
        at = 0
        for k in range(len(own)):
            assert own[k][0] == at and (len(own) == 1 or own[k][1] == 2048 or k == 0)
            at += own[k][1]
        assert at == len(ids[i])
    for own in bins.values():
        assert [a for a, _ in sorted(own)] == [0, *itertools.accumulate(n for _, n in sorted(own))][:-1] and sum(n for _, n in own) <= 2048
    assert len(bins) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, an empty table, and columns called as the stages call theirs."""
    good = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{D}/labels.parquet")
    fine = [t for i, t in sorted(good.items()) if len(t) > 1_500][:6]
    schema = "doc_id long, text string, lang string, own_raw long, gone_id string, quality_score string, raw map<string,int>, kept int, n_chars long"
    rows = [(1, fine[0], "en"), (2, fine[0].replace(" ", "  "), "fr"), (3, fine[1] + " one word more", "en"), (4, fine[1], "en"), (5, fine[2] + "\npassword=hunter22x", None), (6, "", "en"), (7, None, "en"), (None, fine[3], "en"), (None, None, None), (8, " ".join(fine * 40), "en"), (9, fine[4], "en"), (9, fine[4], "en"), (2**60 + 1, fine[5], "en")]
    docs = spark.createDataFrame([(i, t, lang, 7, "g", "q", {"a": 1}, 3, len(t or "")) for i, t, lang in rows], schema).repartition(3)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (before, before.where("false")):
            out = written(stage(spark, given, str(tmp_path)), "test")
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.count() == 0
        before = written(stage(spark, before, str(tmp_path)), "test")
        kept[name] = before.collect()
    assert len(kept["quality"]) <= len(rows)
    assert all(r.own_raw == 7 and r.gone_id == "g" and r.quality_score == "q" and r.raw == {"a": 1} for r in kept["secrets"])
    # Scores decide alone in quality; the other stages do as they say with what it kept.
    ids = lambda name: sorted(str(r.doc_id) for r in kept[name])
    assert {"1", "2", "3", "4"} <= set(ids("quality"))
    assert "1" not in ids("exact") and "2" in ids("exact") and {"3", "4"} <= set(ids("exact"))
    assert "4" not in ids("near") and "3" in ids("near")
    assert ids("near").count("9") <= 1 and ids("secrets") == ids("near")
    assert all("hunter22x" not in (r.text or "") and (r.text is None or r.n_chars == len(r.text)) for r in kept["secrets"])
    packed = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    e = encoder(vocabulary("byte_bpe_50k.json"))
    lengths = defaultdict(int)
    for r in packed:
        lengths[r.doc_id] += r.length
    want = defaultdict(int)
    for r in kept["secrets"]:
        want[r.doc_id] += len(e.encode(r.text or "")) // 4 + 1
    assert lengths == want and corpus_pipeline.STAGES[-1][1](spark, before.where("false"), str(tmp_path)).collect() == []
    assert str(2**60 + 1) in ids("quality")
