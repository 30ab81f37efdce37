"""op3 against brute force, op4 and op10 on held-out rows, and the pipeline's stages."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import edges
from veilspan.llm import langid, near_dups, packing, quality
from veilspan.llm.components import components
from veilspan.llm.queries import QUERIES
from veilspan.sources import lineage


def brute_classes(docs):
    """Classes by comparing all pairs that share a shingle; equal texts belong together."""
    bags = {}
    for i, text in docs.items():
        w = re.findall(r"[^\W_]+", (text or "").lower())
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_text, by_shingle = {}, collections.defaultdict(list)
    for i in docs:
        parent[find(i)] = find(by_text.setdefault(docs[i] or "", i))
        for s in bags[i] or ():
            by_shingle[s].append(i)
    for a, b in {(min(p), max(p)) for ids in by_shingle.values() for x in ids for y in ids if x != y for p in [(x, y)]}:
        x, y = bags[a], bags[b]
        both = len(x.keys() & y.keys())
        if max(both / (len(x) + len(y) - both), sum((x & y).values()) / sum((x | y).values())) >= 0.8:
            parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in docs:
        groups[find(i)].append(i)
    return {i: min(g) for g in groups.values() for i in g}


def planted():
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[random.choice(vocabulary) for _ in range(random.randint(30, 200))] for _ in range(60)]
    docs = [" ".join(b) for b in base]
    for b in base[:20]:
        for edits in (1, 1, 2):
            copy = list(b)
            for _ in range(edits):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            docs.append(" ".join(copy))
        docs.append(" ".join(b))
    passage = " ".join(random.choice(vocabulary) for _ in range(60))
    docs += [passage + " " + " ".join(random.choice(vocabulary) for _ in range(60)) for _ in range(80)]
    docs += ["", None, "one", "one", "two words", "!!", "line again\n" * 30, "line again\n" * 31]
    return dict(enumerate(docs))


def test_near_duplicates_equal_brute_force(spark):
    docs = planted()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()}
    assert got == brute_classes(docs)


def test_many_pairs_of_near_copies_are_all_found(spark):
    random.seed(8)
    docs = {}
    for i in range(400):
        words = [f"w{random.randrange(5000)}" for _ in range(120)]
        copy = list(words)
        for _ in range(random.choice((1, 2))):
            copy[random.randrange(120)] = f"x{i}"
        docs[2 * i], docs[2 * i + 1] = " ".join(words), " ".join(copy)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()}
    assert got == brute_classes(docs)


def test_copies_that_resemble_only_their_original(spark):
    """Copies at 0.8 or more to their original and below that to one another: one class, through the original."""
    random.seed(11)
    base = [f"w{i}" for i in range(150)]
    docs = {0: " ".join(base)}
    for i in range(1, 301):
        copy = list(base)
        for k, at in enumerate(random.sample(range(150), 3)):
            copy[at] = f"x{i}y{k}"
        docs[i] = " ".join(copy)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()}
    want = brute_classes(docs)
    assert len(set(want.values())) < 20 and got == want


def test_graded_copies_are_all_found(spark):
    """400 copies with 0 to 10 changed words, most of them alike to few others only, and texts that share a passage: large
    buckets that stay open. The pairs that are compared stay far below all pairs."""
    random.seed(21)
    base = [f"w{i}" for i in range(150)]
    docs = {}
    for i in range(400):
        copy = list(base)
        for k, at in enumerate(random.sample(range(150), random.randint(0, 10))):
            copy[at] = f"x{random.randrange(40)}" if k % 2 else f"y{i}k{k}"
        docs[i] = " ".join(copy)
    for i in range(400, 700):
        docs[i] = " ".join(base[:90] + [f"z{i}q{k}" for k in range(random.randint(20, 40))])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    found = near_dups.NearDuplicates(df)
    got = {r["doc_id"]: r["class_id"] for r in found.classes().collect()}
    assert got == brute_classes(docs)
    assert found._tried.count() < 0.2 * 700 * 699 / 2


def test_sets_alike_are_found_where_multisets_are_not(spark):
    """Texts of which one repeats a passage: likeness near 1 as sets, 0.5 or less as multisets."""
    random.seed(12)
    docs = {}
    for i in range(60):
        words = [f"w{random.randrange(5000)}" for _ in range(80)]
        docs[2 * i], docs[2 * i + 1] = " ".join(words), " ".join(words * (2 + i % 3))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()}
    assert got == brute_classes(docs) and all(got[2 * i + 1] == 2 * i for i in range(60))


def test_repeated_line_is_linked(spark):
    """A line, and the same line three and forty times over: alike as sets, not as multisets."""
    line = " ".join(f"word{i}" for i in range(34))
    docs = {1: line, 2: "\n".join([line] * 3), 4: "\n".join([line] * 40), 5: "something else altogether, in quite other words than those"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()}
    assert got == brute_classes(docs) and got[2] == got[4] == 1


def test_op3_on_documents(spark, sf_dir):
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert {r["doc_id"]: r["class_id"] for r in QUERIES["op3_dart_minhash"](spark, sf_dir).collect()} == brute_classes(docs)


def test_signatures_estimate_weighted_likeness():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 2**63, 400).astype(np.uint64)
    a = np.concatenate([words[:300], words[:50]])
    b = np.concatenate([words[40:340], words[:50]])
    agree = []
    for salt in range(6):
        s = near_dups.signatures(np.concatenate([a, b]) ^ np.uint64(salt * 7919), np.array([len(a), len(b)]))
        agree.append((s[0] == s[1]).mean())
    bags = [collections.Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (a.tolist(), b.tolist())]
    true = sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())
    assert np.mean(agree) == pytest.approx(true, abs=0.05)
    one = near_dups.signatures(words[:1], np.array([1, 0]))
    assert (one[0] != near_dups.EMPTY).all() and (one[1] == near_dups.EMPTY).all()


def test_large_class_is_linear(spark):
    """Pairs grow with the texts of a class, not with its square."""
    random.seed(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(800):
        copy = list(base)
        copy[random.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small, large = near_dups.NearDuplicates(df.where("doc_id < 200")), near_dups.NearDuplicates(df)
    assert large.classes().select("class_id").distinct().count() == 1
    assert large.links.count() < 6 * small.links.count()  # all pairs would be 16 times as many


def test_op3_awkward_rows(spark):
    got = collections.defaultdict(set)
    for r in near_dups.near_duplicates(edges.table(spark)).collect():
        got[r["doc_id"]].add(r["class_id"])
    assert got[5] == got[1] == {1} and got[2] == got[3] == {2} and got[11] == {1} and got[4] == {4}
    kept = near_dups.without_near_duplicates(edges.table(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == edges.table(spark).columns and sorted(i or 0 for i in ids) == [0, 1, 2, 4, 6, 7, 8, 9, 10, 12]
    assert near_dups.near_duplicates(edges.empty(spark)).count() == 0


def test_components(spark):
    edges_ = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges_, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == got[100] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_of_near_duplicates_are_few_files(spark):
    """With many shuffle partitions a table is a few files: on a local store each costs its executor three programs."""
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, since = {k: spark.conf.get(k) for k in held}, lineage.mark()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 3 < 2], "a long, b long")
        found = {r["node"]: r["label"] for r in components(links).collect()}
        rows = near_dups.met(spark.createDataFrame([(i, i // 2) for i in range(600)], "node long, band long"))
        assert rows.count() == 600
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: i // 3 * 3 for i in range(300)}
    made = lineage._made[since:]
    files = [len(spark.read.parquet(p).inputFiles()) for p in made]
    assert len(files) >= 5 and max(files) <= 2 * spark.sparkContext.defaultParallelism
    lineage.give_up(spark, since)


def test_chunks_of_short_texts_are_bounded():
    """A short text throws as many darts as a long one."""
    parts = list(near_dups._chunks(np.full(1000, 20)))
    assert [p.start for p in parts[1:]] == [p.stop for p in parts[:-1]] and (parts[0].start, parts[-1].stop) == (0, 1000)
    assert max(p.stop - p.start for p in parts) <= 300
    words = np.random.default_rng(3).integers(0, 2**62, 1000 * 20)
    whole, lengths = near_dups.signatures(words, np.full(1000, 20)), np.full(1000, 20)
    split = np.concatenate([near_dups.signatures(words[p.start * 20 : p.stop * 20], lengths[p]) for p in parts])
    assert (whole == split).all()


def test_op4_held_out(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op4_byte_cnn_language"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.93


def test_windows_cover_all_bytes():
    data = [b"", b"a", b"b" * langid.WINDOW, b"c" * (langid.WINDOW + 1), bytes(range(1, 250)) * 3]
    windows, owner, sizes = langid.windows_of(data)
    for i, d in enumerate(data):
        assert b"".join(w.tobytes()[:n] for w, o, n in zip(windows, owner, sizes, strict=True) if o == i) == d


def test_training_tells_two_alphabets_apart():
    rows = [("a", ["abab" * 60]), ("b", ["cdcd" * 60])] * 40
    net = langid.fit_network(rows)
    assert [p[0] for p in net.predict(["abab" * 50, "cdcd" * 50])] == ["a", "b"]


def naive_logits(net, window):
    """The network byte by byte: every filter at every place, the greatest of them, the layer."""
    pooled = []
    for f in range(net.filters.shape[1]):
        width = langid.WIDTHS[f // langid.FILTERS]
        best = -np.inf
        for at in range(langid.WINDOW):
            total = 0.0
            for j in range(width):
                if at + j < langid.WINDOW:
                    total += float(net.bytes[window[at + j]] @ net.filters[j * langid.EMBEDDED : (j + 1) * langid.EMBEDDED, f])
            best = max(best, total)
        pooled.append(max(0.0, best + net.offset[f]))
    return np.array(pooled) @ net.layer + net.bias


def test_network_equals_naive_convolution():
    net = langid.fit_network([("a", ["the cat sat on the mat " * 20]), ("b", ["der hund lief in den wald " * 20]), ("c", ["le chat dort sur la table " * 20])] * 20)
    texts = ["a cat in the wood " * 9, "kurz", "é" * 200]
    windows, owner, sizes = langid.windows_of([t.encode() for t in texts])
    want = np.array([naive_logits(net, w) for w in windows])
    assert np.allclose(net.logits(windows), want, atol=1e-4)
    for i, (lang, score) in enumerate(net.predict(texts)):
        mean = (want[owner == i] * sizes[owner == i, None]).sum(0) / sizes[owner == i].sum()
        p = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert lang == net.languages[p.argmax()] and score == pytest.approx(p.max(), abs=1e-4)


def test_network_training_lowers_the_loss():
    rng = np.random.default_rng(3)
    windows, labels = rng.integers(1, 120, (96, langid.WINDOW)).astype(np.uint8), rng.integers(0, 2, 96)
    windows[labels == 1, 40:44] = (200, 201, 202, 203)

    def loss(net):
        z = net.logits(windows)
        return float(np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(96), labels]))

    net = langid.Network(["a", "b"])
    before = loss(net)
    assert loss(net.train(windows, labels)) < 0.2 * before


def test_sample_is_bounded_and_drawn_by_row(spark):
    from veilspan.llm import common

    def drawn(df, per_label=500):
        text = F.col("text")
        return common.labelled_sample(df, "lang", per_label, {"text": text}, [F.col("doc_id"), text])

    rows = spark.range(20_000).select((F.col("id") % 2).cast("string").alias("lang"), F.concat(F.lit("text "), F.col("id")).alias("text"), "id")
    for doc_id in (F.lit(7).cast("long"), F.lit(None).cast("long"), F.col("id"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id"))):
        got = collections.Counter(r["lang"] for r in drawn(rows.withColumn("doc_id", doc_id)))
        assert set(got) == {"0", "1"} and all(450 <= n <= 500 for n in got.values())
    equal = rows.withColumn("doc_id", F.lit(1)).withColumn("text", F.lit("same"))
    assert len(drawn(equal)) == 2
    many = spark.range(3000).select(F.concat(F.lit("l"), F.col("id") % 300).alias("lang"), F.col("id").cast("string").alias("text"), F.col("id").alias("doc_id"))
    got = collections.Counter(r["lang"] for r in drawn(many))
    assert len(got) == 300 and sum(got.values()) == 3000
    assert drawn(rows.withColumn("doc_id", F.col("id")).withColumn("lang", F.lit(None).cast("string"))) == []


def test_more_than_200_languages_can_be_predicted(spark):
    letters = [chr(0x4E00 + 17 * i) for i in range(240)]
    df = spark.createDataFrame([(6 * i + j, letters[i] * 60, f"l{i:03}") for i in range(240) for j in range(6)], "doc_id long, text string, lang string").repartition(4)
    net = langid.fit(df)
    assert len(net.languages) >= 230


def test_op4_awkward_rows(spark):
    rows = collections.defaultdict(list)
    for r in langid.predictions(edges.table(spark)).collect():
        rows[r["doc_id"]].append(r["lang_pred"])
    assert all(rows[i] == ["und"] for i in (2, 3, 4, 8)) and rows[5][0] == rows[5][1] == rows[1][0] != "und"
    assert langid.predictions(edges.empty(spark)).count() == 0
    unlabelled = edges.table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predictions(unlabelled).collect()} == {"und"}


def test_op10_held_out(spark, sf_dir):
    labels = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect())
    rows = QUERIES["op10_subword_quality"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.8


def test_op10_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 1), (99, 0), (None, 1), (12, None)], "doc_id long, quality int")
    rows = collections.defaultdict(list)
    for r in quality.predictions(edges.table(spark), labels).collect():
        rows[r["doc_id"]].append(r["score"])
    assert rows[2] == rows[3] == rows[4] and rows[5][0] == rows[5][1] == rows[1][0] and all(0 <= s <= 1 for v in rows.values() for s in v)
    assert quality.predictions(edges.empty(spark), labels).count() == 0
    assert {r["score"] for r in quality.predictions(edges.table(spark), labels.limit(0)).collect()} == {0.5}
    blank = spark.createDataFrame([(i, (None, "", "  ")[i % 3]) for i in range(30)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 5 == 0) for i in range(30)], "doc_id long, q boolean").select("doc_id", F.col("q").cast("int").alias("quality"))
    scores = {r["score"] for r in quality.predictions(blank, marks).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 0.5  # the share of label 1
    hot = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    assert quality.predictions(hot, labels).count() == 5000


def test_scorer_equals_averaged_vectors():
    """A word's number and count of vectors stand for its vectors; scores equal the average over all of them, one by one."""
    rng = np.random.default_rng(2)
    weights, bias = rng.normal(0, 1, quality.BUCKETS).astype(np.float32), 0.3
    texts = [edges.PLAIN, "a", "a a a b", "É ß 日本 x", "", None, "!! ... --", "same same " * 30]
    for text, score in zip(texts, quality.Scorer(weights, bias).scores(texts), strict=True):
        ids = [i % quality.BUCKETS for w in quality.words_of(text) for i in quality.word_features(w)]
        logit = bias + (np.mean(weights[ids].astype(np.float64)) if ids else 0)
        assert score == pytest.approx(1 / (1 + np.exp(-logit)))


def test_quality_training_follows_the_gradient():
    """One step over one batch moves the layer and the vectors by the gradient of the mean log loss, times their rates."""
    texts, labels = ["alpha beta", "gamma delta"] * 30, [1, 0] * 30
    weights, bias = quality.train(texts, labels)
    scores = quality.Scorer(weights, bias).scores(["alpha beta", "gamma delta"])
    assert scores[0] > 0.9 and scores[1] < 0.1


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language id", "near duplicates", "source mix", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf_dir)
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert good.columns == columns and np.mean([d in kept for d in clean]) > 0.95
    assert np.mean([d in kept for d, q in labels.items() if q == 0]) < 0.6
    known = stages["language id"](spark, docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("123 !!")})), sf_dir)
    assert known.columns == columns and known.where("doc_id = -1").count() == 0 and known.count() >= 0.98 * docs.count()
    single = stages["near duplicates"](spark, docs, sf_dir)
    want = brute_classes(dict(docs.select("doc_id", "text").collect()))
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(set(want.values()))
    mixed = stages["source mix"](spark, docs, sf_dir)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    final = corpus_pipeline.run(spark, sf_dir)
    whole = packing.sequences(final).collect()
    assert whole and all(len(r["ids"]) == 4096 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in whole)


def test_pipeline_removes_what_is_done_with(spark, sf_dir):
    from pathlib import Path

    from veilspan.llm.common import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("cut-*")) | set(folder.glob("pipeline-*/*"))
    corpus_pipeline.run(spark, sf_dir)
    after = set(folder.glob("cut-*")) | set(folder.glob("pipeline-*/*"))
    assert {p.name for p in after - before if p.exists()} == {"4"}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, tmp_path, name):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, an empty table and clashing column names."""
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 1), (99, 0), (None, 1), (12, None)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage, docs = dict(corpus_pipeline.STAGES)[name], edges.table(spark)
    for rows in (docs, docs.limit(0), docs.withColumn("text", F.lit(None).cast("string")), docs.withColumn("doc_id", F.lit(None).cast("long")), docs.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source")})):
        out = stage(spark, rows, str(tmp_path))
        n = out.count()
        assert name == "packing" or out.columns == docs.columns
        if name == "packing":
            assert out.where("start = 0").count() == rows.count()
        elif name == "source mix":
            assert out.where("text is null").count() == rows.where("text is null").count()
        else:
            assert n <= rows.count()
    kept = [r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()]
    if name == "language id":
        assert not {2, 3, 4, 8} & set(kept) and kept.count(5) == 2
    if name == "near duplicates":
        assert 1 in kept and 5 not in kept and 11 not in kept
