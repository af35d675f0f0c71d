"""The pipeline's stages, each on the output of the one before, against what they promise."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assaykit.llm import decontaminate, quality, simhash, tokens, toxicity, vectorpack
from assaykit.llm.common import tidy
from assaykit.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    first = docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas(), first.schema)
        assert docs.columns == columns
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:])) and len(seen[-1]) < first.count()  # 87 labels are too few for toxic seeds
    fp = np.array([r.fp for r in simhash.fingerprints(spark.createDataFrame([(r.doc_id, r.text) for r in first.collect() if r.doc_id in seen[2]], "doc_id long, text string")).collect()]).view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 6
    assert near.sum() == len(fp)  # nothing that stays is near another
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.report(docs, bench).where("n_hit > 0").count() == 0
    judged = quality.judge(first.join(spark.createDataFrame([(i,) for i in seen[0]], "doc_id long"), "doc_id"), quality.references(first))
    assert judged.where("kept AND base_failed").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == seen[3]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: toxic and clean texts, copies, near copies, junk, benchmark passages, nulls, repeated rows."""
    rng = np.random.default_rng(20)
    plain = ["".join(rng.choice(list("abcdefghilmnoprstu"), int(rng.integers(3, 9)))) for _ in range(300)]
    common = ["the", "of", "and", "to"]
    items = [" ".join(rng.choice(plain, 30)) for _ in range(6)]
    docs, labels = [], []
    for i in range(420):
        ws = [str(w) for w in rng.choice(common + plain, 80, p=[0.08] * 4 + [0.68 / 300] * 300)]
        toxic = i % 6 == 0
        for _ in range(5 if toxic else 0):
            ws[int(rng.integers(80))] = str(rng.choice(["vileword", "nastyword"]))
        if i % 10 == 1:
            at = int(rng.integers(60))
            ws[at:at] = items[i % 6].split()[:12]
        docs.append((i, ". ".join(" ".join(ws[k : k + 8]) for k in range(0, len(ws), 8)) + ".", "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[7][1], "en", "s", 0) for i in range(40)]  # copies of a clean text
    docs += [(1100 + i, docs[13][1].replace(" the ", " a ", 1), "en", "t", 0) for i in range(3)]
    docs += [(1200, "### %%% " * 200, "en", "s", 0), (1201, items[0], "en", "s", 0), (1202, None, None, None, None), (1203, "", "en", "s", 0), (1204, "short text", "en", "s", 0)]
    docs += [(1205, " ".join(docs[k][1] for k in range(2, 400) if k % 6) * 3, "en", "s", 0), docs[20], docs[20], (None, docs[21][1] + " and more of it", "en", "s", 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def brute_stages(docs, spark, folder):
    """The ids and texts after each stage but the last, by plain Python over lists of (doc_id, text, lang)."""
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    lex = toxicity.fit(frame, labels.where("pmod(crc32(string(doc_id)), 4) <> 2"))

    def score(t):
        e = sum(lex.weights.get(w, 0.0) for w in toxicity.terms((t or "").encode(), toxicity.Params()))
        return lex.probability[min(399, int(e / 0.25))]

    docs = [d for d in docs if score(d[1]) < 0.3]
    yield docs
    refs = quality.references(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    kept = []
    for d in docs:
        t = d[1] or ""
        ws = t.split()
        grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        twice = {k for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for k in range(i, i + 8)}
        if len(ws) < 20 or 100 * len(twice) > 30 * len(ws):
            continue
        chars, words = np.zeros(len(quality.CLASSES)), np.zeros(len(refs.column) + 1)
        for b in t.encode():
            if (k := quality._CLASS[b]) < len(chars):
                chars[k] += 1
        for w in ws:
            words[refs.column.get(w.lower().encode(), len(refs.column))] += 1
        cd, wd = (min(quality.distance(x / x.sum(), q) for q in r) for x, r in ((chars, refs.chars), (words, refs.words)))
        if not (chars.sum() >= 200 and cd > 0.32 or len(ws) >= 50 and wd > 0.43):
            kept.append(d)
    yield kept
    fp = simhash.fingerprint_many([(t or "").encode() for _, t, _ in kept])
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 6
    label = np.arange(len(kept))
    while (new := np.array([label[r].min() for r in near])).tolist() != label.tolist():
        label = new
    left = []
    for k in set(label.tolist()):
        group = [kept[i] for i in np.flatnonzero(label == k)]
        left.append(min(group, key=lambda d: (d[0] is None, d[0] or 0, d[1])))
    yield left
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    wins = {tuple(w[i : i + 8]) for t in items for w in [t.lower().split()] for i in range(len(w) - 7)}
    out = []
    for i, t, lang in left:
        spans = [(m.start(), m.end()) for m in re.finditer(r"[a-z0-9]+", t.lower())]
        ws = [t[a:b].lower() for a, b in spans]
        hit = {k for j in range(len(ws) - 7) if tuple(ws[j : j + 8]) in wins for k in range(j, j + 8)}
        if 2 * len(hit) <= len(ws):
            out.append((i, [w for k, w in enumerate(ws) if k not in hit], lang))
    yield out


def words_of(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def test_run_equals_brute_force(spark, corpus):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{corpus}/documents.parquet")
    want = list(brute_stages([(r.doc_id, r.text, r.lang) for r in table.collect()], spark, corpus))
    docs, texts = table, {}
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        rows = stage(spark, docs, corpus).collect()
        if name != "benchmark decontamination":
            assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t, _ in expected), name
        else:
            assert sorted((str(r.doc_id), words_of(r.text)) for r in rows) == sorted((str(i), ws) for i, ws, _ in expected)
            texts = {r.doc_id: r.text for r in rows}
        docs = spark.createDataFrame(rows, table.schema)
    sizes = [table.count(), *map(len, want)]
    assert all(a > b for a, b in zip(sizes, sizes[1:])), sizes  # every stage rejects something
    t = Tokenizer.from_file(vectorpack.Params().tokenizer)
    by_doc, by_sequence = {}, {}
    for r in corpus_pipeline.run(spark, corpus).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) <= 2048


def test_stages_take_any_rows(spark, corpus):
    """Empty tables, and extra columns with names that stages use inside, which are handed on."""
    table = spark.read.parquet(f"{corpus}/documents.parquet")
    extra = table.where("doc_id > 1190 OR doc_id < 60 OR doc_id IS NULL").withColumns({"fp": F.lit("x"), "_text": F.lit(1), "score": F.lit(2.0), "_row": F.lit(3), "n_words": F.lit(4), "toxic": F.lit("t"), "key": F.lit(5), "_rank": F.lit(6)})
    none = table.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, extra, corpus)
        assert got.columns == extra.columns, name
        rows = got.collect()
        assert rows and all((r.fp, r["_text"], r.score, r["_row"], r.toxic, r["_rank"]) == ("x", 1, 2.0, 3, "t", 6) for r in rows), name
        assert stage(spark, none, corpus).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, corpus).count() == 0 and corpus_pipeline.STAGES[-1][1](spark, extra, corpus).count() >= extra.count()


def test_of_rows_that_repeat_an_id_the_least_stays(spark):
    text = "one two three four five six seven"
    d = spark.createDataFrame([(1, text, "b"), (1, text, "a"), (1, "other words are here", "z"), (2, text, "a")], "doc_id long, text string, source string")
    assert [tuple(r) for r in simhash.dedup(d).collect()] == [(1, text, "a")]


def test_every_operator_has_a_query():
    names = queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(oracle_sql()) <= set(names)


def test_stages_bound_what_workers_hold(spark, corpus):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, "iron oxide " * 50_000) for i in range(40)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    def most():
        return max(r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect())

    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        assert most() > 2 * corpus_pipeline.BATCH_BYTES
        cut = corpus_pipeline.drop_benchmark_passages(spark, docs, corpus)
        assert most() < 1.5 * corpus_pipeline.BATCH_BYTES
        # one pass, so one worker, for each automaton
        assert cut._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        spark.conf.set(key, "9m")
        corpus_pipeline.drop_benchmark_passages(spark, docs, corpus)
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_other_stages_forget_the_words_of_the_tokenizer():
    held = tokens.word_bpe(tokens.path("word_bpe_49k.json"))
    assert tokens.word_bpe.cache_info().currsize
    list(tidy(iter, tokenizes=True)(iter([])))
    assert tokens.word_bpe(tokens.path("word_bpe_49k.json")) is held
    list(tidy(iter)(iter([])))
    assert not tokens.word_bpe.cache_info().currsize


def test_run_starts():
    x = np.array([0, 0, 3, 3, 3, 7])
    assert toxicity._run_starts(x).tolist() == [0, 2, 5] and not len(toxicity._run_starts(x[:0]))
