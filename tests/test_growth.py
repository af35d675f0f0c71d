"""Steps whose cost must stay in proportion to their input: same results by the short way as by the long one, and plans without shuffles."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


WORDS = "the The THE a A E iron Iron IRON cm K Ca NaCl O2 TiO2 Fe2O3 IV Si(111) Fe(II) 5V 12 12.5(3) 1,000 ( ) 〈 〉 - . “ × é École naïve ø Ø x1 Heat H2O".split()


def test_processed_pairs_are_those_of_two_passes(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, [rng.choice(WORDS) for _ in range(rng.randrange(12))]) for i in range(300)] + [(300, WORDS), (301, None)], "id long, t array<string>")
    t = F.col("t")
    got = rows.select("id", tx.processed_pairs(t).alias("p"), tx.process(t)["tokens"].alias("tok"), tx.process(t, convert_num=False)["tokens"].alias("raw"), tx.processed_tokens(t).alias("own")).collect()
    for r in got:
        assert r.tok == r.own and (r.p is None if r.tok is None else [tuple(x) for x in r.p] == list(zip(r.tok, r.raw)))


def test_rules_of_process(spark):
    row = spark.createDataFrame([(WORDS,)], "t array<string>").select(tx.process(F.col("t")).alias("p"), tx.process(F.col("t"), exclude_punct=True)["tokens"].alias("q")).first()
    want = "the the THE a A e iron iron IRON cm K Ca ClNa O O2Ti Fe2O3 IV Si(111) Fe(II) 5V <nUm> <nUm> <nUm> ( ) 〈 〉 - . “ × é ecole naive ø ø x1 heat H2O".split()
    assert row.p.tokens == want and row.q == [w for w in want if w not in ("(", ")", "-", ".", "“", "×")]
    assert [m.surface for m in row.p.materials] == ["iron", "Iron", "NaCl", "O2", "TiO2", "Fe2O3", "H2O"]


def random_tagged(spark, n=120):
    """Token rows of documents with tags at random: I after O, at starts and over sentence ends; empty sentences."""
    rng, rows = random.Random(5), []
    for doc in range(n):
        for sent in range(rng.randrange(5)):
            for pos in range(rng.randrange(7)):
                tag = rng.choice(["O", "O", "B-MAT", "I-MAT", "I-PRO", "B-PRO"])
                rows.append((doc, sent, pos, f"w{rng.randrange(9)}", tag))
    return rows, spark.createDataFrame(rows, "doc_id long, sent_id int, pos int, tok string, tag string")


def by_hand(rows, compat):
    """Entities as sentences (or documents) are read from the left."""
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[0] if compat else r[:2], []).append(r)
    for own in groups.values():
        held = []
        for d, s, p, t, g in own:
            if g[0] == "I" and held:
                held.append((d, s, p, t, g))
                continue
            out.append(held)
            held = [(d, s, p, t, g)] if g[0] == "B" else []
            if not held:
                out.append([(d, s, p, t, g)])
        if not compat:
            out.append(held)
    return sorted((e[0][0], e[-1][1], e[0][2], " ".join(x[3] for x in e), e[0][4][-3:]) for e in out if e)


@pytest.mark.parametrize("compat", [False, True])
def test_entities_by_all_ways(spark, compat):
    from assaykit.operators import iob

    rows, df = random_tagged(spark)
    want = by_hand(rows, compat)
    assert sorted(map(tuple, iob.concatenate(df, compat).collect())) == want
    sent = df.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "tag"))).alias("t"))
    each = sent.select("doc_id", "sent_id", F.col("t.tok").alias("tokens"), F.col("t.tag").alias("tags"))
    if compat:
        order = F.array_sort(F.collect_list(F.struct("sent_id", "tokens", "tags")))
        docs = each.groupBy("doc_id").agg(order.alias("s"))
        lengths = F.transform(F.sequence(F.lit(0), F.array_max("s.sent_id")), lambda i: F.aggregate("s", F.lit(0), lambda n, x: n + F.when(x["sent_id"] == i, F.size(x["tokens"])).otherwise(0)))
        each = docs.select("doc_id", lengths.alias("lengths"), F.flatten("s.tokens").alias("tokens"), F.flatten("s.tags").alias("tags"))
    got = iob.concatenate_rows(each, compat)
    assert sorted(map(tuple, got.collect())) == want


def test_arrays_of_a_long_sentence_are_linear(spark):
    from assaykit.operators import iob

    def seconds(n):
        row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("t"))
        tags = F.transform("t", lambda t, i: F.when(i % 3 == 0, "B-MAT").when(i % 3 == 1, "I-MAT").otherwise("O"))
        began = datetime.datetime.now()
        assert row.select(F.size(iob.concatenate_array(F.col("t"), tags))).first()[0] == 2 * n // 3
        return (datetime.datetime.now() - began).total_seconds()

    seconds(300)
    assert seconds(120_000) < 20  # the fold copied what it had at every token: minutes


@pytest.mark.parametrize("name", ["entities_concatenated", "entities_concatenated_compat", "summary_documents"])
def test_entities_need_no_shuffle(spark, name):
    assert "Exchange" not in plan(catalogue.QUERIES[name](spark, DATA))


def test_scores_of_sentences_equal_those_of_tokens(spark):
    from assaykit.operators import evaluate

    rng = random.Random(8)
    tags = ["O", "B-MAT", "I-MAT", "I-PRO", "B-PRO", "I-DSC"]
    sents = [(i, [rng.choice(tags) for _ in range(k)], [rng.choice(tags) for _ in range(k)]) for i in range(200) for k in [rng.randrange(9)]]
    df = spark.createDataFrame(sents, "doc_id long, gold array<string>, predicted array<string>")
    side = lambda c: df.select("doc_id", F.lit(0).alias("sent_id"), F.posexplode(c).alias("pos", "tag"))
    assert evaluate.sentence_scores(df).collect() == evaluate.chunk_scores(side("gold"), side("predicted")).collect()
    assert sorted(evaluate.sentence_scores_by_type(df).collect()) == sorted(evaluate.chunk_scores_by_type(side("gold"), side("predicted")).collect())
    assert plan(evaluate.sentence_scores(df)).count("Exchange hashpartitioning") <= 1


def test_stream_tags_equal_those_of_a_column(spark):
    from assaykit.operators.iob import concatenate_array
    from assaykit.streaming import entities

    gaz, rng = {"a": "DSC", "b": "DSC", "c": "MAT"}, random.Random(2)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9)))) for i in range(200)], "doc_id long, text string")
    words = F.split("text", " ")
    want = df.select("doc_id", F.explode(concatenate_array(words, entities.gazetteer_column(words, gaz))).alias("e")).select("doc_id", "e.*").where("type <> 'O'")
    assert sorted(entities.entity_stream(df, gaz).collect()) == sorted(want.collect())


def test_mention_counts_are_a_rollup(spark):
    from assaykit.operators import iob

    e = spark.createDataFrame([(1, "MAT", "x"), (2, "MAT", "x"), (2, "PRO", "y"), (3, "O", "z")], "doc_id long, type string, entity string")
    same = lambda df: sorted(map(str, df.select("type", "entity", "mentions").collect()))
    assert same(iob.mention_counts(e)) == same(iob.mention_rollup(e))
    assert same(iob.mention_counts(e.limit(0))) == same(iob.mention_rollup(e.limit(0)))


def test_entities_of_a_gazetteer_are_those_of_its_tokens(spark):
    from assaykit.operators import iob
    from assaykit.plans.ner import Tagger

    docs = spark.createDataFrame([(1, "The iron (Fe) in a der die der. 12 der 13"), (2, "der\nder"), (3, "nothing"), (4, None)], "doc_id long, text string").where("text IS NOT NULL")
    t = Tagger(gazetteer=spark.createDataFrame([("der", "MAT"), ("die", "MAT"), ("<nUm>", "PVL"), ("a", "APL"), ("a", "DSC")], "tok string, type string"))
    got = t.as_concatenated(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, iob.concatenate(t.as_iob(docs)).select("doc_id", "sent_id", "ent_pos", "entity", "type").collect()))
    assert "Exchange" not in plan(got)  # tokens were shuffled by word and by sentence


def test_training_reads_texts_once(spark):
    from assaykit.operators import relevance

    text = [(f"good iron w{i}", 1) if i % 2 else (f"bad tin w{i}", 0) for i in range(20)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    relevance.train(spark.createDataFrame(text, "text string, label int").coalesce(1).mapInArrow(count, "text string, label int"))
    assert seen.value == 20


def test_shards_learn_as_sentence_by_sentence():
    import numpy as np
    import pyarrow as pa

    from assaykit.operators import tagger as tg

    rng = random.Random(4)
    words = ["the", "The", "der", "of", "Fe2O3", "12", "x", "é", "la"]
    sents = [[rng.choice(words) for _ in range(rng.randrange(1, 12))] for _ in range(300)]
    gold = [[("B-MAT" if w == "der" else "I-MAT" if i and s[i - 1] == "der" else "O") for i, w in enumerate(s)] for s in sents]
    tags, n = ("B-MAT", "I-MAT", "O"), 3
    model = tg.TagModel(tags, np.zeros((tg._FEATURES, n), np.float32), np.zeros((n, n)), np.zeros(n), np.zeros(n))
    lengths = np.array([len(s) for s in sents])
    f = tg.feature_table(pa.array([w for s in sents for w in s]), lengths)
    assert f.tolist() == [x for s in sents for x in tg.features(s)]
    shard = tg._Shard(model, 0.9)
    shard.learn(f, np.array([tags.index(t) for g in gold for t in g]), lengths)
    w, m, a, z = model.weights.copy(), model.moves.copy(), model.start.copy(), model.stop.copy()
    for s, g in zip(sents, gold):
        x = tg.features(s)
        got, _ = tg.viterbi(np.array([w[y].sum(0) for y in x]), m, a, z)
        want = [tags.index(t) for t in g]
        if got != want:
            for y, p, q in zip(x, want, got):
                if p != q:
                    w[y, p] += 0.9
                    w[y, q] -= 0.9
            for path, sign in ((want, 0.9), (got, -0.9)):
                a[path[0]] += sign
                z[path[-1]] += sign
                for p, q in zip(path, path[1:]):
                    m[p, q] += sign
    learned = tg.TagModel(tags, w, m, a, z)
    assert np.array_equal(shard.w, w) and np.allclose(shard.m, m) and np.array_equal(shard.s, a) and np.array_equal(shard.e, z)
    batch = pa.array([*sents, [], None], pa.list_(pa.string()))
    assert learned.tag_all(batch).to_pylist() == [*(learned.tag(s) for s in sents), [], []]


@pytest.mark.parametrize("compat", [False, True])
def test_conll_by_file_equals_conll_by_line(spark, compat):
    from assaykit.sources import formats

    rng = random.Random(6)
    files = [(f"f{i}", [rng.choice(["a O", "b  x B-MAT", " c I-MAT ", "", "  ", "-DOCSTART- O"]) for _ in range(rng.randrange(9))]) for i in range(150)]
    whole = spark.createDataFrame(files, "file string, lines array<string>")
    by_line = formats.parse_conll(whole.select("file", F.posexplode("lines").alias("at", "line")), compat=compat)
    assert sorted(map(tuple, formats.parse_conll_files(whole, compat).collect())) == sorted(map(tuple, by_line.collect()))
    made = plan(by_line).split("Initial Plan")[0]
    assert made.count("Exchange") == 1 and made.count(" Sort [") == 1  # several sorts of all lines before


def test_rows_of_one_id_are_one_file(spark, tmp_path):
    spark.createDataFrame([(1, "a b\n\nc"), (1, "d\ne"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = catalogue.conll_round_trip(spark, str(tmp_path)).collect()
    assert [(x.file, x.n_tokens, x.n_sentences) for x in r] == [("1", 5, 3)]


def test_character_ids_need_no_shuffle(spark):
    from assaykit.operators import tokens as tk

    words = spark.createDataFrame([(1, 0, 0, "aé😀z"), (1, 0, 1, ""), (1, 0, 2, "zz?"), (1, 0, 3, None)], "doc_id long, sent_id int, pos int, tok string")
    chars = spark.createDataFrame([("a", 3), ("z", 0), ("😀", 7), ("é", 1 << 40)], "ch string, idx long")
    got = tk.encode_characters(words, chars)
    assert [r.char_ids for r in got.orderBy("pos").collect()] == [[3, 1 << 40, 7, 0], [], [0, 0], []] and "Exchange" not in plan(got)
    assert [r.char_ids for r in tk.encode_characters(words, chars.limit(0)).collect()] == [[]] * 4


def test_rows_of_part_are_spread(spark, tmp_path):
    from assaykit.plans import inputs

    spark.range(25_000).selectExpr("id AS p_partkey", "1 + id % 50 AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("names_to_formulas", "variable_values"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 3
    assert inputs.materials(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_weights_are_made_once(spark):
    from assaykit.operators import relevance

    p = plan(relevance.tf_idf(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "c")], "doc_id long, tok string")))
    assert "Window" in p and p.count("Join") == 1  # the length was joined to weights made again


def test_phrases_are_merged_from_the_left(spark):
    rng = random.Random(9)
    found = ["a_b", "b_a", "a_a", "a_b_c", "c_c_c_c", "b_c"]
    rows = [[rng.choice("abc") for _ in range(rng.randrange(10))] for _ in range(300)]

    def once(ts):
        out, held = [], None
        for t in ts:
            if held is not None and f"{held}_{t}" in found:
                out.append(f"{held}_{t}")
                held = None
            else:
                out += [held] if held is not None else []
                held = t
        return out + ([held] if held is not None else [])

    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, t array<string>")
    got = df.orderBy("id").select(tx.merge_phrases(F.col("t"), F.lit(found)).alias("m")).collect()
    assert [r.m for r in got] == [once(once(r)) for r in rows]


def test_merging_a_long_sentence_is_linear(spark):
    n = 120_000
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), (i % 7).cast("string"))).alias("t"))
    began = datetime.datetime.now()
    assert row.select(F.size(tx.merge_phrases(F.col("t"), F.lit(["w1_w2", "w2_w3"])))).first()[0] > n // 2
    assert (datetime.datetime.now() - began).total_seconds() < 20  # the fold copied what it had at every token
