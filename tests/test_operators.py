"""Operators on small tables: tags, entities, normal forms, vectors, stores and sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import embed, entities, evaluate, iob, lookup, phrases, relevance, tagger
from assaykit.operators import tokens as tk
from assaykit.plans import registry
from assaykit.plans.ner import Tagger
from assaykit.sources import formats, writers


def tags(spark, sents):
    rows = [("d", s, p, f"t{s}{p}", t) for s, own in enumerate(sents) for p, t in enumerate(own)]
    return spark.createDataFrame(rows, "doc_id string, sent_id int, pos int, tok string, tag string")


def fold(sents, compat):
    """The concatenation rules, token by token."""
    out, held, last = [], None, len(sents) - 1
    for s, own in enumerate(sents):
        for p, t in enumerate(own):
            if t[0] == "I" and held:
                held[0].append(f"t{s}{p}")
                continue
            if held:
                out.append((held[3] if not compat else held[4], held[2], " ".join(held[0]), held[1]))
                held = None
            if t[0] == "B":
                held = [[f"t{s}{p}"], t[-3:], p, s, s]
            else:
                out.append((s, p, f"t{s}{p}", t if t == "O" else t[-3:]))
            if held:
                held[4] = s
        if held and not compat:
            out.append((held[3], held[2], " ".join(held[0]), held[1]))
            held = None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_concatenation_equals_a_fold(spark, seed):
    rng = np.random.default_rng(seed)
    sents = [[str(rng.choice(["O", "B-MAT", "I-MAT", "I-PRO", "B-PRO"])) for _ in range(rng.integers(1, 9))] for _ in range(6)]
    t = tags(spark, sents)
    got = sorted(tuple(r)[1:] for r in iob.concatenate(t).collect())
    assert got == sorted(fold(sents, False))
    arrays = t.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "tag"))).alias("x")).select("sent_id", iob.concatenate_array(F.col("x.tok"), F.col("x.tag")).alias("e"))
    assert sorted((r.sent_id, e.entity, e.type) for r in arrays.collect() for e in r.e) == sorted((s, e, k) for s, _, e, k in got)
    compat = sorted((r.entity, r.type) for r in iob.concatenate(t, compat=True).collect())
    assert compat == sorted((e, k) for _, _, e, k in fold(sents, True))


def test_chunks(spark):
    got = iob.chunks(tags(spark, [["B-PER", "I-PER", "O", "B-LOC"], ["I-LOC", "I-PER", "B-PER"]])).orderBy("sent_id", "start").collect()
    assert [tuple(r)[1:] for r in got] == [(0, "PER", 0, 2), (0, "LOC", 3, 4), (1, "LOC", 0, 1), (1, "PER", 1, 2), (1, "PER", 2, 3)]


def test_simplified_properties(spark):
    got = iob.simplify_properties(tags(spark, [["B-PRO", "B-PVL", "I-PUT", "O", "B-PUT", "B-PRO"]])).orderBy("pos").collect()
    assert [r.tag for r in got] == ["B-PRO", "I-PRO", "I-PRO", "O", "B-PRO", "B-PRO"]


def test_scores(spark):
    gold, pred = tags(spark, [["B-MAT", "I-MAT", "O", "B-PRO"]]), tags(spark, [["B-MAT", "I-MAT", "O", "O"]])
    r = evaluate.chunk_scores(gold, pred).first()
    assert (r.correct, r.gold, r.predicted, r.precision, r.recall) == (1, 2, 1, 100.0, 50.0)
    assert evaluate.accuracy(gold, pred).first().accuracy == 75.0
    none = tags(spark, [["O"]])
    assert evaluate.chunk_scores(none, none).first().f1 == 0.0
    assert evaluate.chunk_scores_by_type(gold, pred).count() == 9


def test_summary_keeps_all_types(spark):
    r = iob.summary_documents(tags(spark, [["B-MAT", "O"]])).first()
    assert r.entities["MAT"] == ["t00"] and r.entities["CMT"] == [] and len(r.entities) == 9
    assert [(x.annotation, x.text) for x in r.tokens[0]] == [("B-MAT", "t00"), ("O", "t01")]


def test_material_cascade(spark):
    text = "AO2 (A = Ti, Zr) was made. BaxSr(1-x)TiO3 (x = 0.25, 0.5) films."
    rows = [("1", 1, "AO2", text), ("2", 1, "BaxSr(1-x)TiO3", text), ("3", 2, "STO", "x"), ("4", 2, "graphene", None), ("5", 2, "foo_bar", "x"), ("6", 2, "nothing", "")]
    m = spark.createDataFrame(rows, "mention_id string, doc_id int, material string, text string")
    mats = spark.createDataFrame([(2, 0, "STO"), (2, 1, "SrTiO3"), (2, 2, "PZT"), (2, 3, "STO-PZT")], "doc_id int, pos int, material string")
    sents = spark.createDataFrame([(2, 0, "we use PZT or PbZrTiO3 here")], "doc_id int, sent_id int, sentence string")
    solved = entities.abbreviations(mats, sents)
    assert {(r.abbreviation, r.full, r.source) for r in solved.collect()} == {("STO", "SrTiO3", "entity"), ("PZT", "PbZrTiO3", "text"), ("STO-PZT", "(SrTiO3)-(PbZrTiO3)", "chain")}
    got = {r.mention_id: (r.normal, r.method) for r in entities.normalize_materials(m, spark.createDataFrame([("foo bar", "FeO")], "material string, formula string"), solved).collect()}
    assert got == {
        "1": (["O2Ti", "O2Zr"], "wildcard"), "2": (["BaO12Sr3Ti4", "BaO6SrTi2"], "fraction"), "3": (["O3SrTi"], "abbreviation"), "4": (["graphene"], "named"),
        "5": (["FeO"], "lookup"), "6": (["nothing"], "identity"),
    }


def test_dictionary_ignores_case(spark):
    e = spark.createDataFrame([("PRO", "Band Gap"), ("MAT", "Band Gap"), ("PRO", "other")], "type string, entity string")
    forms = spark.createDataFrame([("PRO", "band gap", "band gap")], "type string, entity string, most_common string")
    assert sorted((r.type, r.normal) for r in entities.dictionary_normal(e, forms).collect()) == [("MAT", "Band Gap"), ("PRO", "band gap"), ("PRO", "other")]


def test_element_filter(spark):
    rows = [("Tc", 10), ("BiCuOSe", 9), ("AgSbTe2", 8), ("BeLi", 7), ("AgSbSe2", 6), ("PbTe", 5), ("AlFe2V", 4), ("InSe2Tl", 3), ("BFeO3", 2), ("PbSnTe", 1)]
    s = spark.createDataFrame(rows, "formula string, score int")
    n = lambda **k: embed.filter_by_elements(s, **k).count()
    assert n(plus=["Te"]) == 3 and n(plus=["Te", "Bi"]) == 4 and n(minus=["O", "Se"]) == 6 and n(plus=["Pb"], minus=["O", "Se"]) == 2 and n(plus=["O"], minus=["O", "Se"]) == 7


def test_nearest_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "word string, vec array<double>")
    assert [r.word for r in embed.close_words(v, ["a"], top_k=2).collect()] == ["b", "c"]
    assert embed.close_words(v, ["a"], exclude_self=False).first().word == "a"
    m = embed.mean_embedding(spark.createDataFrame([("a",), ("c",), ("missing",)], "word string"), v).first().vec
    assert m == pytest.approx([2**-0.5, 2**-0.5])


def test_most_common_form_breaks_ties(spark):
    c = spark.createDataFrame([("O2Ti", "TiO2", 5), ("O2Ti", "Ti02", 5), ("Fe", "iron", 9), ("CEs", "x", 1)], "formula string, surface string, cnt int")
    assert sorted((r.formula, r.form) for r in embed.most_common_form(c).collect()) == [("Fe", "Fe"), ("O2Ti", "Ti02")]


def test_ids_and_padding(spark):
    t = spark.createDataFrame([("d", 0, 0, "Iron"), ("d", 0, 1, "42"), ("d", 0, 2, "new")], "doc_id string, sent_id int, pos int, tok string")
    vocab = spark.createDataFrame([("iron", 3), ("$NUM$", 1)], "tok string, idx long")
    assert {r.tok: r.word_id for r in tk.encode(t, vocab, unknown=0).collect()} == {"Iron": 3, "42": 1, "new": 0}
    with pytest.raises(Exception, match="unknown word"):
        tk.encode(t, vocab).collect()
    p = tk.padded(spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5])], "b int, a array<int>"), "a", "b", F.lit(0))
    assert sorted((r.b, r.a, r.n) for r in p.collect()) == [(0, [1, 2, 3], 3), (0, [4, 0, 0], 1), (1, [5], 1)]
    b = tk.minibatches(spark.range(10), "id", 4)
    assert sorted((r.id, r.batch_id) for r in b.collect()) == [(i, i // 4) for i in range(10)]


def test_tf_idf_rows_are_unit(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], "doc_id int, tok string")
    got = {(r.doc_id, r.tok): r.weight for r in relevance.tf_idf(t).collect()}
    idf = lambda df: np.log(3 / (1 + df)) + 1
    n = np.hypot(2 * idf(1), idf(2))
    assert got[1, "a"] == pytest.approx(2 * idf(1) / n) and got[2, "b"] == pytest.approx(1)


def test_relevance_boundary(spark):
    docs = spark.createDataFrame([("band gap of ZnO crystal", 1), ("polymer light emitting diode", 0)] * 10, "text string, label int")
    model, _ = relevance.train(docs)
    got = relevance.classify(docs, model).collect()
    assert all(r.relevant == r.label for r in got)
    edge = got[0].probability
    assert {r.relevant for r in relevance.classify(docs.limit(1), model, edge).collect()} != {r.relevant for r in relevance.classify_one(docs.limit(1), model, edge).collect()}


def test_viterbi_is_optimal():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(20):
        s, m, a, b = rng.integers(-5, 6, (4, 3)), rng.integers(-5, 6, (3, 3)), rng.integers(-5, 6, 3), rng.integers(-5, 6, 3)
        best = max(a[p[0]] + b[p[-1]] + sum(s[i, t] for i, t in enumerate(p)) + sum(m[x, y] for x, y in zip(p, p[1:])) for p in product(range(3), repeat=4))
        assert tagger.viterbi(s, m, a, b)[1] == best
    assert tagger.viterbi(np.zeros((0, 3)), m, a, b) == ([], 0.0)


def test_trained_tagger(spark, tmp_path):
    s = spark.createDataFrame([(["iron", "oxide", "is", "red"], ["B-MAT", "I-MAT", "O", "B-PRO"]), (["the", "iron", "gap"], ["O", "B-MAT", "O"])] * 4, "words array<string>, tags array<string>")
    model = tagger.train_tagger(s, dev=s, epochs=5, shards=2)
    assert all(r.predicted == r.tags for r in tagger.tag_arrays(s, model).collect())
    model.save(str(tmp_path / "m"))
    t = registry.load("ner", str(tmp_path / "m"))
    docs = spark.createDataFrame([(1, "iron oxide is red"), (2, None), (3, "")], "doc_id int, text string")
    assert {(r.entity, r.type) for r in t.as_concatenated(docs).collect() if r.type != "O"} == {("iron oxide", "MAT"), ("red", "PRO")}


def test_gazetteer_to_normal_forms(spark):
    g = spark.createDataFrame([("O2Ti", "MAT"), ("gap", "PRO")], "tok string, type string")
    docs = spark.createDataFrame([(1, "TiO2 has a Gap of 3.2 eV.")], "doc_id int, text string")
    forms = spark.createDataFrame([("PRO", "gap", "band gap")], "type string, entity string, most_common string")
    lookup = spark.createDataFrame([], "material string, formula string")
    got = {(r.type, tuple(r.normal)) for r in Tagger(gazetteer=g).as_normalized(docs, forms, lookup).collect()}
    assert ("MAT", ("O2Ti",)) in got and ("PRO", ("band gap",)) in got


def test_registry(tmp_path, spark):
    ok = {"a": "1.0", "b": "2"}

    def installed(name):
        from importlib.metadata import PackageNotFoundError

        if name not in ok:
            raise PackageNotFoundError(name)
        return ok[name]

    assert registry.check_requirement("a==1.0", installed) == "ok"
    with pytest.warns(UserWarning):
        assert registry.check_versions(["b", "git+https://x"], installed) == {"b": "unpinned", "git+https://x": "unpinned"}
    for bad in ("a==2.0", "c==1", "a>=1", "==1"):
        with pytest.raises(registry.ModelRequirementError):
            registry.check_requirement(bad, installed)
    (tmp_path / "w.bin").write_bytes(b"abc")
    import hashlib

    digest = hashlib.sha256(b"abc").hexdigest()
    assert registry.fetch(spark, str(tmp_path), {"w.bin": digest}) == str(tmp_path)
    with pytest.raises(registry.ArtefactError):
        registry.fetch(spark, str(tmp_path), {"w.bin": "0", "gone": "1"})


def test_sources(spark, tmp_path):
    (tmp_path / "c.txt").write_text("-DOCSTART- O\n\niron NN B-MAT\nred O\n\nlast B-PRO\n")
    c = formats.read_conll(spark, str(tmp_path / "c.txt"))
    assert sorted((r.sent_id, r.pos, r.tok, r.tag) for r in c.collect()) == [(0, 0, "iron", "B-MAT"), (0, 1, "red", "O"), (1, 0, "last", "B-PRO")]
    assert formats.count_sentences(c) == 2 and formats.count_sentences(formats.read_conll(spark, str(tmp_path / "c.txt"), 1)) == 1
    (tmp_path / "v.txt").write_text("a\nb\na")
    assert {r.tok: r.idx for r in formats.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()} == {"a": 2, "b": 1}
    (tmp_path / "pro.json").write_text(json.dumps({"Gap": "band gap"}))
    assert formats.read_map(spark, str(tmp_path / "pro.json")).first() == ("Gap", "band gap")
    (tmp_path / "f.json").write_text(json.dumps({"O2Ti": {"TiO2": 3}}))
    assert tuple(formats.read_counts(spark, str(tmp_path / "f.json")).first()) == ("O2Ti", "TiO2", 3)
    np.savez(tmp_path / "m.npz", embeddings=np.arange(6.0).reshape(3, 2))
    assert [r.vec for r in formats.read_npz(spark, str(tmp_path / "m.npz")).orderBy("idx").collect()] == [[0, 1], [2, 3], [4, 5]]
    names = formats.names_dictionary(spark.createDataFrame([(0, "Iron (III) oxide – FeO"), (1, "Iron (III) oxide – Fe2O3"), (0, "bad")], "priority int, line string"))
    assert sorted(tuple(r) for r in formats.with_bare_names(names).collect()) == [("iron (III) oxide", "Fe2O3"), ("iron oxide", "Fe2O3")]


def test_writers(spark, tmp_path):
    v = spark.createDataFrame([("b", 1), ("a", 0)], "tok string, idx long")
    writers.write_vocabulary(v, str(tmp_path / "v"))
    assert "".join(p.read_text() for p in (tmp_path / "v").glob("part*")).split() == ["a", "b"]
    docs = spark.createDataFrame([("x", "Title", "A 5V cell. Next one.", 2001)], "doi string, title string, abstract string, year int")
    writers.write_corpus(docs, str(tmp_path / "c"), split_years=True)
    assert (tmp_path / "c" / "year=2001").exists()
    old = writers.tokenized(spark.createDataFrame([("x", "a b"), ("y", None)], "doi string, text string"))
    new = spark.createDataFrame([("x", "c"), ("z", "d")], "doi string, text string")
    keep = {r.doi: r.tokens for r in writers.merge_tokenized(old, new).collect()}
    assert keep == {"x": [["a", "b"]], "y": None, "z": [["d"]]}
    assert {r.doi: r.tokens for r in writers.merge_tokenized(old, new, override=True).collect()}["x"] == [["c"]]


def test_stream(spark, tmp_path):
    from assaykit.streaming.entities import entity_stream

    docs = spark.createDataFrame([(1, "iron is iron oxide")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    g = {"iron": "MAT", "oxide": "MAT"}
    batch = sorted(tuple(r) for r in entity_stream(docs, g).collect())
    q = entity_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), g).writeStream.format("memory").queryName("stream_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("stream_test").collect()) == batch and len(batch) == 2


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_lookup_join_is_the_same_by_shuffle(spark, most):
    rows = spark.createDataFrame([(i, "the" if i % 3 else f"w{i}") for i in range(60)], "id long, tok string")
    table = spark.createDataFrame([("the", 1), ("w3", 2), ("w9", 3)], "tok string, idx long")
    got = {r.id: r.idx for r in lookup.lookup_join(rows, table, "tok", most=most).collect()}
    assert got == {i: 1 if i % 3 else {3: 2, 9: 3}.get(i) for i in range(60)}
    assert lookup.lookup_join(rows, table, "tok", "inner", most).count() == 42


def test_pairs_give_counts_of_words(spark):
    s = spark.createDataFrame([(["a", "b", "a", "b"],)] * 6 + [(["a"],), ([],)], "tokens array<string>")
    got = {(r.a, r.b): (r.n, round(r.score, 6)) for r in phrases.phrase_scores(s).collect()}
    assert got == {("a", "b"): (12, round(7 * 2 / (13 * 12), 6)), ("b", "a"): (6, round(1 * 2 / (13 * 12), 6))}
