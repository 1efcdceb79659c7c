import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelink.modules import DictionaryRecognizer, FunctionRecognizer, HashEncoder, ManualRecognizer, ManualResolver, SimilarityResolver, WeightedEncoder
from placelink.modules.resolvers import learned, window
from placelink.catalog import Conflict, Tables
from placelink.operators import annotate, spans
from placelink.project import Linker, Project
from placelink.sources import scan
from placelink.streaming.incremental import follow

TEXT = "Test text with toponym"


def test_idempotent_and_tagged(spark, tmp_path):
    project = Project(spark, "p", str(tmp_path))
    project.create_documents([TEXT, "other\r\ntext"])
    manual = ManualRecognizer("one", [TEXT], [[(15, 22)]])
    for _ in range(2):
        project.run_recognizer(manual)
    assert project.references().count() == 1
    assert project.tables.read("recognition").count() == 1  # the other text is left for another run
    project.run_resolver(ManualResolver("one", [TEXT], [[(15, 22)]], [[("g", "7")]]))
    project.run_recognizer(ManualRecognizer("two", [TEXT, "other\ntext"], [[], [(0, 5)]]), tag="b")
    got = {(r.text, r.location_id) for r in project.get_documents().collect()}
    assert got == {("toponym", "7"), (None, None)}
    assert {(r.text, r.location_id) for r in project.get_documents("b").collect()} == {("other", None), (None, None)}
    assert {r.text for r in project.get_documents("none").collect()} == {None}
    assert Project(spark, "p", str(tmp_path)).id == project.id
    with pytest.raises(ValueError):
        project.train_recognizer(manual)
    other = Project(spark, "kept", str(tmp_path))
    other.create_documents(["stays"])
    project.delete()
    assert project.tables.read("reference").count() == 0 and project.tables.read("referent").count() == 0
    assert other.documents().count() == 1 and Project(spark, "kept", str(tmp_path)).id == other.id
    assert Project(spark, "p", str(tmp_path)).id != project.id


def test_changes_at_the_same_time_and_replays(spark, tmp_path):
    a, b = (Tables(spark, str(tmp_path), "s") for _ in range(2))
    row = lambda k: spark.createDataFrame([(str(k), "r")], "document_id string, recognizer_id string")
    a.append("recognition", row(1))
    seen = b.read("recognition")
    a.append("recognition", row(2))
    b.append("recognition", row(3))
    a.append("recognition", row(4), key="batch-0")
    b.append("recognition", row(5), key="batch-0")  # the same batch once more
    assert seen.count() == 1 and sorted(r.document_id for r in a.read("recognition").collect()) == ["1", "2", "3", "4"]
    b.replace("recognition", row(9))
    assert [r.document_id for r in a.read("recognition").collect()] == ["9"]
    a.vacuum()  # what is young may be of a change that is not committed yet
    assert len(a.storage.names("recognition")) == 5
    a.vacuum(older=0)
    assert len(a.storage.names("recognition")) == 1 and a.read("recognition").count() == 1
    a.upsert("recognition", row(9).union(row(10)), ["document_id"])
    assert a.read("recognition").count() == 2


def test_many_changes_are_read_from_few_files(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path), "s")
    row = lambda k: spark.createDataFrame([(str(k), "r")], "document_id string, recognizer_id string")
    tables.append("recognition", row(1))
    for k in range(130):
        tables.commit({}, key=f"batch-{k}")
    tables.append("recognition", row(2))
    opened, real = [], tables.storage.read
    monkeypatch.setattr(tables.storage, "read", lambda name: opened.append(name) or real(name))
    assert sorted(r.document_id for r in tables.read("recognition").collect()) == ["1", "2"]
    assert len(opened) <= 20 and len(tables.storage.names("_log")) <= 45
    assert tables.committed("batch-0") and tables.committed("batch-129") and not tables.committed("batch-130")


def test_two_writers_lose_nothing(spark, tmp_path):
    from threading import Thread

    both = [Tables(spark, str(tmp_path), "s") for _ in range(2)]
    runs = [Thread(target=lambda t=t, n=n: [t.commit({}, key=f"{n}-{k}") for k in range(30)]) for n, t in enumerate(both)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert both[0]._load()[0] == 60 and both[0]._load()[2] == {f"{n}-{k}" for n in (0, 1) for k in range(30)}


def test_upserts_touch_only_folders_with_their_keys(spark, tmp_path, monkeypatch):
    a, b = (Tables(spark, str(tmp_path), "s") for _ in range(2))
    rows = lambda *ks, by="r": spark.createDataFrame([(str(k), by) for k in ks], "document_id string, recognizer_id string")
    for k in range(4):
        a.append("recognition", rows(2 * k, 2 * k + 1))
    before = a._state()["recognition"]
    a.upsert("recognition", rows(3, 9, by="new"), ["document_id"])
    after = a._state()["recognition"]
    assert [f for f in before if f not in after] == [before[1]] and len(after) == 4
    assert sorted(map(tuple, a.read("recognition").collect())) == sorted([(str(k), "new" if k == 3 else "r") for k in range(8)] + [("9", "new")])
    # another writer changes the same folder while this one writes
    real, raced = b.commit, []

    def late(*args, **more):
        if not raced:
            raced.append(1)
            a.upsert("recognition", rows(0, by="first"), ["document_id"])
        return real(*args, **more)

    monkeypatch.setattr(b, "commit", late)
    b.upsert("recognition", rows(0, 1, by="second"), ["document_id"])
    assert {r.document_id: r.recognizer_id for r in a.read("recognition").collect() if r.document_id in "01"} == {"0": "second", "1": "second"}
    with pytest.raises(Conflict):
        a.commit({}, drop=["recognition/gone"])


def test_spans_that_are_moved(spark):
    tops = spark.createDataFrame([(1, 0, 4, "a"), (1, 10, 14, "b"), (1, 300, 310, "c")], "document_id long, start int, end int, loc_id string")
    changes = spark.createDataFrame([(1, 0, 4, 2, 6), (1, 10, 14, 5, 301), (1, 300, 310, 299, 305)], "document_id long, old_start int, old_end int, start int, end int")
    got = sorted((r.start, r.end, r.loc_id) for r in spans.moved(tops, changes).collect())
    assert got == [(2, 6, "a"), (10, 14, "b"), (299, 305, "c")]


def test_a_large_lexicon_is_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "in New York  City or York"), (2, None), (3, "York New York"), (4, "")], "document_id long, text string")
    names = spark.createDataFrame([("York",), ("New York",), ("New York City",), (None,)], "name string")
    want = {(1, 3, 17, "New York City"), (1, 21, 25, "York"), (3, 0, 4, "York"), (3, 5, 13, "New York")}
    assert {tuple(r) for r in spans.dictionary(docs, names, 3).collect()} == want
    monkeypatch.setattr(spans, "LEXICON_ROWS", 1)
    assert {tuple(r) for r in spans.dictionary(docs, names, 3).collect()} == want


def test_annotations(spark, tmp_path):
    file = tmp_path / "a.json"
    file.write_text(json.dumps({"gazetteer": "g", "documents": [{"text": TEXT, "toponyms": [{"start": 15, "end": 22, "text": "toponym", "loc_id": "5"}, {"start": 0, "end": 4, "text": "Test", "loc_id": ""}]}]}))
    project = Project(spark, "q", str(tmp_path / "s"))
    project.load_annotations(str(file), "gold", create_documents=True)
    assert [(r.text, r.location_id) for r in project.get_documents("gold").collect()] == [("Test", None), ("toponym", "5")]


def test_parse_and_stream(spark, tmp_path):
    names = spark.createDataFrame([(1, "Bern"), (2, "New York"), (3, "York"), (4, "Bern")], "feature_id long, name string")
    described = spark.createDataFrame([(1, "a1", "Bern (capital) in Switzerland"), (2, "a2", "New York (city) in USA"), (3, "a3", "York (city) in England"), (4, "a4", "Bern (village) in Idaho, USA")], "feature_id long, location_id string, description string")
    recognizer = DictionaryRecognizer(names, "names")
    resolver = SimilarityResolver("g", names, described, min_similarity=0.05)
    found = Linker(spark, str(tmp_path / "p"), recognizer, resolver).parse(["the capital of Switzerland is Bern", "New York is a city in USA"])
    assert [(r.get("text"), r.get("location_id")) for r in found] == [("Bern", "a1"), ("New York", "a2")]
    gold = spark.createDataFrame([("r", "a1")], "reference_id string, location_id string")
    refs = spark.createDataFrame([("r", "so Bern it is", 3, 7, "Bern")], "reference_id string, document string, start int, end int, text string")
    assert sorted((r.label, r.description[:12]) for r in resolver.training_pairs(refs, gold).collect()) == [(0, "Bern (villag"), (1, "Bern (capita")]
    spark.createDataFrame([("in Bern",), ("in York",)], "text string").write.parquet(str(tmp_path / "in"))
    project = Project(spark, "s", str(tmp_path / "t"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    upper = FunctionRecognizer(lambda: lambda texts: [[(3, len(t))] for t in texts], label="rest")
    for _ in range(2):
        follow(stream, project, str(tmp_path / "c"), upper).awaitTermination()
    assert sorted(r.text for r in project.get_documents().collect()) == ["Bern", "York"]
    shutil.rmtree(tmp_path / "c" / "commits")  # the batch was made but not noted: it runs again
    follow(stream, project, str(tmp_path / "c"), upper).awaitTermination()
    assert sorted(r.text for r in project.get_documents().collect()) == ["Bern", "York"]


def test_window():
    text = "One two. Three four five. Six seven eight nine. Ten."
    assert window(text, 0, 99) == text
    assert window(text, 12, 5) == "One two. Three four five."
    assert window(text, 12, 6) == "One two. Three four five."
    assert window(text, 27, 5) == "Six seven eight nine. Ten."
    with pytest.raises(ValueError):
        window(text, 8, 3)


def test_annotation_values(spark):
    docs = spark.createDataFrame([(1,), (2,)], "document_id long")
    tops = spark.createDataFrame([(1, 0, 1, "a", ""), (1, 2, 3, "a", None), (1, 4, 5, "a", "x"), (1, 6, 7, "a", "")], "document_id long, start int, end int, text string, loc_id string")
    assert [tuple(r) for r in annotate.progress(docs, tops).orderBy("document_id").collect()] == [(1, 4, 2, 50.0), (2, 0, 0, 0.0)]
    change = tops.where("start = 0").withColumn("loc_id", F.lit(None).cast("string"))
    assert [r.loc_id for r in annotate.annotate(tops, change).orderBy("start").collect()] == [None, None, "x", None]
    assert [r.loc_id for r in annotate.annotate(tops, change, one_sense=False).orderBy("start").collect()] == [None, None, "x", ""]


def test_recognizers_that_learn(spark, tmp_path):
    names = spark.createDataFrame([("Bath",), ("Reading",)], "name string")
    project = Project(spark, "train", str(tmp_path))
    texts = ["Reading a book in Ulm", "Reading on the train", "Ulm is near New Ulm"]
    project.create_documents(texts)
    project.create_references("gold", texts, [[(18, 21)], [], [(0, 3), (12, 19)]], tag="gold")
    fitted = project.train_recognizer(DictionaryRecognizer(names, "d"), "gold", output_path=str(tmp_path / "lexicon"))
    loaded = DictionaryRecognizer.load(spark, str(tmp_path / "lexicon"), "d-fitted")
    assert {r.name for r in fitted.names.collect()} == {r.name for r in loaded.names.collect()} == {"Bath", "Ulm", "New Ulm"}
    with pytest.raises(ValueError, match="no spans"):
        project.train_recognizer(DictionaryRecognizer(names, "d"), "none", output_path=str(tmp_path / "x"))


def test_labels_are_distilled(spark):
    base = lambda: lambda texts: [[(0, 4, "GPE"), (5, 9, "ORG"), (10, 20, "FAC")] if t else None for t in texts]
    seen = []
    model = FunctionRecognizer(base, ("GPE", "FAC", "LOC"), lambda rows, path, **o: seen.append((path, o)) or rows, label="m")
    docs = spark.createDataFrame([(1, "Bern News Old Bridge and more"), (2, "")], "document_id int, text string")
    assert {r.document_id: r.spans and [tuple(s) for s in r.spans] for r in model.predict(docs).collect()} == {1: [(0, 4), (10, 20)], 2: None}
    gold = spark.createDataFrame([(1, "Bern News Old Bridge and more", a, b, "x") for a, b in ((0, 4), (2, 12), (5, 9), (14, 17))] + [(2, "", None, None, None)], "document_id int, document string, start int, end int, text string")
    made = {r.document_id: [tuple(e) for e in r.entities] for r in model.fit(gold, "out", epochs=3).collect()}
    assert made == {1: [(0, 4, "GPE"), (2, 12, "GPE"), (5, 9, "LOC"), (14, 17, "FAC")], 2: []} and seen == [("out", {"epochs": 3})]
    with pytest.raises(ValueError, match="no trainer"):
        FunctionRecognizer(base, label="n").fit(gold, "out")


def test_a_resolver_that_learns(spark, tmp_path):
    rows = [("the town hall of Bern", "Bern (town)", 1), ("the town hall of Bern", "Bern (hill)", 0), ("climbing the hill Napf", "Napf (hill)", 1), ("climbing the hill Napf", "Napf (town)", 0)] * 5
    pairs = spark.createDataFrame(rows, "context string, description string, label int")
    encoder = learned(pairs)
    encoder.save(spark, str(tmp_path / "model"))
    again = WeightedEncoder.load(spark, str(tmp_path / "model"))

    def margin(encode):
        a, b, c = (np.array(v) for v in encode(["see the town of Zug", "Zug (town)", "Zug (hill)"]))
        return a @ b - a @ c

    assert margin(again) == margin(encoder) > margin(HashEncoder()) > 0


def test_settings(spark):
    sessions = spark.createDataFrame([(1,), (2,), (2,)], "session_id int")
    held = annotate.settings(sessions)
    assert sorted(map(tuple, held.collect())) == [(1, False, False), (2, False, False)]
    held = annotate.put_settings(held, spark.createDataFrame([(2, None, True)], "session_id int, auto_close_annotation_modal boolean, one_sense_per_discourse boolean"))
    assert sorted(map(tuple, annotate.settings(sessions, held).collect())) == [(1, False, False), (2, False, True)]


def test_legacy_sessions(spark, tmp_path):
    body = {"created_at": "a", "last_updated": "b", "gazetteer": "g", "documents": [{"filename": "f", "text": "In Bern", "toponyms": [{"text": "Bern", "start": 3, "end": 7, "loc_id": ""}]}]}
    folder = tmp_path / "old"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps(body))
    (folder / "two.json").write_text("{broken")
    assert scan.import_sessions(spark, str(folder), str(tmp_path / "t")) == {"found": 2, "loaded": 1, "failed": ["two.json"]}
    assert [p.name for p in folder.glob("*.json")] == ["two.json"]
    assert [(r.text, r.start) for r in spark.read.parquet(str(tmp_path / "t" / "toponyms")).collect()] == [("Bern", 3)]
    assert scan.import_sessions(spark, str(tmp_path), str(tmp_path / "t")) == {"found": 0, "loaded": 0, "failed": []}
