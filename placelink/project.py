"""Projects: documents, what modules found in them, and tagged views."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelink.catalog import Tables
from placelink.functions import text as T
from placelink.modules import ManualRecognizer, ManualResolver, Recognizer, Resolver
from placelink.operators import annotate, context, registration
from placelink.storage import Storage


class Project:
    """A project by name, created if there is none.  Processing is incremental:
    a module sees a document or reference once, whatever is run how often."""

    def __init__(self, spark: SparkSession, name: str, root: str):
        self.spark, self.name, self.root = spark, name, root
        names = Storage(spark, root)
        at = f"names/{hashlib.sha256(name.encode()).hexdigest()}.json"
        if not names.exists(at):
            names.write(at, json.dumps({"name": name, "project_id": str(uuid.uuid4())}))
        self.id = json.loads(names.read(at))["project_id"]
        self._forget = lambda: names.delete(at)
        self.tables = Tables(spark, root, f"projects/{self.id}")
        self.modules = Tables(spark, root, "modules")

    # documents

    def create_documents(self, texts: str | list[str] | DataFrame, key: str | None = None) -> None:
        """Add texts: one, a list, or a DataFrame with ``text``; line ends become LF.

        What is added under a ``key`` is added once, however often it is asked for.
        """
        if key is not None and self.tables.committed(key):
            return
        if isinstance(texts, DataFrame):
            rows = texts.select("text")
        else:
            rows = self.spark.createDataFrame([(t,) for t in ([texts] if isinstance(texts, str) else texts)], "text string").coalesce(1)
        first = (self.documents().agg(F.max("seq")).first()[0] or 0) + 1
        rows = rows.select(T.newlines(F.col("text")).alias("text"), (F.monotonically_increasing_id() + first).alias("seq"))
        self.tables.append("document", rows.select(F.lit(self.id).alias("project_id"), F.expr("uuid()").alias("document_id"), "seq", "text"), key)

    def documents(self) -> DataFrame:
        return self.tables.read("document").where(F.col("project_id") == self.id)

    # modules

    def run_recognizer(self, module: Recognizer, tag: str = "latest") -> None:
        """Find spans in documents that the module has not seen, and point the tag at it.

        A document with null spans is left for another run; one with none counts as seen.
        """
        self._know("recognizer", module)
        seen = self.tables.read("recognition").where(F.col("recognizer_id") == module.id)
        new = self.documents().select("document_id", "text").join(seen.select("document_id"), "document_id", "left_anti")
        if not new.isEmpty():
            found, made = self.tables.written(module.predict(new).where("spans is not null").select("document_id", "spans"))
            each = found.select("document_id", F.explode("spans").alias("s")).select("document_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
            each = each.join(new, "document_id").select(F.expr("uuid()").alias("reference_id"), "document_id", F.lit(module.id).alias("recognizer_id"), "start", "end", T.span_text(F.col("text"), F.col("start"), F.col("end")).alias("text"))
            self.tables.commit({"reference": each, "recognition": found.select("document_id", F.lit(module.id).alias("recognizer_id"))})
            self.tables.forget(made)
        self._tag(tag, recognizer=module.id)

    def references(self) -> DataFrame:
        """References of all recognizers, with their documents' texts."""
        docs = self.documents().select("document_id", F.col("text").alias("document"))
        return self.tables.read("reference").join(docs, "document_id")

    def run_resolver(self, module: Resolver, tag: str = "latest") -> None:
        """Locate references that the module has not located yet, and point the tag at it."""
        self._know("resolver", module)
        seen = self.tables.read("resolution").where(F.col("resolver_id") == module.id)
        new = self.references().join(seen.select("reference_id"), "reference_id", "left_anti")
        if not new.isEmpty():
            found, made = self.tables.written(module.predict(new).select("reference_id", "gazetteer", "location_id"))
            located = found.select(F.expr("uuid()").alias("referent_id"), "reference_id", F.lit(module.id).alias("resolver_id"), "gazetteer", "location_id")
            self.tables.commit({"referent": located, "resolution": found.select("reference_id", F.lit(module.id).alias("resolver_id")).distinct()})
            self.tables.forget(made)
        self._tag(tag, resolver=module.id)

    def create_references(self, label: str, texts: list[str], references: list, tag: str = "latest") -> None:
        self.run_recognizer(ManualRecognizer(label, texts, references), tag)

    def create_referents(self, label: str, texts: list[str], references: list, referents: list, tag: str = "latest") -> None:
        self.run_resolver(ManualResolver(label, texts, references, referents), tag)

    def load_annotations(self, path: str, tag: str = "latest", create_documents: bool = False) -> None:
        """References and referents of an annotation file, as manual modules labelled by the tag."""
        parsed = self.spark.read.option("multiLine", "true").schema("gazetteer string, documents array<struct<text:string,toponyms:array<struct<start:int,`end`:int,text:string,loc_id:string>>>>").json(path)
        gazetteer = parsed.first()["gazetteer"]
        rows = annotate.annotations(parsed).orderBy("doc_pos", "pos").collect()  # one annotation file
        texts: dict[int, str] = {}
        spans: dict[int, list] = {}
        found: dict[int, list] = {}
        for r in rows:
            texts[r["doc_pos"]] = r["text"].replace("\r\n", "\n").replace("\r", "\n")
            own, where = spans.setdefault(r["doc_pos"], []), found.setdefault(r["doc_pos"], [])
            if r["start"] is not None:
                own.append((r["start"], r["end"]))
                where.append((gazetteer, r["location_id"]) if r["location_id"] is not None else None)
        order = sorted(texts)
        listed = [texts[k] for k in order]
        if create_documents:
            self.create_documents(listed)
        self.create_references(tag, listed, [spans[k] for k in order], tag)
        self.create_referents(tag, listed, [spans[k] for k in order], [found[k] for k in order], tag)

    def train_recognizer(self, module, tag: str = "latest", **options):
        """Hand ``(document_id, text, start, end)`` of the tag's spans to the module's ``fit``."""
        if not hasattr(module, "fit"):
            raise ValueError(f"{module} cannot be trained")
        return module.fit(self.get_documents(tag).join(self.documents().select("document_id", F.col("text").alias("document")), "document_id"), **options)

    def train_resolver(self, module, tag: str = "latest", **options):
        """Hand contexts, descriptions and labels of the tag's located spans to the module's ``fit``."""
        if not hasattr(module, "fit"):
            raise ValueError(f"{module} cannot be trained")
        own = self.tables.read("tag").where((F.col("project_id") == self.id) & (F.col("tag") == tag)).select("resolver_id")
        gold = self.tables.read("referent").join(own, "resolver_id", "left_semi")
        refs = self.references().join(gold.select("reference_id"), "reference_id", "left_semi")
        return module.fit(module.training_pairs(refs, gold), **options)

    # views

    def get_documents(self, tag: str = "latest") -> DataFrame:
        """Documents with the toponyms and locations of a tag; reading makes no tag."""
        refs = self.tables.read("reference")
        rows = context.view(self.documents(), refs, self.tables.read("referent"), self.tables.read("tag"), tag)
        created = self.documents().select("document_id", F.col("seq").alias("_seq"))
        return rows.join(created, "document_id").orderBy("_seq", "start").select(*rows.columns)

    def delete(self) -> None:
        """Delete the project with all that hangs on it; other projects and the modules stay as they are."""
        self._forget()
        self.tables.remove()

    def _know(self, kind: str, module) -> None:
        rows = self.spark.createDataFrame([(module.id, module.NAME, module.config_json)], f"{kind}_id string, name string, config string")
        new = registration.new_rows(rows, self.modules.read(kind), [f"{kind}_id"])
        if not new.isEmpty():
            self.modules.append(kind, new)

    def _tag(self, tag: str, recognizer: str | None = None, resolver: str | None = None) -> None:
        change = self.spark.createDataFrame([(self.id, tag, recognizer, resolver)], "project_id string, tag string, recognizer_id string, resolver_id string")
        self.tables.replace("tag", context.retag(self.tables.read("tag"), change))


class Linker:
    """Recognize and resolve in one go; either step may be left out."""

    def __init__(self, spark: SparkSession, root: str, recognizer: Recognizer | None = None, resolver: Resolver | None = None):
        self.spark, self.root, self.recognizer, self.resolver = spark, root, recognizer, resolver

    def parse(self, texts: str | list[str] | DataFrame, save: str | None = None) -> list[dict]:
        """The view's rows; the project goes again unless ``save`` names it."""
        project = Project(self.spark, save or f"parse-{uuid.uuid4().hex}", self.root)
        try:
            project.create_documents(texts)
            if self.recognizer:
                project.run_recognizer(self.recognizer)
            if self.resolver:
                project.run_resolver(self.resolver)
            rows = project.get_documents().join(project.documents().select("document_id", "seq", F.col("text").alias("document")), "document_id").orderBy("seq", "start")
            return [json.loads(r) for r in rows.toJSON().toLocalIterator()]
        finally:
            if not save:
                project.delete()
