"""What modules have in common: a name, settings and an id made of both."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame

from placelink.functions.text import module_id, module_text


class Module(ABC):
    """A module with settings; modules of equal name and settings have equal ids."""

    NAME: str = ""

    def __init__(self, **config):
        if not self.NAME:
            raise ValueError(f"{type(self).__name__} has no NAME")
        self.config = config

    @property
    def id(self) -> str:
        return module_id(self.NAME, self.config)

    @property
    def config_json(self) -> str:
        return json.dumps(self.config, sort_keys=True, default=str)

    def __str__(self) -> str:
        return module_text(self.NAME, self.config)


class Recognizer(Module):
    @abstractmethod
    def predict(self, documents: DataFrame) -> DataFrame:
        """``(document_id, spans array<struct<start:int, end:int>>)`` of ``documents(document_id, text)``.

        Null spans, or no row, say that a document could not be processed.
        """


class Resolver(Module):
    @abstractmethod
    def predict(self, references: DataFrame) -> DataFrame:
        """``(reference_id, gazetteer, location_id)`` of ``references(reference_id, document, start, end, text)``.

        References without a row are tried again next time.
        """
