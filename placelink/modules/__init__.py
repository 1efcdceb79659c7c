"""Recognizers and resolvers, and the interfaces to write more."""

from placelink.modules.base import Module, Recognizer, Resolver
from placelink.modules.encoder import TwoTowers
from placelink.modules.recognizers import DictionaryRecognizer, FunctionRecognizer, ManualRecognizer
from placelink.modules.resolvers import HashEncoder, ManualResolver, SimilarityResolver, WeightedEncoder
from placelink.modules.tagger import Tagger, TaggerRecognizer

__all__ = ["DictionaryRecognizer", "FunctionRecognizer", "HashEncoder", "ManualRecognizer", "ManualResolver", "Module", "Recognizer", "Resolver", "SimilarityResolver", "Tagger", "TaggerRecognizer", "TwoTowers", "WeightedEncoder"]
