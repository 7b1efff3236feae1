"""Language identification by rank-order n-gram profiles.

A profile is the ``PROFILE`` most frequent n-grams (1 to 3 characters, words
padded with blanks, letters only) in order. A document's own profile is compared
with each language's: every n-gram of the document adds how far it is out of
place, or ``PROFILE`` if the language's profile lacks it. The language with the
smallest sum wins, ties go to the smaller name.

An n-gram is one integer of 21 bits a character, so profiles are sorts of
integer arrays and no n-gram string is ever made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, emit, slices

PROFILE = 300
UNKNOWN = "und"
#: Distinct n-grams a task holds for one language before it passes its counts on.
_HELD = 300_000
_BITS = np.uint64(21)


@cache
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


def letters(text: str) -> np.ndarray:
    """Code points of the lowered letters, one blank (32) for each run of anything else, and blanks at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    keep = _alphabetic()[points]
    out = np.where(keep, points, 32).astype(np.uint64)
    return out[keep | np.concatenate([[True], keep[:-1]])]


def grams(text: str | None) -> np.ndarray:
    """All 1- to 3-grams of a text as integers; none if it has no letter."""
    if not text:
        return np.empty(0, np.uint64)
    x = letters(text)
    if len(x) < 2:
        return np.empty(0, np.uint64)
    two = x[:-1] << _BITS | x[1:]
    three = two[:-1] << _BITS | x[2:]
    return np.concatenate([x[x != 32], two, three])


def profile(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties to the smaller code."""
    kinds, counts = np.unique(codes, return_counts=True)
    if len(kinds) > size:
        # all above the size-th count, and of those equal to it the smallest codes
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        above = np.flatnonzero(counts > least)
        keep = np.sort(np.concatenate([above, np.flatnonzero(counts == least)[: size - len(above)]]))
        kinds, counts = kinds[keep], counts[keep]
    return kinds[np.argsort(-counts, kind="stable")]


@dataclass
class Model:
    """Languages in order of name, and for every n-gram in any profile its place in each."""

    languages: list[str]
    codes: np.ndarray
    places: np.ndarray  # (n-grams, languages); ``size`` where a profile lacks one
    size: int = PROFILE

    @classmethod
    def of(cls, profiles: dict[str, list[int]], size: int = PROFILE) -> Model:
        languages = sorted(profiles)
        codes = np.unique(np.array([c for p in profiles.values() for c in p], np.uint64))
        places = np.full((len(codes) + 1, len(languages)), size, np.int64)
        for k, name in enumerate(languages):
            places[np.searchsorted(codes, np.array(profiles[name], np.uint64)), k] = np.arange(len(profiles[name]))
        return cls(languages, codes, places, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language, and 1 - distance / largest possible distance; ``und`` and 0 without a letter or a model."""
        own = profile(grams(text), self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        places = self.places[at]
        ranks = np.arange(len(own))[:, None]
        distance = np.where(places < self.size, np.abs(places - ranks), self.size).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(own))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Model:
    """Profiles from all whole texts with a language.

    Tasks emit bounded partial counts, Spark sums them and keeps the first
    ``size`` n-grams of each language; only those reach the driver.
    """
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flushed(lang: str) -> pa.RecordBatch:
            codes, counts = held.pop(lang)
            return emit(schema, [lang] * len(codes), pa.array(codes.view(np.int64)), pa.array(counts))

        for part in slices(batches):
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                codes, counts = np.unique(np.concatenate(found), return_counts=True)
                if lang in held:
                    a, n = held[lang]
                    codes, back = np.unique(np.concatenate([a, codes]), return_inverse=True)
                    counts = np.bincount(back, np.concatenate([n, counts])).astype(np.int64)
                held[lang] = codes, counts
                if len(codes) > _HELD:
                    yield flushed(lang)
        for lang in [*held]:
            yield flushed(lang)

    learned = docs.where(col(lang_col).isNotNull() & col(text_col).isNotNull())
    counted = learned.select(col(text_col).cast("string"), col(lang_col).cast("string")).mapInArrow(run, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in counted.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return Model.of(profiles, size)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``und`` with score 0 for a null text or one without a letter.

    Repeated rows stay repeated, an empty table gives an empty result, and only
    the two named columns are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [model.predict(t) for t in part.column(1).to_pylist()]
            yield emit(schema, part.column(0), [x for x, _ in found], [x for _, x in found])

    return docs.select(col(id_col).cast("long"), col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents that are not held out, applied to all."""
    out = identify(docs, learn(docs.where(~held_out(id_col)), text_col, lang_col), id_col, text_col)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    min_score: float = 0.05) -> DataFrame:
    """Rows of ``docs`` whose text is in one of the learned languages, with all their columns.

    A text goes if it has no letter or if its profile is as far from every
    language as unrelated text (score under ``min_score``). Where no text has a
    language to learn from, nothing can be told apart: all texts with a letter stay.
    """
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    verdict = pa.schema([("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(at).to_pylist()
            if model.languages:
                keep = [lang != UNKNOWN and score >= min_score for lang, score in map(model.predict, texts)]
            else:
                keep = [len(grams(t)) > 0 for t in texts]
            yield part.filter(pa.array(keep, verdict.field(0).type))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
