"""Language identification by rank-order profiles: the out-of-place distance of frequent n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import bounded_batches, cached, held_out, stored

UNDETERMINED = "und"
# N-grams of one to three characters; three code points fit one 64-bit number.
LONGEST = 3
# Ranks of a profile.  A text's own profile is as long.
RANKS = 400
# Profiles are learned from at most this many documents of each language.
SAMPLE_PER_LANGUAGE = 3_000
# A text is too far from a language below this part of the median score of the language's sample,
# unless it has too few n-grams to tell.
FLOOR = 0.5
LEAST_GRAMS = 50
_SPACE = 32
_CHARS = 1 << 18  # characters of a text counted at once


def _letters() -> np.ndarray:
    """Per code point its lower case if it is a letter, else a space."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for code in range(0x110000):
        if (c := chr(code)).isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers and how often each occurs; nothing without a letter.

    Letters are lower-cased, everything else parts words, and a word has a space on both sides.
    N-grams don't reach across words, and a space alone is none.
    """
    table = cached("letters", _letters)
    code = table[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    if not (code != _SPACE).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.concatenate(([_SPACE], code, [_SPACE])).astype(np.uint64)
    gap = code == _SPACE
    code = code[~(gap & np.append(False, gap[:-1]))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(code), _CHARS):
        part = code[at : at + _CHARS + LONGEST - 1]
        first, rolled, stretch = part[:_CHARS], part, []
        for n in range(1, LONGEST + 1):
            if n > 1:
                if len(part) < n:
                    break
                rolled = (rolled[:-1] << np.uint64(21)) | part[n - 1 :]
            here = rolled[: len(first)]
            inner = np.zeros(len(here), bool)
            for i in range(1, n - 1):  # a space inside: two words
                inner |= part[i : i + len(here)] == _SPACE
            if n == 1:
                inner = here == _SPACE
            stretch.append(here[~inner])
        found.append(np.unique(np.concatenate(stretch), return_counts=True))
    if len(found) == 1:
        return found[0]
    every, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return every, np.bincount(place, np.concatenate([n for _, n in found])).astype(np.int64)


def ranked(gram: np.ndarray, count: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, ties by code point."""
    if len(gram) > ranks:
        floor = np.partition(count, len(count) - ranks)[len(count) - ranks]
        keep = count >= floor
        gram, count = gram[keep], count[keep]
    return gram[np.lexsort((gram, -count))[:ranks]]


class Profiles:
    """Ranked n-grams per language, in the order of the languages' names."""

    def __init__(self, languages: dict[str, np.ndarray], ranks: int = RANKS) -> None:
        self.floors: dict[str, float] = {}  # least score of a text in the language, see fit_with_floors
        self.names = sorted(languages)
        self.ranks = ranks
        self.every = np.unique(np.concatenate([*languages.values(), np.zeros(0, np.uint64)]).astype(np.uint64))
        self.place = np.full((len(self.names), len(self.every)), ranks, np.int64)
        for i, name in enumerate(self.names):
            profile = languages[name]
            self.place[i, np.searchsorted(self.every, profile)] = np.arange(len(profile))

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance, and one minus that distance over the largest possible.

        An n-gram that a language's profile lacks counts as ``ranks`` places off.  Ties go to the
        first name.  Without a letter, or without profiles, the answer is ``und`` and 0.
        """
        return self._nearest(ranked(*grams(text), self.ranks))

    def plausible(self, text: str | None) -> bool:
        """Whether a text has letters and is not too far from all languages learned.

        Without profiles every text with a letter is.  A text of few n-grams is unless all
        profiles lack all of them.
        """
        own = ranked(*grams(text), self.ranks)
        if not len(own) or not self.names:
            return len(own) > 0
        name, score = self._nearest(own)
        return score > 0 and (len(own) < LEAST_GRAMS or score >= self.floors.get(name, 0.0))

    def _nearest(self, own: np.ndarray) -> tuple[str, float]:
        if not len(own) or not self.names:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.every, own)
        at[at == len(self.every)] = 0
        known = self.every[at] == own
        off = np.abs(self.place[:, at[known]] - np.flatnonzero(known))
        absent = self.place[:, at[known]] == self.ranks
        distance = np.where(absent, self.ranks, np.minimum(off, self.ranks)).sum(axis=1) + self.ranks * int((~known).sum())
        best = int(distance.argmin())
        return self.names[best], 1 - float(distance[best]) / (self.ranks * len(own))


def _sample(
    documents: DataFrame, id_column: str, text_column: str, language_column: str, sample_per_language: int
) -> DataFrame:
    """``language`` and ``text`` of the documents that profiles are learned from."""
    bounded_batches(documents.sparkSession)
    use = documents.where(
        F.col(id_column).isNotNull()
        & F.col(text_column).isNotNull()
        & F.col(language_column).isNotNull()
        & ~held_out(F.col(id_column))
    )
    named = use.select(F.col(language_column).alias("language"), F.col(id_column).alias("id"))
    sizes = named.groupBy("language").agg(F.count("*").alias("n"))
    # ids are spread evenly by their hash: a threshold keeps about the wanted number, a rank cuts it exactly
    part = F.least(F.lit(1.0), 1.25 * sample_per_language / F.col("n"))
    low = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part * (1 << 30)
    few = named.distinct().join(sizes, "language").where(low).select("language", "id")
    number = F.row_number().over(Window.partitionBy("language").orderBy(F.xxhash64("id"), "id"))
    few = few.withColumn("number", number).where(F.col("number") <= sample_per_language).drop("number")
    # as a stored table Spark knows its size, and need not move the texts to find it small
    few = stored(few, "language-sample")
    read = use.select(
        F.col(language_column).alias("language"), F.col(id_column).alias("id"), F.col(text_column).alias("text")
    )
    return read.join(few, ["language", "id"], "left_semi").select("language", "text")


def fit(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    ranks: int = RANKS,
) -> Profiles:
    """Profiles of all languages named in documents that are not held out.

    Of each language it reads the documents whose ids have the lowest hashes, at most
    ``sample_per_language``; the n-grams' counts are summed before they move, and the profiles
    (``ranks`` numbers per language) come to the driver.  Rows without id, text or language
    take no part.
    """
    return _profiles(_sample(documents, id_column, text_column, language_column, sample_per_language), ranks)


def fit_with_floors(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    ranks: int = RANKS,
) -> Profiles:
    """As :func:`fit`, and the least score a text of each language has.

    It is ``FLOOR`` times the median score of the language's sample, so that up to half of a
    sample may be noise.
    """
    sample = _sample(documents, id_column, text_column, language_column, sample_per_language)
    profiles = _profiles(sample, ranks)
    scored = identify(sample, profiles, to="found").where("found.lang_pred = language")
    median = F.percentile_approx("found.score", 0.5, 1000).alias("median")
    profiles.floors = {r["language"]: FLOOR * r["median"] for r in scored.groupBy("language").agg(median).toLocalIterator()}
    return profiles


def _profiles(sample: DataFrame, ranks: int) -> Profiles:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(name, []).append(grams(text.as_py()))
            for name, found in held.items():
                gram, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                count = np.bincount(place, np.concatenate([n for _, n in found])).astype(np.int64)
                yield pa.record_batch(
                    [pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(count)],
                    names=["language", "gram", "n"],
                )

    counted = sample.mapInArrow(run, "language string, gram bigint, n bigint")
    totals = counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("rank", best).where(F.col("rank") <= ranks).orderBy("language", "rank")
    languages: dict[str, list[int]] = {}
    for row in top.select("language", "gram").toLocalIterator():
        languages.setdefault(row["language"], []).append(row["gram"])
    return Profiles({name: np.array(g, np.int64).view(np.uint64) for name, g in languages.items()}, ranks)


def identify(
    documents: DataFrame, profiles: Profiles, text_column: str = "text", to: str = "language"
) -> DataFrame:
    """The documents with ``struct(lang_pred, score)`` of their whole text in column ``to``.

    A column of that name is replaced.  Nothing is shuffled.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        found = [shared.value.classify(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
            names=["lang_pred", "score"],
        )

    return documents.withColumn(to, run(F.col(text_column)))


def plausible(documents: DataFrame, profiles: Profiles, text_column: str = "text") -> DataFrame:
    """The documents whose text could be in one of the languages learned.  Nothing is shuffled."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.plausible(t.as_py()) for t in texts], pa.bool_())

    return documents.where(run(F.col(text_column)))
