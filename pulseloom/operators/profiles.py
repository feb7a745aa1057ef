"""Language identification by ranked character n-grams, learnt from labelled texts.

After Cavnar and Trenkle (1994): a profile lists the ``TOP`` most frequent runs of one to three characters within words (with their
borders), by rank. A text gets the language whose profile is least out of place: the sum, over the text's own ranked runs,
of the distance between both ranks, and the greatest distance for a run the profile lacks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

TOP = 400
MIN_LETTERS = 3      # a text with fewer letters has no detectable language
CHUNK_CHARS = 1 << 20  # of a text that are counted at once
BORDER = ord("_")


def _letters(text: Column) -> Column:
    """Lower-cased words between borders."""
    return F.concat(F.lit("_"), F.regexp_replace(F.lower(text), r"[^\p{L}]+", "_"), F.lit("_"))


def _runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs of a text, sorted, and how often each occurs. A code holds up to three characters of 21 bits."""
    codes, counts = [], []
    for at in range(0, len(text), CHUNK_CHARS):
        c = np.frombuffer(text[at:at + CHUNK_CHARS + 2].encode("utf-32-le"), "<u4").astype(np.int64)
        own = min(CHUNK_CHARS, len(text) - at)  # runs that begin here; the chunk looks two characters further
        inner = c == BORDER
        one = c[:own][~inner[:own]]
        two, three = (c[:-1] << 21 | c[1:])[:own], (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[:own]
        found = np.concatenate([one, two[~(inner[:-1] & inner[1:])[:own]], three[~inner[1:-1][:own]]])
        values, number = np.unique(found, return_counts=True)
        codes.append(values)
        counts.append(number)
    values, back = np.unique(np.concatenate(codes), return_inverse=True)
    return values, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def learnt(labelled: DataFrame, *, text_col: str, language_col: str, top: int = TOP) -> DataFrame:
    """``language, code, rank``: the profile of each language, from rows with a text and a language."""
    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = total.setdefault(language, {})
                for code, n in zip(*(x.tolist() for x in _runs(text))):
                    own[code] = own.get(code, 0) + n
        for language, own in total.items():
            yield pa.RecordBatch.from_pydict({"language": pa.array([language] * len(own), pa.string()), "code": pa.array(own.keys(), pa.int64()),
                                              "n": pa.array(own.values(), pa.int64())})

    rows = labelled.filter(F.col(language_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(language_col).alias("language"), _letters(F.col(text_col)).alias("text"))
    # one row per task, language and run: an alphabet's runs, however many texts there are
    total = rows.mapInArrow(count, "language string, code long, n long").groupBy("language", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "code"))
    return total.withColumn("rank", place - 1).filter(F.col("rank") < top).select("language", "code", "rank")


def detected(df: DataFrame, profiles: DataFrame, *, text_col: str, top: int = TOP, into: str = "detected") -> DataFrame:
    """``df`` with the language of each text; null where it has too few letters, shares no run with any profile, or two fit alike.

    The profiles, ``top`` rows for each language, are held by every task.
    """
    table = profiles.toArrow().sort_by([("language", "ascending"), ("rank", "ascending")])
    languages, known = np.array(table["language"].to_pylist(), object), table["code"].to_numpy()
    names = sorted(set(languages.tolist()))
    sorted_ = []
    for name in names:
        own = known[languages == name]
        order = np.argsort(own)
        sorted_.append((own[order], order))

    def one(text: str | None) -> str | None:
        if text is None or len(text) - text.count("_") < MIN_LETTERS or not names:
            return None
        codes, counts = _runs(text)
        codes = codes[np.lexsort((codes, -counts))[:top]]
        ranks, distances, met = np.arange(len(codes)), [], False
        for own, order in sorted_:
            at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
            hit = own[at] == codes
            met |= bool(hit.any())
            distances.append(int(np.where(hit, np.abs(order[at] - ranks), top).sum()))
        best = min(distances)
        return names[distances.index(best)] if met and distances.count(best) == 1 else None

    columns = df.columns

    def detect(batches):
        for batch in batches:
            found = [one(text) for text in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=[*columns, into])

    schema = df.select("*", F.lit(None).cast("string").alias(into)).schema
    return df.select("*", _letters(F.col(text_col)).alias("_letters")).mapInArrow(detect, schema)


def in_language(df: DataFrame, profiles: DataFrame, language: str, *, text_col: str) -> DataFrame:
    """Rows whose text is in the language; undetectable texts are rejected."""
    return detected(df, profiles, text_col=text_col, into="_detected").filter(F.col("_detected") == language).drop("_detected")
