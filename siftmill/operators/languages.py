"""The language of a text by character n-grams: profiles are learned by an aggregation and looked up where the texts are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

#: Letters of a gram, grams that a language's profile holds, and the characters below which a text tells nothing.
GRAM, PROFILE, LEAST = 3, 2_000, 40
#: Languages that profiles may hold: with it they are bounded, and can go to every task.
MOST_LANGUAGES = 1_000
#: Grams that a task holds before it adds them up: a batch of texts may have many times as many.
HELD_GRAMS = 1 << 20
UNKNOWN = "unknown"
_LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
_BITS = 21


def gram_codes(text: str) -> np.ndarray:
    """The n-grams of a whole text in lower case as numbers; what is no letter is one border between words, at both ends too."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    points = np.where(_LETTERS[points], points, 32)
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
    if len(points) < GRAM:
        return points[:0]
    return sum((points[k : len(points) - GRAM + 1 + k] << (_BITS * (GRAM - 1 - k)) for k in range(GRAM)), np.zeros(len(points) - GRAM + 1, dtype=np.int64))


def written(code: int) -> str:
    return "".join(chr(code >> (_BITS * (GRAM - 1 - k)) & ((1 << _BITS) - 1)) for k in range(GRAM))


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = PROFILE) -> DataFrame:
    """The most frequent grams of each language: lang, gram, n, and total, the grams of the language.

    Rows without a language or a text teach nothing. Equal counts go by the gram. Tasks count before anything moves, and
    a language's grams are ranked in parts before they are ranked together.
    """

    def counted(by_language: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for name, found in by_language.items():
            codes, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array([written(c) for c in codes.tolist()], pa.string()), pa.array(n)], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_language, held = {}, 0
            for text_, lang_ in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                codes = gram_codes(text_.as_py())
                by_language.setdefault(lang_, []).append(codes)
                held += len(codes)
                if held >= HELD_GRAMS:
                    yield from counted(by_language)
                    by_language, held = {}, 0
            yield from counted(by_language)

    taught = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = taught.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.col("gram")]
    share = F.pmod(F.xxhash64("gram"), F.lit(16))
    parts = counts.withColumns({"at": F.row_number().over(Window.partitionBy("lang", share).orderBy(*order)), "share": share})
    total = parts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = parts.filter(F.col("at") <= most).drop("at", "share").withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("at") <= most)
    return kept.join(total, "lang").select("lang", "gram", "n", "total")


def detector(known: DataFrame):
    """A function from a column of texts to their languages, from profiles of at most MOST_LANGUAGES languages.

    A language's likelihood adds up the logarithms of the shares of a text's grams; a gram that its profile does not hold
    counts half an occurrence. The greatest one wins, of equal ones the first language. Texts of under 40 characters
    without their outer blanks, texts without a letter and nulls are ``unknown``; so is every text where nothing is known.
    """
    rows = known.select("lang", "gram", "n", "total").toPandas()
    langs = sorted(rows["lang"].unique())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"profiles of {len(langs)} languages; at most {MOST_LANGUAGES} are held in every task")
    code = np.array([sum(ord(c) << (_BITS * (GRAM - 1 - k)) for k, c in enumerate(g)) for g in rows["gram"]], dtype=np.int64)
    keys, place = np.unique(code, return_inverse=True)
    lang_of = np.searchsorted(langs, rows["lang"]) if langs else np.zeros(0, dtype=np.int64)
    floor = np.array([np.log(0.5 / rows["total"][rows["lang"] == x].iloc[0]) for x in langs])
    weights = np.tile(floor, (len(keys) + 1, 1))  # the last row is that of unseen grams
    weights[place, lang_of] = np.log(rows["n"].to_numpy() / rows["total"].to_numpy())

    @pandas_udf("string")
    def detect(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = gram_codes(text) if langs and isinstance(text, str) and len(text.strip(" ")) >= LEAST else np.zeros(0, dtype=np.int64)
            if not len(found) or not _LETTERS[[ord(c) for c in set(text)]].any():
                out.append(UNKNOWN)
                continue
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            at = np.where(keys[at] == found, at, len(keys))
            out.append(langs[int(np.round(np.bincount(at, minlength=len(keys) + 1) @ weights, 6).argmax())])
        return pd.Series(out, dtype=object)

    return detect


def windows(text: Column, size: int = 180) -> Column:
    """A whole text in consecutive stretches of so many characters; the last may be shorter."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0))), lambda k: F.substr(text, k * size + 1, F.lit(size)))


def sql_detected(taught: str, asked: str) -> str:
    """The same as DuckDB SQL: common tables ``taught`` (lang, text) and ``asked`` (id, text) to a table detected (id, lang)."""
    grams = lambda t: f"list_transform(range(1, length(f) - {GRAM - 2}), lambda k: substr(f, k, {GRAM})) AS g FROM (SELECT *, regexp_replace(' ' || lower(text) || ' ', '[^\\p{{L}}]+', ' ', 'g') AS f FROM {t})"
    return f"""taught_grams AS (SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest(g) AS gram FROM (SELECT lang, {grams(f"({taught})")})) GROUP BY ALL),
    profile AS (SELECT lang, gram, n, total FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM taught_grams) WHERE place <= {PROFILE}),
    floors AS (SELECT lang, max(total) AS total FROM profile GROUP BY lang),
    asked_grams AS (SELECT id, gram, count(*) AS n FROM (SELECT id, unnest(g) AS gram FROM (SELECT id, {grams(f"({asked})")} WHERE length(trim(text, ' ')) >= {LEAST} AND regexp_matches(text, '\\p{{L}}'))) GROUP BY ALL),
    scores AS (SELECT a.id, f.lang, sum(a.n * coalesce(ln(p.n / p.total), ln(0.5 / f.total))) AS score FROM asked_grams a CROSS JOIN floors f LEFT JOIN profile p ON p.lang = f.lang AND p.gram = a.gram GROUP BY a.id, f.lang),
    detected AS (SELECT id, lang FROM scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, lang) = 1)"""
