"""A4 language identification (trigram rank-order profiles, Cavnar & Trenkle
1994 "N-Gram-Based Text Categorization") and P32 dictionary translation.

train_profiles: trigrams of labelled text, counted by language in each task
and summed on Spark, the top 300 per language (WindowGroupLimit).
detect_language: each text's own top-300 trigrams against the profiles,
score = sum of (300 - |rank difference|) over shared trigrams; the highest
score wins (ties: smaller code).  Texts under 10 characters, or sharing no
trigram with any profile, are ``und``.  Every text is read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.sources.tables import spread


# Fixed values.
PROFILE_SIZE = 300
MIN_LENGTH = 10
UNDETERMINED = "und"
ISO639_3 = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa"}
MAX_LANGUAGES = 500
TABLE_ROWS = 500_000            # a task sends its counts on beyond so many
NON_LETTERS = r"[^\p{L}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trigram_source(text) -> Column:
    """' ' + lower-cased letters with every other run as one space + ' '."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(_col(text)), NON_LETTERS, " "), F.lit(" "))


def _counts(source: str | None) -> Counter:
    """Overlapping trigrams of a prepared text, without those across two spaces."""
    s = source or ""
    out = Counter(zip(s, s[1:], s[2:]))
    for g in [g for g in out if g[1] == " " and (g[0] == " " or g[2] == " ")]:
        del out[g]
    return out


DENSE = 1 << 24                 # cells of a table of counts, for small alphabets


def _corpus_counts(sources: list[str]) -> Counter:
    """The sum of :func:`_counts` over prepared texts.

    A prepared text begins and ends with a space, so trigrams across the border of two have two spaces beside each other
    and do not count: the texts are counted as one."""
    points = np.frombuffer("".join(sources).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < 3:
        return Counter()
    chars = np.flatnonzero(np.bincount(points))
    place = np.zeros(int(chars[-1]) + 1, np.int64)
    place[chars] = np.arange(len(chars))
    p, space, size = place[points], points == 32, len(chars)
    kept = ~(space[1:-1] & (space[:-2] | space[2:]))
    keys = ((p[:-2] * size + p[1:-1]) * size + p[2:])[kept]
    if size ** 3 <= DENSE:
        table = np.bincount(keys, minlength=1)
        keys = np.flatnonzero(table)
        n = table[keys]
    else:
        keys, n = np.unique(keys, return_counts=True)
    letters = [chr(c) for c in chars.tolist()]
    return Counter({(letters[k // size // size], letters[k // size % size], letters[k % size]): c for k, c in zip(keys.tolist(), n.tolist())})


def train_profiles(labelled: DataFrame, id_col: str, text_col: str, lang_col: str,
                   code_map: dict | None = ISO639_3, size: int = PROFILE_SIZE) -> DataFrame:
    """``(lang, gram, r)``: top ``size`` trigrams per language, r = 1..size.

    Each task counts its texts' trigrams by language and sends only the
    counts; the label goes along in the row, so nothing is joined."""
    lang = F.col(lang_col)
    if code_map:
        m = F.create_map(*[F.lit(x) for kv in code_map.items() for x in kv])
        lang = F.coalesce(F.element_at(m, lang), lang)

    def count(batches):
        total: dict[str, Counter] = {}
        held = 0

        def rows():
            flat = [(k, "".join(g), n) for k, c in total.items() for g, n in c.items()]
            cols = list(zip(*flat)) if flat else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                               pa.array(cols[2], pa.int64())], ["lang", "gram", "cnt"])

        for b in batches:
            texts: dict[str, list[str]] = {}
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(k, []).append(s or "")
            for k, sources in texts.items():
                total.setdefault(k, Counter()).update(_corpus_counts(sources))
            held = sum(map(len, total.values()))
            if held > TABLE_ROWS:
                yield rows()
                total.clear()
        yield rows()

    counts = (spread(labelled.where(F.col(id_col).isNotNull() & lang.isNotNull())
                     .select(lang.alias("lang"), trigram_source(text_col).alias("s")))
              .mapInArrow(count, "lang string, gram string, cnt long")
              .groupBy("lang", "gram").agg(F.sum("cnt").alias("cnt")))
    w = Window.partitionBy("lang").orderBy(F.col("cnt").desc(), F.col("gram").asc())
    return (counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size)
            .select("lang", "gram", "r"))


def detect_language(df: DataFrame, id_col: str, text_col: str, profiles: DataFrame,
                    size: int = PROFILE_SIZE, out_col: str = "lang_code") -> DataFrame:
    """``(id, lang_code)`` for every row of ``df``: one narrow pass, no shuffle.

    The profiles are read once (``MAX_LANGUAGES`` times ``size`` rows at most,
    checked) and sent to the tasks."""
    rows = profiles.limit(MAX_LANGUAGES * size + 1).collect()
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"profiles of more than {MAX_LANGUAGES} languages")
    ranks: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: r.lang):
        ranks.setdefault(tuple(r.gram), []).append((r.lang, r.r))
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def score(source, known):
        own = sorted(_counts(source).items(), key=lambda x: (-x[1], x[0]))[:size]
        total: dict[str, int] = {}
        for rd, (g, _) in enumerate(own, 1):
            for lang, r in known.get(g, ()):
                total[lang] = total.get(lang, 0) + size - abs(rd - r)
        return min(total, key=lambda k: (-total[k], k)) if total else UNDETERMINED

    def run(batches):
        known = shared.value
        for b in batches:
            out = [UNDETERMINED if n is None or n < MIN_LENGTH else score(s, known)
                   for s, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [id_col, out_col])

    src = spread(df.select(F.col(id_col), F.col(text_col).alias("_t"))).select(
        id_col, trigram_source("_t").alias("_s"), F.length("_t").alias("_n"))
    return src.mapInArrow(run, src.select(id_col).schema.add(out_col, "string"))


# The literal word dictionary used on fixtures (lower-case source
# word -> English).
FIXTURE_DICTIONARY = {"le": "the", "la": "the", "les": "the", "et": "and", "de": "of",
                      "der": "the", "die": "the", "und": "and", "el": "the", "y": "and"}


def translate_words(text, dictionary: dict) -> Column:
    """Space-separated words looked up lower-cased in a bounded dictionary
    (a literal map, no join), unknown words kept, order kept."""
    m = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
    return F.array_join(F.transform(F.split(_col(text), " "),
                                    lambda w: F.coalesce(F.element_at(m, F.lower(w)), w)), " ")


def translate_queries(df: DataFrame, text_col: str, lang_col: str, dictionary: dict,
                      out_col: str = "query") -> DataFrame:
    """Translate only when the detected language is neither English nor ``und``;
    a failed / absent translation falls back to the original text."""
    tr = translate_words(text_col, dictionary)
    cond = ~F.col(lang_col).isin("eng", UNDETERMINED)
    return df.withColumn(out_col, F.when(cond, F.coalesce(tr, F.col(text_col))).otherwise(F.col(text_col)))


def translate_with(df: DataFrame, text_col: str, lang_col: str, translate: Callable[[str], str], out_col: str = "query") -> DataFrame:
    """P32 / U2 with a translator of the user's, a function from text to text (Arrow batches).

    It is asked only for texts that are neither English nor ``und``; where it
    fails or gives None, the original text stays."""
    def one(text):
        try:
            return text if text is None else translate(text) or text
        except Exception:  # noqa: BLE001 -- a failed translation must not stop the query
            return text

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    wanted = ~F.col(lang_col).isin("eng", UNDETERMINED)
    return df.withColumn(out_col, F.coalesce(run(F.when(wanted, F.col(text_col))), F.col(text_col)))
