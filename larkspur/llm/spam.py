"""Keyword-stuffed and link-list pages, by block-wise compression.

A content is cut into blocks of ``BLOCK`` bytes, the last one taking in a rest of under ``LEAST_REST``. Two figures are
taken of each, both normalised by length and language:

* ``ratio``: the compressed size over that of prose of the same length in the same language. Repeated keywords stay far
  below 1; a list of distinct names comes near 1, as it repeats nothing.
* ``gain``: how much smaller the block becomes when the compressor knows ordinary prose of the language (``PRIMERS``).
  Prose gains from it whatever it is about, as its function words and endings are those of all prose; tags, names and
  links gain nothing.

Their weighted sum, with the density of sentence ends beyond the first, is the redundancy score. A low sum is confirmed by a low density of sentence ends, or by extreme
redundancy ("buy x! buy x! buy x!" is punctuated, but says nothing else).

Lengths and primers are known for English and Spanish. Pages of another script than Latin have no such curves; their
ratio is the compressed size over that of the same characters in scrambled order, which needs no knowledge of the language, and
only extreme redundancy is flagged there: lists of distinct names in those scripts are not judged. Sentence ends of all
scripts count. Prose in another Latin-script language gains nothing from the primers, so that its sentence ends decide;
without any, it is taken for a list.

One pass over the rows with Arrow batches; nothing is shuffled. Curves, primers and thresholds are parameters, the same
for tables of any size, so that a row's verdict depends on that row alone.

Defined results: null, empty and blank contents, and contents of under ``LEAST_WORDS`` words, which are too short for a
compressor to tell, score 0 and are no cases; repeated rows are each judged; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
LEAST_REST = 100
LEAST_WORDS = 12
GAIN_WEIGHT, ENDS_WEIGHT, MOST_ENDS = 4.0, 10.0, 0.05
LIMIT = 1.06
MOST_PUNCTUATION = 0.024
EXTREME = 0.55
LEAST_SIZE = 0.3
EXTREME_SCRAMBLED = 0.5
#: Function words by language (fixed values); they only choose the curve and the primer.
FUNCTION_WORDS = {
    "en": frozenset(
        "the of and to in a is that for with was were be by on at from as it not are this or an have has had but which than they who may "
        "when after before no so because if there we i you my your her his she he our their its into until while should can how do what".split()
    ),
    "es": frozenset(
        "de la el en y a los las por con una un del se al es su no lo que para como más o fue son sin sobre tras entre pero si está hay le ha "
        "desde hasta nos qué quienes cuando puede conviene cada otro".split()
    ),
}
#: Compressed share of prose blocks by language at the lengths of KNOTS (measured on unrepeated prose).
KNOTS = np.log([100, 200, 400, 700, 1024])
EXPECTED = {"en": np.array([0.913, 0.755, 0.651, 0.594, 0.560]), "es": np.array([0.916, 0.768, 0.663, 0.600, 0.558])}
#: Ordinary prose by language, for the compressor to know beforehand.
PRIMERS = {
    "en": " there is no way to be sure of it, and when they have not been able to do so, this can be one of the most common reasons for which it should not be used. if you are in "
    "any of these, or if it is not clear what to do, you may want to ask about it. some people who have had it say that they do not feel it at all, but in others it may come back after "
    "a while, and then it is best to talk to your doctor as soon as you can. most of them will get better on their own within a few weeks. it was found that those with the condition "
    "were more likely to have been given the treatment before the test, because of the risk that was seen in the first year. "
    "these changes are often small and may be caused by other things. patients who were older than this should have their blood taken at least once a year, and during the treatment they must "
    "not eat or drink for some hours. after the operation, the team will explain how to care for the wound and which signs show that something is wrong. although there are no studies "
    "that compare both, experts think that such an effect is rather rare. ",
    "es": " no hay que dejar de lado lo que se sabe de la enfermedad, ya que en la mayoría de los casos no es grave y se puede tratar con el tiempo. cuando no se sabe cuál es la causa, "
    "conviene hablar con el médico para que le diga qué se debe hacer y si hay que hacer una prueba. algunas personas que la han tenido dicen que no lo notan, pero en otras vuelve después "
    "de un tiempo, y por eso es importante que se lo cuente a su médico. entre los que la tienen, una de las razones más frecuentes por la que se pide es que no se sabe si la dosis es la adecuada. "
    "estos cambios suelen ser leves y pueden deberse a otras causas. los pacientes mayores de esta edad deben hacerse un análisis de sangre al menos una vez al año, y durante el tratamiento no "
    "pueden comer ni beber en unas horas. después de la operación, el equipo explica cómo cuidar la herida y qué signos indican que algo va mal. aunque no hay estudios que comparen ambos, "
    "los expertos creen que este efecto es más bien raro. ",
}
_PRIMED = {k: v.encode() for k, v in PRIMERS.items()}
_WORD = re.compile(r"[^\W\d_]+")
_AFTER = (" ", "\n", "\r", "\xa0")
#: Sentence ends that need no white space after them: CJK, Devanagari, Arabic, Urdu, Armenian, Ethiopic, Burmese, Khmer.
_ENDS = "。！？।॥؟۔։።။៖។"
_LATIN = re.compile(r"[A-Za-z\u00aa-\u024f\u1e00-\u1eff]")


@functools.lru_cache(maxsize=4)
def _expected(lang: str) -> list[float]:
    """The expected compressed size of a prose block of each length."""
    return [n * float(np.interp(np.log(max(n, 60)), KNOTS, EXPECTED[lang])) for n in range(BLOCK + LEAST_REST + 1)]


def sentence_ends(text: str) -> int:
    """Full stops, exclamation and question marks that white space or the end of the text follows, and those of other scripts."""
    own = 0 if text.isascii() else sum(map(text.count, _ENDS))
    return own + sum(text.count(p + a) for p in ".!?" for a in _AFTER) + text.endswith((".", "!", "?"))


def language(tokens: list[str]) -> str:
    en, es = (sum(map(FUNCTION_WORDS[k].__contains__, tokens)) for k in ("en", "es"))
    return "es" if es > en else "en"


def blocks(raw: bytes | str, size: int = BLOCK) -> Iterator[bytes | str]:
    at, n = 0, len(raw)
    while at < n:
        end = n if n - at - size < LEAST_REST else at + size
        yield raw[at:end]
        at = end


def _size(raw: bytes, primer: bytes = b"") -> int:
    c = zlib.compressobj(6, zlib.DEFLATED, -15, 8, 0, primer) if primer else zlib.compressobj(6, zlib.DEFLATED, -15)
    return len(c.compress(raw)) + len(c.flush())


def redundancy(raw: bytes, lang: str) -> tuple[float, float]:
    """Compressed size over that of prose, and the share of it that the language's primer saves, for all blocks together.
    A share of next to nothing says nothing, so it is taken of at least LEAST_SIZE of prose."""
    got = want = primed = 0.0
    expected, primer = _expected(lang), _PRIMED[lang]
    for part in blocks(raw):
        got += _size(part)
        primed += _size(part, primer)
        want += expected[len(part)]
    return (got / want, (got - primed) / max(got, LEAST_SIZE * want)) if want else (1.0, 0.0)


def scrambled_ratio(text: str) -> float:
    """Compressed size over that of the same characters in scrambled order, for all blocks of BLOCK / 2 characters."""
    got = want = 0
    for part in blocks(text, BLOCK // 2):
        order = np.random.default_rng(len(part)).permutation(len(part))
        got += _size(part.encode("utf-8", "replace"))
        want += _size("".join(part[i] for i in order).encode("utf-8", "replace"))
    return got / want if want else 1.0


def measure(text: str | None) -> tuple[float, float, float, int, bool]:
    """Normalised compressed size, gain, sentence ends per word, words, and whether the script has curves."""
    if not text:
        return 1.0, 0.0, 0.0, 0, True
    low = text.lower()
    tokens = _WORD.findall(low)
    if len(tokens) < LEAST_WORDS:
        return 1.0, 0.0, 0.0, len(tokens), True
    ends = sentence_ends(text) / len(tokens)
    if not text.isascii() and 2 * len(_LATIN.findall(text)) < sum(map(len, tokens)):
        return scrambled_ratio(text), 0.0, ends, len(tokens), False
    return *redundancy(low.encode("utf-8", "replace"), language(tokens)), ends, len(tokens), True


def judge(ratio: float, gain: float, ends: float, n: int, curved: bool) -> tuple[float, bool]:
    """Score (1 at the limit, more is worse) and whether it is a case."""
    if n < LEAST_WORDS:
        return 0.0, False
    if not curved:
        return 2.0 - ratio / EXTREME_SCRAMBLED, ratio < EXTREME_SCRAMBLED
    more = min(max(0.0, ends - 1 / n), MOST_ENDS)  # one sentence does not make a list prose
    score = 2.0 - (ratio + GAIN_WEIGHT * gain + ENDS_WEIGHT * more) / LIMIT
    return score, score > 1.0 and (ends < MOST_PUNCTUATION or ratio < EXTREME)


def verdict(text: str | None) -> tuple[float, bool]:
    return judge(*measure(text))


def score_pages(df: DataFrame, key: str = "hit_id", text: str = "content") -> DataFrame:
    """key, ratio, gain, sentence_ends, n_words, curved (whether the script has curves), score, is_spam for every row."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "ratio", "gain", "sentence_ends", "n_words", "curved", "score", "is_spam"]
    kinds = [pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [measure(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*(x + judge(*x) for x in m))) if m else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ratio double, gain double, sentence_ends double, n_words long, curved boolean, score double, is_spam boolean")


def find_spam(df: DataFrame, key: str = "hit_id", text: str = "content") -> DataFrame:
    return score_pages(df, key, text).where("is_spam").select(key)


def spam_by_source(df: DataFrame, key: str = "hit_id", text: str = "content", source: str = "source_domain") -> DataFrame:
    """Pages, cases and their share for each source (null is a source of its own)."""
    joined = df.select(F.struct(key, F.regexp_replace(F.lower(source), r"^www\.", "").alias("s")).alias("_k"), F.col(text).alias("_t"))
    scored = score_pages(joined, "_k", "_t")
    return scored.groupBy(F.col("_k.s").alias("source")).agg(F.count("*").alias("pages"), F.count_if("is_spam").alias("cases")).withColumn("share", F.col("cases") / F.col("pages"))
