"""Language identification by compression: a text belongs to the language whose raw-content dictionary
lets zstandard encode it smallest. Narrow margins and texts without a letter are rejected."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, sampled

#: Documents per language, those with the smallest hash of the key, and bytes of text kept of them.
SAMPLE = 96
DICTIONARY_BYTES = 64_000
LEVEL = 9
#: Smaller relative margins between the best and the next language are rejected.
MARGIN = 0.002


def fit(docs: DataFrame, train: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each label: the starts of the lower-cased texts of the sample, as much of each
    as lets all of them share ``size`` bytes; what short ones leave goes to the longer ones, eight times an
    equal share at most.

    ``sample`` and ``size`` bound what is read to the driver for each label. Null labels and texts
    teach nothing, rows that repeat key and text teach once; an empty table gives no dictionary.
    """
    rows = docs if train is None else docs.where(train)
    rows = sampled(rows, key, text, lang, sample).select("lang", "hash", F.substring("text", 1, 8 * size // sample).alias("text"))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows.collect()):
        texts.setdefault(r.lang, []).append(r.text.lower().encode())
    return {x: b"\n".join(_shared_out(ts, size)) for x, ts in sorted(texts.items())}


def _shared_out(texts: list[bytes], size: int) -> list[bytes]:
    """Starts of the texts, of one length but for shorter ones, that take ``size`` bytes at most with a byte between."""
    left, length = size - len(texts), 0
    for i, n in enumerate(sorted(map(len, texts))):
        length = max(0, left) // (len(texts) - i)
        if n > length:
            break
        left, length = left - n, n
    return [t[:length] for t in texts]


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.coders = []
        for x in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[x] + b"\0" * max(0, 8 - len(dictionaries[x])), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the margin in [0, 1]; the first of equals; ``und`` without a letter. A single language has its
        margin over the plain bytes, 0 where it makes them no shorter."""
        if not text or not self.coders or not any(map(str.isalpha, text)):
            return "und", 0.0
        data = text.lower().encode()
        sizes = [code(data) for code in self.coders]
        sizes = [len(x) for x in sizes]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=len(data) + 8)
        return self.langs[best], max(0.0, (second - sizes[best]) / max(second, 1))


def identified(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns and the predicted language and score of every whole text, in place of columns of these names.

    A null text or one without a letter gets ``und`` and 0, as does every text without a dictionary. Labels are
    no input. Of languages that tie the first by name is chosen, with score 0. Rows that repeat get the same;
    an empty table gives an empty one.
    """
    docs = docs.drop(*({lang, score} - {text}))
    names = docs.columns
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded: DICTIONARY_BYTES for each label

    def run(batches):
        forget()
        classifier = Classifier(shared.value)
        for batch in batches:
            got = [classifier.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, lang, score])

    schema = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, text: str = "text") -> DataFrame:
    """The documents whose language is told by a margin; all columns as they were. Null texts, those without a
    letter and ties go, and all go where there is no dictionary."""
    lang, score = fresh("_lang", docs), fresh("_score", docs)
    return identified(docs, dictionaries, text, lang, score).where(told(lang, score, margin)).select(docs.columns)


def told(lang: str, score: str, margin: float = MARGIN) -> Column:
    """Whether a language is known by a margin."""
    return (F.col(lang) != "und") & (F.col(score) >= margin)
