"""Language identification as a mixture of languages.

Each learned language is a distribution over hashed byte trigrams. Expectation-maximisation estimates in which
proportions the languages of a set produced the trigrams of a text. The set starts with the likeliest single language
and grows by the language that raises the likelihood most, as long as that outweighs a penalty per language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tablewarden.llm.common import without

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Log-likelihood that one more language must gain per log of the number of trigrams. Trigrams overlap, so they count
#: about three times as much as independent draws.
PENALTY = 3.0
ROUNDS = 30
UNKNOWN = "und"

#: Bytes held at a time while counting a long text.
STEP = 1 << 20

_LETTER = re.compile(r"[^\W\d_]").search
# ASCII letters in lower case; every other ASCII byte is a space.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of a text and how often each occurs."""
    raw = np.frombuffer(f" {text} ".encode(), np.uint8)
    total = None
    for at in range(0, max(1, len(raw) - 2), STEP):
        b = _FOLD[raw[at : at + STEP + 2]]
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        code = code[(b[:-2] != 32) | (b[1:-1] != 32)]  # runs of blanks say nothing
        bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
        if len(raw) <= STEP:
            return np.unique(bucket, return_counts=True)
        counts = np.bincount(bucket, minlength=BUCKETS)
        total = counts if total is None else total + counts
    found = np.flatnonzero(total)
    return found, total[found]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (languages x buckets), from all rows with a text and a language."""
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                bucket, n = trigrams(text)
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[bucket] += n
        for lang, total in sums.items():
            bucket = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bucket)), pa.array(bucket, pa.int32()), pa.array(total[bucket], pa.int64())], ["lang", "bucket", "n"]
            )

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    place = {lang: i for i, lang in enumerate(langs)}
    model = np.full((len(langs), BUCKETS), SMOOTHING)
    where = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    model[where, table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    return langs, model / model.sum(axis=1, keepdims=True) if langs else model


def _proportions(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """EM for the shares of the columns of ``p``; also the log-likelihood."""
    last = -np.inf
    for _ in range(ROUNDS):
        mixed = p @ share
        like = float(n @ np.log(mixed))
        share = share * ((n / mixed) @ p) / n.sum()
        if like - last < 1e-4 * abs(like) / len(n):
            break
        last = like
    return share, like


def mixture(bucket: np.ndarray, n: np.ndarray, model: np.ndarray, penalty: float = PENALTY) -> dict[int, float]:
    """Shares of the chosen languages (by index) for one text's trigrams."""
    p = model[:, bucket].T
    n = n.astype(float)
    single = n @ np.log(p)
    chosen = [int(single.argmax())]
    share, like = np.ones(1), float(single.max())
    price = penalty * np.log(max(n.sum(), 2.0))
    while len(chosen) < len(model):
        # A language can only help if its likelihood ratio to the present mixture is above 1 on average.
        gain = (n / (p[:, chosen] @ share)) @ p / n.sum()
        gain[chosen] = 0.0
        best = int(gain.argmax())
        if gain[best] <= 1.0:
            break
        start = np.append(share * 0.8, 0.2)
        new_share, new_like = _proportions(p[:, [*chosen, best]], n, start)
        if new_like - like <= price:
            break
        chosen, share, like = [*chosen, best], new_share, new_like
    return dict(zip(chosen, (share / share.sum()).tolist()))


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``languages`` (array of ``lang, share``, largest share first), ``lang_pred`` and ``score`` (its share).

    A null text, one without a letter, or any text where nothing was learned is ``und`` with no languages and score 0.
    Shares that tie go by name. Columns with the new names are replaced; others and repeated rows stay.
    """
    docs = without(docs, "languages", "lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast((langs, model))
    shares = ArrayType(StructType([StructField("lang", StringType()), StructField("share", DoubleType())]))
    schema = StructType([*docs.schema.fields, StructField("languages", shares)])
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = sent.value
        for batch in batches:
            found = []
            for text in batch.column(text_col):
                text = text.as_py()
                if not names or text is None or not _LETTER(text):
                    found.append([])
                    continue
                parts = mixture(*trigrams(text), known)
                found.append([{"lang": names[i], "share": s} for i, s in sorted(parts.items(), key=lambda x: (-x[1], names[x[0]]))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], schema.names)

    first = F.get("languages", F.lit(0))
    return docs.mapInArrow(emit, schema).withColumns(
        {"lang_pred": F.coalesce(first["lang"], F.lit(UNKNOWN)), "score": F.coalesce(first["share"], F.lit(0.0))}
    )


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: CRC-32 of its id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))
