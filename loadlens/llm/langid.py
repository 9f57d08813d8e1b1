"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of characters that are no letters becomes one space,
and all n-grams of one to three characters are counted in ``2 ** bits`` hashed buckets.
The log-probability matrix (buckets x languages, at most ``max_languages``) is
broadcast; scoring gathers its rows for a block of texts and sums them per text.

The classifier is fitted on at most about ``max_rows`` labelled rows of each language,
chosen by a hash of the id; class priors come from all labelled rows.

Edge cases: a text that is null or has no letter gets ``und`` with score 0, as does
every text when no labelled row exists; rows without label or id hash are never
learned from but are scored; ties go to the language first in the alphabet; extra
columns are ignored and repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BITS = 16
MAX_ROWS = 20_000
MAX_LANGUAGES = 64
ORDERS = (1, 2, 3)
SLICE = 1 << 18  # characters worked on at once
_MIX = (np.uint32(2654435761), np.uint32(2246822519))


@dataclass(frozen=True)
class Model:
    """Row i of ``weights`` has the log-probabilities of bucket i in each language."""

    languages: tuple[str, ...]
    priors: np.ndarray
    weights: np.ndarray
    bits: int = BITS


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased letters with one space around every run of them."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, np.uint32(32))
    space = codes == 32
    return codes[~(space & np.concatenate(([False], space[:-1])))]


def buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram starting at each position that has one."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    mixed = np.full(n, np.uint32(order * 3266489917 & 0xFFFFFFFF))
    for k in range(order):
        mixed = (mixed ^ codes[k : k + n]) * _MIX[k % 2]
        mixed ^= mixed >> np.uint32(15)
    return mixed >> np.uint32(32 - bits)


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Buckets of some texts, or of a part of a long one, with the text and start of each run of them."""
    pending, starts, size = [], [], 0
    for number, text in enumerate(texts):
        codes = letters_only(text)
        for begin in range(0, len(codes), SLICE):
            part = codes[begin : begin + SLICE + max(ORDERS) - 1]
            for order in ORDERS:
                # n-grams that start in this slice; their last characters may lie in the next one
                own = buckets(part[: SLICE + order - 1], order, BITS)
                if len(own):
                    pending.append(own)
                    starts.append((number, size))
                    size += len(own)
            if size >= SLICE:
                yield np.concatenate(pending), starts
                pending, starts, size = [], [], 0
    if pending:
        yield np.concatenate(pending), starts


def score_texts(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Index of the most probable language of every text, and its posterior probability."""
    totals = np.tile(model.priors, (len(texts), 1))
    for rows, starts in blocks(texts):
        sums = np.add.reduceat(model.weights[rows], [s for _, s in starts], axis=0)
        np.add.at(totals, [n for n, _ in starts], sums)
    best = totals.argmax(axis=1)
    share = np.exp(totals - totals[np.arange(len(texts)), best][:, None]).sum(axis=1)
    return best, 1.0 / share


def train(
    labelled: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    max_rows: int = MAX_ROWS,
    max_languages: int = MAX_LANGUAGES,
    smoothing: float = 0.1,
) -> Model:
    rows = labelled.select(
        F.col(text).alias("text"), F.col(label).alias("label"), F.col(key).alias("key")
    ).where("label IS NOT NULL")
    # one row per language, and no more languages than the model may have
    counted = rows.groupBy("label").count().limit(max_languages + 1).collect()
    if len(counted) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = dict(sorted((r["label"], r["count"]) for r in counted))
    names = tuple(counts)
    if not names:
        return Model((), np.empty(0), np.empty((1 << BITS, 0)))
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, max_rows / counts[n]))])
    number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    kept = rows.where(
        F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) < share[F.col("label")] * float(1 << 30)
    ).select("text", number[F.col("label")].alias("number"))
    languages = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(languages << BITS, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            numbers = batch.column(1).to_numpy()
            for rows, starts in blocks(texts):
                ends = [s for _, s in starts[1:]] + [len(rows)]
                label = np.repeat(numbers[[n for n, _ in starts]], np.diff([0, *ends]))
                own += np.bincount(rows + (label.astype(np.int64) << BITS), minlength=len(own))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["cell", "n"])

    # at most 2 ** BITS cells a language
    cells = kept.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(languages << BITS)
    n[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    n = n.reshape(languages, -1) + smoothing
    weights = np.log(n / n.sum(axis=1, keepdims=True)).T
    total = sum(counts.values())
    priors = np.log([counts[x] / total for x in names])
    return Model(names, priors, np.ascontiguousarray(weights))


def predict(documents: DataFrame, model: Model, text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = documents.select(*keep, F.when(has_letter, F.col(text)).alias("__text"))
    kinds = "".join(f"`{name}` {kind}, " for name, kind in rows.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], object)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                known = [i for i, t in enumerate(texts) if t is not None] if model.languages else []
                best = np.full(len(texts), len(model.languages))
                score = np.zeros(len(texts))
                if known:
                    best[known], score[known] = score_texts([texts[i] for i in known], model)
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                columns += [pa.array(names[best].tolist(), pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, f"{kinds}lang_pred string, score double")
