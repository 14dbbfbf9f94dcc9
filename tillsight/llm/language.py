"""Language identification by multilingual mixture inference.

Model: for each language a multinomial over hashed byte 3-grams inside words and
at their ends, counted over all training texts, with additive smoothing.

Inference, per document: a word's likelihood in a language is that of its
3-grams. The document's words are a mixture of languages; expectation
maximisation finds the proportions. The set of languages is selected by
penalised likelihood: sets grow by the languages in order of their
proportions, each is fitted again, and each further language must raise the
log-likelihood by more than ``penalty`` times the logarithm of the number of words.
The prediction is the language with the largest share in the selected set, the
score its share in the mixture of all languages.

Scale: each task counts in arrays of (languages x ``cells``), whose sums by
(language, cell) are all that is shuffled and, as the model, all that reaches the
driver and is broadcast; ``most_bytes`` bounds it. Inference is one pass.

Defined cases: a null text or one without letters: ``und``, score 0, empty
lists; letters without any word of the model's alphabet cannot occur, as every
letter is part of a word; no training texts: all ``und``; repeated rows are
rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import batches_of, ship, text_bytes

UNKNOWN = "und"
#: Bytes that are part of a word: ASCII letters and all of other characters' bytes; others become spaces.
_WORD = np.array([i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256)], np.uint8)


def grams(texts: list, cells: int):
    """Of lower-cased texts: the cell of the 3-gram at each place of their joined
    bytes, starts and ends of words, and the number of words of each text."""
    a = _WORD[np.frombuffer(b" " + b" ".join(texts).lower() + b"  ", np.uint8)]
    wide = a.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - cells.bit_length() + 1)
    edge = np.flatnonzero(np.diff(a == 32)) + 1
    start, end = edge[::2], edge[1::2]
    offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
    return code, start, end, np.diff(np.searchsorted(start, offsets))


@dataclass
class Model:
    languages: list   # in code point order
    logs: np.ndarray  # (languages, cells), float64


def fit(docs: DataFrame, use: Column, cells: int = 1 << 16, smoothing: float = 0.5, most_bytes: int = 1 << 28,
        text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count 3-grams of the rows that ``use`` picks and whose language is not null."""
    part = ship(docs).where(use & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        import pyarrow as pa
        sums: dict = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in batches_of(texts, 1 << 20):
                code, start, end, n = grams(texts[a:b], cells)
                which = np.repeat(np.arange(b - a), n)
                inside = np.zeros(len(code) + 1, np.int32)  # a word's 3-grams: from the space before it to the one behind
                np.add.at(inside, start - 1, 1)
                np.add.at(inside, end - 1, -1)
                inside = np.cumsum(inside)[:-1] > 0
                langs = sorted(set(names[a:b]))
                of_text = np.array([langs.index(x) for x in names[a:b]])
                at = np.flatnonzero(inside)
                text_of_place = which[np.searchsorted(start - 1, at, "right") - 1] if len(at) else at
                cell = of_text[text_of_place] * cells + code[at] if len(at) else at
                found = np.bincount(cell, minlength=len(langs) * cells).reshape(len(langs), cells)
                for lang, row in zip(langs, found):
                    sums[lang] = sums.get(lang, 0) + row
        for lang in sorted(sums):
            cell = np.flatnonzero(sums[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell, pa.int32()),
                                              pa.array(sums[lang][cell], pa.int64())], names=["lang", "cell", "n"])

    counted = part.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most languages x cells rows
    names, cell, n = (found.column(c).to_numpy() for c in ("lang", "cell", "n"))
    languages = sorted(set(names.tolist()))
    if len(languages) * cells * 8 > most_bytes:
        raise ValueError(f"{len(languages)} languages x {cells} cells exceed the model's bound of {most_bytes} bytes")
    table = np.full((len(languages), cells), smoothing)
    table[np.searchsorted(np.array(languages, object), names) if len(names) else [], cell] += n
    return Model(languages, np.log(table / table.sum(1, keepdims=True)) if len(languages) else table)


def mixture(ratio: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions (texts x languages) by expectation maximisation.
    ratio: (words, languages), likelihoods relative to each word's largest;
    n: words of each text, all above 0; share: where to start, 0 stays 0."""
    heads, which = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    for _ in range(rounds):
        belief = ratio * share[which]
        belief /= np.maximum(belief.sum(1, keepdims=True), 1e-300)
        share = np.add.reduceat(belief, heads, axis=0) / n[:, None]
    return share


def log_likelihood(ratio: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of each text, less the sum of its words' largest log-likelihoods."""
    each = (ratio * np.repeat(share, n, axis=0)).sum(1)
    return np.add.reduceat(np.log(np.maximum(each, 1e-300)), np.cumsum(n) - n)


def infer(ratio: np.ndarray, logs: np.ndarray, n: np.ndarray, rounds: int, penalty: float):
    """Shares in the selected set and in the mixture of all languages (texts x languages).
    logs: log-likelihood of each whole text in each single language, on the same base as ``ratio``."""
    count = ratio.shape[1]
    everything = mixture(ratio, n, np.full((len(n), count), 1 / count), rounds)
    order = np.argsort(-everything, axis=1, kind="stable")
    single = logs.argmax(1)
    best, value = np.eye(count)[single], logs.max(1)
    # No set explains a text better than all languages together: where even those do not pay for one more, one it is.
    open_ = np.flatnonzero(log_likelihood(ratio, n, everything) - penalty * np.log(n + 1) > value)
    words = np.repeat(np.arange(len(n)), n)
    for size in range(2, count + 1):
        if not len(open_):
            break
        keep = np.zeros((len(n), count))
        np.put_along_axis(keep, order[:, :size], 1, 1)
        mine = np.isin(words, open_) if len(open_) < len(n) else slice(None)
        start = keep[open_] * np.maximum(everything[open_], 1e-9)
        part, m = ratio[mine], n[open_]
        share = mixture(part, m, start / start.sum(1, keepdims=True), rounds)
        worth = log_likelihood(part, m, share) - penalty * (size - 1) * np.log(m + 1)
        better = worth > value[open_]
        best[open_[better]], value[open_[better]] = share[better], worth[better]
    return best, everything


def predict(docs: DataFrame, model: Model, rounds: int = 8, penalty: float = 2.0, keep: tuple = (),
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the ``keep`` columns, lang_pred, score, languages, shares (of the selected set, largest first)."""
    part = ship(docs).select(F.struct(id_col, *keep).alias("row"), F.col(text_col).cast("string").alias("text"))
    part = part.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kind = part.schema["row"].dataType.simpleString()
    languages, cells = model.languages, model.logs.shape[1] if len(model.languages) else 1 << 16
    shared = docs.sparkSession.sparkContext.broadcast(model.logs)

    def run(batches):
        import pyarrow as pa
        logs = np.ascontiguousarray(shared.value)
        for batch in batches:
            texts, letters = text_bytes(batch.column(1)), batch.column(2).to_pylist()
            out = [(UNKNOWN, 0.0, [], [])] * len(texts)
            for a, b in batches_of(texts, 1 << 20):
                use = [i for i in range(a, b) if letters[i]] if languages else []
                if not use:
                    continue
                code, start, end, n = grams([texts[i] for i in use], cells)
                some = np.flatnonzero(n)
                each = np.empty((len(start), len(languages)))
                for k, row in enumerate(logs):
                    sums = np.concatenate([[0], np.cumsum(row[code])])
                    each[:, k] = sums[end - 1] - sums[start - 1]
                top = each.max(1)
                each -= top[:, None]
                if not len(some):
                    continue
                whole = np.add.reduceat(each, np.cumsum(n[some]) - n[some], axis=0)
                best, everything = infer(np.exp(each), whole, n[some], rounds, penalty)
                for t, share, mix in zip(some.tolist(), best, everything):
                    order = [k for k in np.argsort(-share, kind="stable").tolist() if share[k] > 0]
                    out[use[t]] = (languages[order[0]], min(1.0, float(mix[order[0]])), [languages[k] for k in order], [float(share[k]) for k in order])
            cols = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                             names=["row", "lang_pred", "score", "languages", "shares"])

    done = part.mapInArrow(run, f"row {kind}, lang_pred string, score double, languages array<string>, shares array<double>")
    return done.select("row.*", "lang_pred", "score", "languages", "shares")
