"""Language identification by string kernels.

Two texts are compared by the blended-spectrum presence kernel: the number of
distinct letter n-grams (all lengths from 1 to ``LONGEST``) that both have,
over the geometric mean of the numbers that each has. N-grams are hashed to
``WIDTH`` places. Kernel ridge regression, one language versus the rest, is
fitted on the Nystroem features of landmark texts: with K the landmarks' kernel
matrix and k(x) the kernels of x with the landmarks, a text's features are
K^(-1/2) k(x).

The presence kernel is an inner product of the texts' presence vectors, so the
landmarks, K^(-1/2) and the regression weights multiply into one matrix of
places x languages after the fit. Texts are then scored in batches by a sparse
product with it: presence (texts x places) times matrix, divided by the texts'
norms. That is the same number as scoring against every landmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.session import added, table, tidy

#: Hash places, longest n-gram.
WIDTH, LONGEST = 1 << 15, 4
#: Bounds of the fit: training rows and landmarks in total (shared evenly by the languages), languages.
TRAIN_ROWS, LANDMARKS, LANGUAGES = 4000, 256, 1000
RIDGE = 0.1
#: Characters worked off at a time: long texts don't need more memory than this many numbers a few times over.
CHARS = 1 << 20


def _letters() -> np.ndarray:
    """For each code point below 2**16 its lower-case form if it is a letter, else 0."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()[0])
    return out


LETTERS = _letters()


def codes(text: str, before: np.ndarray, ends: bool) -> np.ndarray:
    """``before``, then the text's letters in lower case, runs of anything else as a single 0; a 0 behind if the text ``ends``."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = LETTERS[np.minimum(raw, 0xFFFF)]
    for i in np.flatnonzero(raw > 0xFFFF):
        c = chr(raw[i])
        low[i] = ord(c.lower()[0]) if c.isalpha() else 0
    c = np.concatenate([before, low, np.zeros(int(ends), np.uint32)]).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    return c[keep]


def presence(text: str, width: int = WIDTH) -> np.ndarray | None:
    """The places of the text's n-grams, ascending; None if it has no letter. A text begins and ends with a 0."""
    flags = np.zeros(width, bool)
    any_letter, tail = False, np.zeros(1, np.uint64)
    for a in range(0, max(len(text), 1), CHARS):
        c = codes(text[a : a + CHARS], tail, a + CHARS >= len(text))
        tail = c[-LONGEST:]
        any_letter = any_letter or bool(c.any())
        h = np.zeros(len(c), np.uint64)
        for n in range(1, min(LONGEST, len(c)) + 1):
            h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            flags[(h >> np.uint64(20)) & np.uint64(width - 1)] = True
    return np.flatnonzero(flags) if any_letter else None


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # places x languages

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Regression values (texts x languages) of presence vectors."""
        if not rows:
            return np.zeros((0, len(self.languages)))
        starts = np.cumsum([0, *map(len, rows)])[:-1]
        sums = np.add.reduceat(self.weights[np.concatenate(rows)], starts, axis=0)
        return sums / np.sqrt([len(r) for r in rows])[:, None]


def fit(rows: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, width: int = WIDTH) -> Model:
    """Kernel ridge regression, one versus the rest, on Nystroem features of evenly drawn landmarks."""
    languages = sorted(set(labels))

    def dense(some: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(some), width), np.float32)
        for i, r in enumerate(some):
            x[i, r] = 1 / np.sqrt(len(r))
        return x

    by = {k: [i for i, y in enumerate(labels) if y == k] for k in languages}
    share = max(1, landmarks // max(1, len(languages)))
    marks = dense([rows[i] for k in languages for i in by[k][:share]])
    k = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # K^(-1/2) up to a rotation
    # a few rows at a time: the rows by places are never held at once
    phi = np.concatenate([(dense(rows[a : a + 128]) @ marks.T).astype(np.float64) @ root for a in range(0, len(rows), 128)])
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # languages with few rows weigh as much as the others
    w = np.array([len(labels) / (len(languages) * len(by[v])) for v in labels])
    gram = phi.T @ (phi * w[:, None]) + ridge * np.eye(phi.shape[1])
    beta = np.linalg.solve(gram, phi.T @ (y * w[:, None]))
    return Model(languages, marks.T @ (root @ beta).astype(np.float32))


def draw(docs: DataFrame, learn: Column, id_col: str, text: str, lang: str, rows: int = TRAIN_ROWS) -> tuple[list[np.ndarray], list[str]]:
    """Presence vectors and labels of up to ``rows`` labelled documents, evenly by language, by hash of id and text length.

    Of more than ``LANGUAGES`` labels the most frequent ones are learned.
    Vectors are made on the executors, so what the driver gets is bounded whatever the texts' lengths.
    """
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), (F.pmod(F.xxhash64(F.col(id_col), F.length(F.col(text))), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return [], []
    share = max(2, rows // len(counts))
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.1 * share / n))]), F.col("lang"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[list] = [[], [], []]
            for t, y, u in zip(b.column("text"), b.column("lang").to_pylist(), b.column("u").to_pylist(), strict=True):
                if (p := presence(t.as_py())) is not None:
                    flags = np.zeros(WIDTH, bool)
                    flags[p] = True
                    for c, v in zip(got, (y, u, np.packbits(flags).tobytes()), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.binary())], ["lang", "u", "bits"])

    got = known.where(F.col("lang").isin(list(counts)) & (F.col("u") < rate)).mapInArrow(run, "lang string, u double, bits binary").orderBy("u", "lang", "bits").limit(4 * rows).collect()
    xs, ys, taken = [], [], dict.fromkeys(counts, 0)
    for r in got:
        if taken[r["lang"]] < share:
            taken[r["lang"]] += 1
            xs.append(np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))))
            ys.append(r["lang"])
    return xs, ys


def predict(docs: DataFrame, model: Model | None, text: str = "text", into: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """Adds the language and its score (0 to 1), named by ``into``, to every row; ``und`` and 0 for null texts, texts without a letter, or no model.

    ``keep``: the columns to keep, all if not given; columns of the new names are
    replaced. The score is the winner's regression value, from -1..1 to 0..1.
    """

    def make(texts: pa.Array) -> list[pa.Array]:
        out, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        todo, rows = [], []

        def flush() -> None:
            if rows:
                f = model.score(rows)
                best = f.argmax(axis=1)
                out[todo] = np.array(model.languages, object)[best]
                score[todo] = np.clip((f[np.arange(len(best)), best] + 1) / 2, 0, 1)
                todo.clear()
                rows.clear()

        for i, t in enumerate(texts):
            if t.is_valid and model is not None and (p := presence(t.as_py())) is not None:
                todo.append(i)
                rows.append(p)
                if len(rows) == 256:
                    flush()
        flush()
        return [pa.array(out, pa.string()), pa.array(score, pa.float64())]

    return added(docs, f"`{into[0]}` string, `{into[1]}` double", make, [text], keep)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the labelled documents that are not held out; None if there are none. Rows with a null id are not learned from."""
    xs, ys = draw(docs, F.col(id_col).isNotNull() & ~held_out(id_col), id_col, text, lang)
    return fit(xs, ys) if xs else None


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return predict(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
