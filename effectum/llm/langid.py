"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_schema, bounded, pieces

#: Hashed n-gram features; n-grams of the UTF-8 bytes of the lower-cased text, other bytes than letters taken as blanks.
FEATURES, NGRAMS = 2048, (1, 2, 3)
#: At most about so many labelled documents of each language are fitted on, chosen by a hash of their id.
SAMPLE = 800
#: Rows that a fit takes at most, whatever the number of languages: 8 KB each.
TOTAL = 20_000
#: Rounds and step of the gradient descent, and its penalty.
ROUNDS, STEP, PENALTY = 150, 8.0, 1e-4
#: A prediction is ambiguous if the two nearest codewords' scores differ by less.
AMBIGUOUS = 0.02

PREDICTED = "lang_pred string,score double,ambiguous boolean"
_LETTER = re.compile(r"[^\W\d_]")
_BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def vector(text: str) -> np.ndarray:
    """The square roots of n-gram frequencies, by hash, with unit length. Cost and memory follow the text; nothing is cut off."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_BLANKS) + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(FEATURES)
    for n in NGRAMS:
        code = np.full(max(len(b) - n + 1, 0), n, np.uint32)
        for k in range(n):
            code = code * np.uint32(257) + b[k : len(b) - n + 1 + k]
        code *= np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(32 - FEATURES.bit_length() + 1), minlength=FEATURES)
    out = np.sqrt(out)
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """A codeword of +-1 for each of k classes.

    Up to seven classes: all splits in two, each once. Beyond: of 200 drawn codes of 12 log2(k) bits, the one with the largest least distance.
    """
    if k <= 7:
        splits = [[1 if c == 0 or s >> (c - 1) & 1 else -1 for c in range(k)] for s in range(2 ** max(k - 1, 0) - 1)] or [[1] * k]
        return np.array(splits, np.float32).T
    rng, best, least = np.random.default_rng(0), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (k, 12 * k.bit_length()))
        d = ((code[:, None] != code[None]).sum(2) + np.eye(k) * 10**6).min()
        if d > least and (np.abs(code.sum(0)) < k).all():
            best, least = code, d
    return best.astype(np.float32)


@dataclass
class Model:
    """A classifier for each bit: weights, biases, and how much its loss counts."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """For rows of features: each language's share, from the weighted logistic losses against its codeword."""
        margins = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -self.code[None] * margins[:, None]) * self.trust).sum(2)
        e = np.exp(loss.min(1, keepdims=True) - loss)
        return e / e.sum(1, keepdims=True)


def fit_bits(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """Logistic regressions, one for each bit of the code, by gradient descent with momentum.

    Classes weigh alike, whatever their number of rows. A bit's trust falls with its error on the rows it was fitted on.
    """
    code = codewords(len(languages))
    target = code[y]
    share = 1 / np.bincount(y, minlength=len(languages))[y] / len(languages)
    w, c = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vc = np.zeros_like(w), np.zeros_like(c)
    for _ in range(ROUNDS):
        m = (x @ w + c) * target
        pull = (target / (1 + np.exp(np.clip(m, -30, 30))) * share[:, None]).astype(np.float32)
        vw = 0.9 * vw + STEP * (x.T @ pull - PENALTY * w)
        vc = 0.9 * vc + STEP * pull.sum(0)
        w, c = w + vw, c + vc
    error = (((x @ w + c) * target <= 0) * share[:, None]).sum(0)
    trust = np.maximum(1 - 2 * error, 0.01)
    return Model(languages, code, w, c, trust / trust.sum())


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        keep = [(lang, vector(t).tobytes()) for lang, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True) if _LETTER.search(t)]
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep]), pa.array([k[1] for k in keep], pa.binary())], ["lang", "x"])


def held_out(doc_id=None):
    """Documents that are never learnt from: crc32 of the id as text is divisible by 5. A null id isn't held out, nor learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from text and non-null lang of documents that aren't held out; None if there are none.

    The labelled rows of each language are counted; those whose id hashes below ``sample`` over that count are fitted on. Features
    are made where the rows are; the driver gets about ``sample`` vectors of one size for each language.
    """
    known = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.select("doc_id", "lang").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    sample = min(sample, max(1, TOTAL // len(counts)))
    ticket, chosen = F.pmod(F.xxhash64("doc_id"), F.lit(10**9)), F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (ticket < round(10**9 * sample / n)))
    rows = known.where(chosen).select("lang", "text").mapInArrow(_vectors, "lang string,x binary").toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    if not languages:
        return None
    place = {lang: i for i, lang in enumerate(languages)}
    found = sorted(zip([place[v] for v in rows["lang"].to_pylist()], rows["x"].to_pylist(), strict=True))
    return fit_bits(np.stack([np.frombuffer(b, np.float32) for _, b in found]), np.array([i for i, _ in found]), languages)


def _predict(model: Model | None, text_col: str):
    schema = arrow_schema(PREDICTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            got = batch[text_col].to_pylist()
            ok = [i for i, t in enumerate(got) if model is not None and t is not None and _LETTER.search(t)]
            lang, score, unsure = ["und"] * len(got), [0.0] * len(got), [False] * len(got)
            if ok:
                s = model.scores(np.stack([vector(got[i]) for i in ok]))
                order = np.sort(s, 1)
                for i, best, top, second in zip(ok, s.argmax(1), order[:, -1], order[:, -2] if s.shape[1] > 1 else order[:, -1] * 0, strict=True):
                    lang[i], score[i], unsure[i] = model.languages[best], min(1.0, float(top)), bool(top - second < AMBIGUOUS)
            added = [pa.array(x, t.type) for x, t in zip((lang, score, unsure), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *schema.names])

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All rows and columns with lang_pred, score (the nearest codeword's share, 0 to 1) and ambiguous; columns of these names are replaced.

    Only the text is looked at. A null text, or one without a letter, is ``und`` with score 0; so is every text if
    nothing could be learnt. Texts that tie get the first language of the alphabet and are ambiguous. Equal texts get equal
    results; an empty table gives no rows.
    """
    old = bounded(docs).drop(*PREDICTED_NAMES)
    schema = StructType([*old.schema.fields, *StructType.fromDDL(PREDICTED).fields])
    return old.mapInArrow(_predict(model, text_col), schema)


PREDICTED_NAMES = [c.split()[0] for c in PREDICTED.split(",")]
