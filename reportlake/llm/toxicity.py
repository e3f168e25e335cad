"""Operator 8: toxicity by compression distance.

Two zstandard dictionaries of equal size are trained, one on toxic and one on ordinary text. Both begin with a base that
zstandard's trainer finds in windows of ordinary text, so that a match in ordinary language costs the same under
either. The rest is trained on the stretches of each class's own texts that are typical of the class (runs of words
that it uses significantly more often than the other); most of a toxic text is ordinary language, whose chance matches
would drown those of the toxic words. A text is cut into word windows; each window is compressed under both
dictionaries, and ``ordinary length - toxic length`` is its margin. A margin at or over the calibrated threshold is
a hit; a logistic curve over hit count, hit share and largest margins turns the windows of a text into a score.

Training uses a bounded sample (``Params.docs_per_class`` labelled documents of each class, chosen by a hash of the
id, none longer than ``Params.max_train_chars``): half of it trains dictionaries under which the other half calibrates
the threshold and the curve; the final dictionaries are trained on both halves. Scoring covers every window of every whole text. Labels, language, source and id are never
inputs of a score.

Defined results: null text = empty text; an empty text has no window and gets the curve's value at zero hits; a
null doc_id counts as the text ``""`` for the fold; repeated rows are scored one by one; an empty table gives an
empty result; without both classes in the training folds every score is 0.0 and nothing is predicted toxic. Extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import lean

_STRIP = ".,;:!?\"'()[]{}<>|%$&*#-_"


@dataclass(frozen=True)
class Params:
    window_bytes: int = 32
    docs_per_class: int = 2500
    max_train_chars: int = 100_000
    base_bytes: int = 32_768
    class_bytes: int = 4_096
    alpha: float = 0.5
    min_share: float = 0.005
    level: int = 9
    window_fpr: float = 1e-3
    seed: int = 17


@dataclass
class Model:
    """What scoring needs: two dictionaries, the window threshold and the curve. Its size is bounded by Params."""

    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: list[float]
    params: Params = field(default_factory=Params)

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_pair": None}

    def _compressors(self):
        if self._pair is None:
            self._pair = tuple(_compressor(x, self.params.level) for x in (self.ordinary, self.toxic))
        return self._pair

    def margins(self, text: str | None) -> list[int]:
        a, b = (c.compress for c in self._compressors())
        return [len(a(w)) - len(b(w)) for w in windows(text, self.params.window_bytes)]

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        z = float(np.dot(self.weights, _features(self.margins(text), self.threshold)))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def windows(text: str | None, size: int) -> list[bytes]:
    """Windows of whole lower-case words, each ended by the word that brings it to ``size`` bytes; a single word over
    eight times that size is cut. The words at a border stand in one window only, framed by spaces."""
    out: list[bytes] = []
    cur: list[bytes] = []
    n = 0
    for w in (text or "").lower().split():
        b = w.encode("utf-8", "replace")
        if len(b) > 8 * size:
            out += [b[i : i + 8 * size] for i in range(0, len(b), 8 * size)]
            continue
        cur.append(b)
        n += len(b) + 1
        if n >= size:
            out.append(b" %b " % b" ".join(cur))
            cur, n = [], 0
    if cur:
        out.append(b" %b " % b" ".join(cur))
    return out


def _features(margins: list[int], threshold: int) -> np.ndarray:
    if not margins:
        return np.array([0.0, 0.0, 0.0, 0.0, 1.0])
    m = np.asarray(margins)
    hits = int((m >= threshold).sum())
    top = float(max(m.max(), 0))
    return np.array([float(hits > 0), math.log1p(hits), hits / len(m), top / 10.0, 1.0])


def _words(text: str) -> list[str]:
    return [x for w in text.lower().split() if (x := w.strip(_STRIP))]


def _log_tail(a: int, n: int, q: float) -> float:
    """log P(X >= a) for X ~ Binomial(n, q), bounded by its largest term's geometric series (a > n q)."""
    top = math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n - a + 1) + a * math.log(q) + (n - a) * math.log1p(-q)
    ratio = (n - a) / (a + 1) * q / (1 - q)
    return min(0.0, top - math.log1p(-min(ratio, 0.999)))


def _contrast(of: list[str], other: list[str], p: Params) -> list[str]:
    """Words typical of one class's texts, the most typical last. A word counts once for each text, and at most once
    for each word before it, so that near copies of one text don't make its words typical. Kept are those whose
    excess has a binomial tail under ``alpha`` shared out among all words of the class."""
    a = Counter()
    for t in of:
        a.update(set(_words(t)))
    least, vocabulary = max(3, p.min_share * len(of)), len(a)
    a = {w: n for w, n in a.items() if n >= least}
    b, before = Counter(), {w: set() for w in a}
    for t in other:
        b.update(a.keys() & set(_words(t)))
    for t in of:
        w = _words(t)
        for x, y in zip(["", *w], w, strict=False):
            if y in before and len(before[y]) < a[y]:
                before[y].add(x)
    q = len(of) / (len(of) + len(other))
    kept = []
    for w, n in a.items():
        n = min(n, len(before[w]))
        if n >= least and n > q * (n + b[w]):
            tail = _log_tail(n, n + b[w], q)
            if tail + math.log(vocabulary) <= math.log(p.alpha):
                kept.append((-tail, w))
    return [f" {w} " for _, w in sorted(kept)]


def _segments(samples: list[bytes], size: int) -> bytes:
    """The content zstandard's trainer picks; the different samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _stretches(texts: list[str], units: list[str]) -> list[bytes]:
    """One sample for each text that holds units: those words where they stand, framed by spaces, in order."""
    marks, out = {u.strip() for u in units}, []
    for t in texts:
        if found := [w for w in _words(t) if w in marks]:
            out.append((" " + "  ".join(found) + " ").encode("utf-8", "replace"))
    return out


def _class_part(texts: list[str], units: list[str], size: int) -> bytes:
    """The dictionary part trained on a class's typical stretches, behind zero bytes, which no text matches: either
    class part has one length, so that a match in the base costs the same under both dictionaries."""
    samples = _stretches(texts, units)
    return _segments(samples, size).rjust(size, b"\0") if samples else b"\0" * size


def fit(rows: Iterable[tuple[str, int, int]], params: Params = Params(), totals: dict[int, int] | None = None) -> Model:
    """rows: (text, label, half). Half 0 trains the dictionaries, half 1 the threshold and the curve. ``totals``: how many
    labelled documents each class has, of which the rows are a sample; the curve weighs the classes by them."""
    rows = sorted({(t, y): h for t, y, h in rows}.items())  # copies would make any word of theirs look typical
    rows = [(t, y, h) for (t, y), h in rows]
    of = {(y, h): [t for t, y2, h2 in rows if (y2, h2) == (y, h)] for y in (0, 1) for h in (0, 1)}
    if not all(of.values()):
        return Model(b"", b"", 1, [], params)
    rng = np.random.default_rng(params.seed)
    sample = [w for t in of[0, 0] for w in windows(t, 4 * params.window_bytes)]
    sample = [sample[i] for i in rng.permutation(len(sample))[:40_000].tolist()]
    base = _segments([s for s in sample if len(s) >= 8], params.base_bytes)

    def train(halves: tuple[int, ...]) -> Model:
        texts = [[t for h in halves for t in of[y, h]] for y in (0, 1)]
        parts = [_class_part(texts[y], _contrast(texts[y], texts[1 - y], params), params.class_bytes) for y in (0, 1)]
        return Model(base + parts[0], base + parts[1], 1, [], params)

    model = train((0,))
    held = {y: [model.margins(t) for t in of[y, 1]] for y in (0, 1)}
    flat = np.array(sorted(x for m in held[0] for x in m) or [0])
    # the smallest margin that at most window_fpr of the ordinary windows reach
    model.threshold = max(1, next((t for t in range(1, 64) if (flat >= t).mean() <= params.window_fpr), 64))
    x = np.array([_features(m, model.threshold) for y in (0, 1) for m in held[y]])
    y = np.array([float(y) for y in (0, 1) for _ in held[y]])
    size = {y: len(of[y, 0]) + len(of[y, 1]) for y in (0, 1)}
    share = np.where(y == 1, *((totals or size)[k] / size[k] for k in (1, 0)))
    share /= share.mean()
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (share * q * (1 - q))[:, None]) + ridge, x.T @ (share * (q - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    final = train((0, 1))  # the curve stays that of the half the first dictionaries didn't see
    final.threshold, final.weights = model.threshold, [float(v) for v in w]
    return final


def fold(doc_id: str) -> int:
    return zlib.crc32(doc_id.encode()) % 5


def train(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Fits on labelled rows outside fold 0. One bounded sample reaches the driver (see the module text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("_y")).where("doc_id is not null and _y in (0, 1)")
    y = y.groupBy("doc_id").agg(F.max("_y").alias("_y")).where(F.crc32(key.cast("binary")) % 5 != 0)
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).where("doc_id is not null")
    # the ids of the sample are picked before any text moves
    picked = None
    for c in (0, 1):
        part = y.where(F.col("_y") == c).orderBy(F.xxhash64("doc_id", F.lit(params.seed)), "doc_id").limit(params.docs_per_class)
        picked = part if picked is None else picked.unionByName(part)
    got = x.where(F.length("_t") <= params.max_train_chars).join(F.broadcast(picked), "doc_id")
    got = got.select("_t", "_y", F.pmod(F.xxhash64("doc_id", F.lit(params.seed + 1)), F.lit(2)).alias("_h"))
    rows = sorted((r[0], int(r[1]), int(r[2])) for r in got.collect())
    totals = {int(k): n for k, n in y.groupBy("_y").count().collect()}
    return fit(rows, params, {0: totals.get(0, 0), 1: totals.get(1, 0)})


def score(docs: DataFrame, model: Model, name: str = "tox_score") -> DataFrame:
    """docs plus its score in the column ``name`` (replacing one of that name); every window of every text is read."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = [m.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(lean(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The contract's digest: doc_id, held_out, score, predicted."""
    model = train(docs, labels, params)
    out = score(docs.select("doc_id", "text"), model)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return out.select(
        "doc_id",
        (F.crc32(key) % 5 == 0).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
    )
