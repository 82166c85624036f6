"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. A passage is described by its words, each
hashed to one of ``BUCKETS`` learned vectors whose mean is taken, and by counts of its
characters, words and repetitions; a learned layer encodes both. Gated attention weighs
the passages; the weighted sum of their encodings gives the score. Only labels of whole
texts are needed: the attention learns which passages decide.

The model is fitted on a bounded sample of labelled texts: ``TRAIN_DOCS`` at most in
expectation, and ``TRAIN_BYTES`` of text, chosen by a hash of the id, with all their
passages. Scoring reads every passage of every text.

Nulls are empty texts; a text without words is one empty passage, and is scored like
any other. Very long texts are hashed piece by piece, cut at white space, and described
as one. Labels that contradict each other, labels without a text and null labels are not
learned from; of rows that repeat a labelled id the one whose text has the least SHA-256 is. Repeated rows are scored
separately. Ids, language and source are not inputs of a score; further columns are not
read. An empty table gives an empty result; without labels of both kinds every score is
0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shingles import _SPACE, _hash_words, cut_at_space, mix, shingle_sequence

PASSAGE = 64
TRAIN_DOCS = 8_000
#: UTF-8 bytes of the texts that are learned from, in expectation: their passages are gathered on the driver.
TRAIN_BYTES = 256 << 20
HIDDEN, GATE = 16, 8
#: Vectors that words are hashed to.
BUCKETS = 1 << 12
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.01, 1e-4
#: Passages whose word vectors are held at once.
TOGETHER = 1 << 9
#: Decay of the word vectors: a word that few texts have should say little.
WORD_DECAY = 2e-3

#: Classes of bytes that are counted in a passage.
_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "#$%&*", "|", ".,;:?", "\n", "<>{}[]()=/\\_~^@+"]
_KIND = np.full(256, len(_CLASSES), np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _KIND[list(_chars.encode())] = _k
_KIND[128:] = len(_CLASSES) + 1
_KIND[[0x20, 0x09]] = len(_CLASSES) + 2
N_KINDS = len(_CLASSES) + 3
N_FEATURES = N_KINDS + 12


@dataclass
class Bag:
    """The passages of a text: a row of features for each, the buckets of all words, and the first word of each passage."""

    features: np.ndarray
    words: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.features)

    def pack(self) -> dict[str, bytes]:
        return {"features": self.features.tobytes(), "words": self.words.tobytes(), "first": self.first.tobytes()}

    @classmethod
    def unpack(cls, row) -> Bag:
        return cls(np.frombuffer(row["features"], np.float32).reshape(-1, N_FEATURES), np.frombuffer(row["words"], np.uint16), np.frombuffer(row["first"], np.int32))


def bag_of(raw: np.ndarray) -> Bag:
    """The passages of a text given as UTF-8 bytes."""
    hashes, at, base = [], [], 0
    for piece in cut_at_space(raw):
        words, starts = _hash_words(piece, np.zeros(0, np.int64))
        hashes.append(words), at.append(starts + base)
        base += len(piece)
    words, starts = np.concatenate(hashes), np.concatenate(at)
    n = len(words)
    if n == 0:
        out = np.zeros((1, N_FEATURES), np.float32)
        out[0, -1] = 1
        return Bag(out, np.zeros(0, np.uint16), np.zeros(1, np.int32))
    first = np.arange(0, n, PASSAGE)
    if len(first) > 1 and n - first[-1] < PASSAGE // 4:
        first = first[:-1]
    return Bag(_features(raw, words, starts, first), (mix(words) % np.uint64(BUCKETS)).astype(np.uint16), first.astype(np.int32))


def _features(raw: np.ndarray, words: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(words)
    size = np.diff(np.append(first, n)).astype(np.float32)
    begin = starts[first]
    begin[0] = 0
    length = np.diff(np.append(begin, len(raw))).astype(np.float32)
    kinds = _KIND[raw]
    ends = np.append(starts[1:], len(raw))
    space = np.concatenate(([0], np.cumsum(_SPACE[raw])))
    letters = (ends - starts) - (space[ends] - space[starts])
    lead, tail = raw[starts], raw[starts + letters - 1]
    same = np.zeros(n, np.float32)
    same[1:] = words[1:] == words[:-1]
    again = np.ones(n, np.float32)
    again[np.unique(words, return_index=True)[1]] = 0
    runs = shingle_sequence(words)
    twice = np.zeros(n, np.float32)
    twice[: len(runs)] = 1
    twice[np.unique(runs, return_index=True)[1]] = 0
    order = np.sort(_padded(words, first), axis=1)
    distinct = (order[:, 1:] != order[:, :-1]).sum(axis=1) + 1 - (order.shape[1] - size)
    per_word = [
        letters,
        (lead >= 0x41) & (lead <= 0x5A),
        (_KIND[tail] == 3),
        (_KIND[tail] == 4),
        (_KIND[tail] == 6),
        same,
        again,
        twice,
        letters > 20,
    ]
    columns = [np.add.reduceat(kinds == k, begin, dtype=np.float32) / length for k in range(N_KINDS)]
    columns += [np.add.reduceat(x, first, dtype=np.float32) / size for x in per_word]
    columns += [distinct / size, np.log1p(size), np.zeros(len(first), np.float32)]
    return np.stack(columns, axis=1).astype(np.float32)


def _padded(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words by passage; shorter passages are filled with values that differ from each other and from any word."""
    wide = int(np.diff(np.append(first, len(words))).max())
    out = np.tile(np.arange(wide, dtype=np.uint64), (len(first), 1))
    at = np.searchsorted(first, np.arange(len(words)), "right") - 1
    out[at, np.arange(len(words)) - first[at]] = words
    return out


@dataclass
class _Batch:
    """Bags one after the other: features, words, the first word and the words of each passage, and the first passage of each bag."""

    x: np.ndarray
    words: np.ndarray
    first: np.ndarray
    size: np.ndarray
    bags: np.ndarray

    @classmethod
    def of(cls, bags: list[Bag], mean: np.ndarray, scale: np.ndarray) -> _Batch:
        x = ((np.concatenate([b.features for b in bags]) - mean) / scale).clip(-6, 6)
        shift = np.cumsum([0] + [len(b.words) for b in bags])
        first = np.concatenate([b.first + s for b, s in zip(bags, shift[:-1], strict=True)])
        size = np.diff(np.append(first, shift[-1]))
        return cls(x, np.concatenate([b.words for b in bags]), first, size, np.cumsum([0] + [len(b) for b in bags[:-1]]))

    def passage_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def mean_of(self, vectors: np.ndarray) -> np.ndarray:
        """The mean vector of the words of each passage; 0 without words."""
        out = np.zeros((len(self.size), vectors.shape[1]), vectors.dtype)
        some = self.size > 0
        first, stop = self.first[some], (self.first + self.size)[some]
        means = np.empty((len(first), vectors.shape[1]), vectors.dtype)
        for s in range(0, len(first), TOGETHER):
            part = slice(s, s + TOGETHER)
            words = self.words[first[s] : stop[part][-1]]
            means[part] = np.add.reduceat(vectors[words], first[part] - first[s]) / (stop - first)[part, None]
        out[some] = means
        return out


@dataclass
class MilModel:
    """Weights of the word vectors, the passage encoder, the gated attention and the scoring layer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @classmethod
    def fit(cls, bags: list[Bag], labels: np.ndarray, seed: int = 11) -> MilModel:
        """Adam on the logistic loss, each kind of label weighing the same."""
        rng = np.random.default_rng(seed)
        rows = np.concatenate([b.features for b in bags])
        mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
        shapes = {"E": (BUCKETS, HIDDEN), "W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        p = {k: rng.normal(0, 0.01 if k == "E" else 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
        m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for s in range(0, len(order), BATCH):
                chosen = order[s : s + BATCH]
                grads = _gradients(p, _Batch.of([bags[i] for i in chosen], mean, scale), labels[chosen], weight[chosen])
                step += 1
                for k in p:
                    g = grads[k] + (WORD_DECAY if k == "E" else DECAY) * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(mean, scale, {**p, "E": p["E"].astype(np.float32)})

    def score(self, bags: list[Bag]) -> np.ndarray:
        """The probability of label 1 for each bag."""
        if not bags:
            return np.zeros(0)
        return _forward(self.weights, _Batch.of(bags, self.mean, self.scale))["score"]

    def attention(self, bag: Bag) -> np.ndarray:
        """The weights of a bag's passages; they sum to 1."""
        return _forward(self.weights, _Batch.of([bag], self.mean, self.scale))["a"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict, batch: _Batch) -> dict[str, np.ndarray]:
    first = batch.bags
    bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(batch.x))))
    h = np.tanh(batch.x @ p["W"] + batch.mean_of(p["E"]) + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}


def _gradients(p: dict, batch: _Batch, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(p, batch)
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    ds = (f["score"] - labels) * weight / len(batch.bags)
    dz = ds[:, None] * p["c"]
    da = (dz[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, batch.bags)[bag])
    dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
    dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
    dx = dh * (1 - h * h)
    # a passage's gradient goes to the vectors of its words in equal shares
    share, of = dx / np.maximum(batch.size, 1)[:, None], batch.passage_of_word()
    dE = np.stack([np.bincount(batch.words, share[of, j], BUCKETS) for j in range(HIDDEN)], axis=1)
    return {"E": dE, "W": batch.x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ ds, "d": np.array([ds.sum()])}


def _bags(texts: pa.Array) -> list[Bag]:
    return [bag_of(np.frombuffer((text.as_py() or "").encode(), np.uint8)) for text in texts]


def _learnable(id_: Column) -> Column:
    """Whether labels of an id may be learned: crc32 of the id as text leaves a remainder other than 1."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> MilModel | None:
    """Fit on a hash sample of the labelled texts; None without labels of both kinds."""
    known = labels.where(F.col(label_col).isNotNull() & _learnable(F.col(id_col))).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.min(label_col).alias("label"), F.max(label_col).alias("most")).where("label = most").select("id", "label")
    n = known.count()
    parts = 1_000_000
    share = min(parts, parts * train_docs // max(n, 1))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # broadcast: train_docs rows of two numbers
    drawn = lambda share: texts.join(F.broadcast(known.where(F.pmod(F.xxhash64("id"), F.lit(parts)) < F.lit(share))), "id")
    size = drawn(share).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # of equal ids, one text, the same one in each run
    sample = drawn(min(share, share * TRAIN_BYTES // max(size, 1))).groupBy("id", "label").agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs = [b.pack() for b in _bags(batch.column("text"))]
            bags = {name: pa.array([x[name] for x in packs], pa.binary()) for name in ("features", "words", "first")}
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label").cast(pa.float64()), **bags})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sample.select("id", "label", "text").mapInArrow(run, f"id {kind}, label double, features binary, words binary, first binary").collect()
    rows = sorted(rows, key=lambda r: (r.id, bytes(r.features)))
    target = np.array([r.label for r in rows])
    if len(set(target.tolist())) < 2:
        return None
    return MilModel.fit([Bag.unpack(r) for r in rows], target)


def score(docs: DataFrame, model: MilModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, score, predicted)`` for every row, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores = np.full(part.num_rows, 0.5) if shared.value is None else shared.value.score(_bags(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    held_out = ~_learnable(F.col(id_col))
    return scored.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: MilModel | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, all columns as they are, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores = np.full(part.num_rows, 0.5) if shared.value is None else shared.value.score(_bags(part.column(at)))
                yield part.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)
