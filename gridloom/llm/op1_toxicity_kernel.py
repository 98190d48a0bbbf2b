"""Toxicity: a support vector machine with a gap-weighted subsequence string kernel and Nyström landmarks.

Kernel: a unit (a word, or a run of single letters parted by blanks and signs) is described by all its
subsequences of three letters with at most two characters inserted between neighbours, each
weighted by DECAY ** span; digits, signs and punctuation match nothing and only widen a gap, so
``i-d*i.o t`` stays near ``idiot``.  The kernel of two units is the normalised inner product.  A unit of more than
``WIDTH`` letters counts as its overlapping windows, in training as in scoring.

Training: documents carry the labels; a document is a bag of sentences, a sentence scores as its worst
unit.  The landmarks are frequent witnesses of toxic bags and units of clean ones; the first witnesses are the
units most typical of toxic texts.  A witness may also stand in clean texts if its log-odds are at least ``ODDS`` and
``SURE`` standard errors; such a unit is never a negative.  A linear SVM (squared hinge) is trained in the Nyström space, and in ``ROUNDS``
rounds the witnesses of toxic bags and the hardest units of clean bags are chosen anew.  The machine learns from the
whole sample; ``FOLDS`` more machines, each blind to its part of the sample, calibrate a sigmoid of two measures of a document: its worst unit, and how dense units on the toxic side are (one such unit among
hundreds may be chance, several close together are not).  Neither weight may be negative.
At most about ``SAMPLE`` labelled documents of each class, of at most ``LONGEST`` characters each, are taken,
chosen by a hash of the id.

Scoring: the landmarks' weighted sum is one table over letter triples, exactly equal to the sum over
landmarks, so a unit costs the same whatever their number.  Each distinct unit of a task is scored once;
the scan has no shuffle, and whole texts count.

Defined results: texts without any unit (null, empty) get the score of a unit without letters and no density; without
labels of both classes every score is the share of toxic labels (0 without labels); rows with a null id are not
held out; labels that disagree on one id count as toxic; repeated rows and ties score alike; an empty table gives no
rows; columns besides the named ones are not read, so their names can't clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .common import Latest, crc_bucket, renamed, table, tidy
from .sampling import per_class

SAMPLE, LONGEST, THRESHOLD = 2000, 20_000, 0.3
PRIOR, FIRM = (1.0, 2.0), 1.0
DECAY, GAP, WIDTH, LANDMARKS, ROUNDS, CACHE, PADDING, FOLDS = 0.6, 3, 16, 128, 5, 1 << 18, 20, 3
ODDS, SURE = np.log(4.0), 3.0
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[0x80:0xC0] = 27 + np.arange(64) % 5
_OFFSETS = [(i, i + a, i + a + b, DECAY ** (a + b + 1)) for i in range(WIDTH) for a in range(1, GAP + 1) for b in range(1, GAP + 1) if i + a + b < WIDTH]
_CELLS = 32**3
_known = Latest()


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the units of every row, and each row's first unit; ``buf`` is lower-cased."""
    starts, ends, first = textscan.space_words(buf, offsets)
    if not len(starts):
        return starts, ends, first
    single = (ends - starts == 1) & (_CLASS[buf[starts]] > 0)
    joins = np.zeros(len(starts), bool)
    joins[1:] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1)
    joins[first[first < len(starts)]] = False
    heads = np.flatnonzero(~joins)
    last = np.concatenate([heads[1:], [len(starts)]]) - 1
    return starts[heads], ends[last], np.searchsorted(heads, first)


def closed_up(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased rows with single letters that blanks and signs part (``i - d - i``) one blank apart."""
    starts, ends, first = textscan.spans(((buf >= 97) & (buf <= 122)) | (buf >= 128), offsets)
    if len(starts) < 2:
        return buf, offsets
    single = (ends - starts == 1) & (buf[starts] < 128)
    blanks = np.concatenate([[0], np.cumsum((buf == 32) | ((buf >= 9) & (buf <= 13)), dtype=np.int32)])
    pair = single[1:] & single[:-1] & (blanks[starts[1:]] > blanks[ends[:-1]])
    heads = first[(first > 0) & (first < len(starts))]
    pair[heads - 1] = False
    k = np.flatnonzero(pair)
    if not len(k):
        return buf, offsets
    buf = buf.copy()
    buf[ends[k]] = 32
    tail, head = k[~np.isin(k + 1, k)] + 1, k[~np.isin(k - 1, k)]
    row_of = lambda at: np.searchsorted(offsets, at, "right")
    after, before = ends[tail], starts[head] - 1
    after = after[(after < offsets[-1]) & (row_of(np.minimum(after, offsets[-1] - 1)) == row_of(starts[tail]))]
    before = before[(before >= offsets[0]) & (row_of(before) == row_of(starts[head]))]
    buf[after], buf[before] = 32, 32
    step = np.zeros(len(buf) + 1, np.int8)
    step[ends[k] + 1] += 1
    step[starts[k + 1]] -= 1
    gone = np.cumsum(step[:-1], dtype=np.int8) > 0
    lost = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
    return buf[~gone], offsets - lost[offsets]


def spread_out(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units' spans with longer ones divided into the overlapping windows that scoring sees."""
    half = WIDTH // 2
    count = np.maximum(-(-(ends - starts - half) // half), 1)
    before = np.concatenate([[0], np.cumsum(count)])
    unit = np.repeat(np.arange(len(starts)), count)
    begin = starts[unit] + (np.arange(len(unit)) - before[unit]) * half
    return begin, np.minimum(begin + WIDTH, ends[unit]), before[first]


def windows(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of each unit in rows of WIDTH; longer units take several overlapping rows.  Also each row's unit."""
    lens = ends - starts
    half = WIDTH // 2
    count = np.maximum(-(-(lens - half) // half), 1)
    unit = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[unit, None] + nth[:, None] * half + np.arange(WIDTH)
    inside = at < ends[unit, None]
    return np.where(inside, _CLASS[buf[np.minimum(at, max(len(buf) - 1, 0))]], 0), unit


def features(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and normalised weights of the triples of every row; weight 0 where there is none."""
    cells = np.stack([(x[:, i] * 32 + x[:, j]) * 32 + x[:, k] for i, j, k, _ in _OFFSETS], 1).astype(np.int32)
    valid = np.stack([(x[:, i] > 0) & (x[:, j] > 0) & (x[:, k] > 0) for i, j, k, _ in _OFFSETS], 1)
    weights = np.where(valid, np.array([w for *_, w in _OFFSETS], np.float32), np.float32(0))
    order = np.argsort(cells, axis=1)
    c, w = np.take_along_axis(cells, order, 1), np.take_along_axis(weights, order, 1)
    new = np.ones(c.shape, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    norm = np.bincount(np.arange(len(c)).repeat(c.shape[1])[new.ravel()], np.bincount(group, w.ravel()) ** 2, len(c))
    return cells, weights / np.sqrt(np.maximum(norm, 1e-9))[:, None].astype(np.float32)


def unit_scores(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(starts), -np.inf)
    for lo in range(0, len(starts), 4096):
        x, unit = windows(buf, starts[lo : lo + 4096], ends[lo : lo + 4096])
        for a in range(0, len(x), 2048):
            cells, w = features(x[a : a + 2048])
            np.maximum.at(out, lo + unit[a : a + 2048], (weights[cells] * w).sum(1) + bias)
    return out


def density(row: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Log of one plus the hits among 100 units of each of n rows; a hit counts its margin, 1 at most, and short texts are padded."""
    hits = np.bincount(row, np.clip(score, 0, 1), n)
    return np.log1p(100 * hits / (np.bincount(row, minlength=n) + PADDING))


class _Bags:
    """Distinct units (windows of longer ones) of a sample and the documents they stand in."""

    def __init__(self, texts: list[str]):
        buf, offsets = textscan.column_bytes(pa.array(texts, pa.string()))
        done, sizes = [np.zeros(0, np.uint8)], [0]
        for lo, hi in textscan.row_chunks(offsets, 1 << 19):
            piece, at = closed_up(textscan.lower_ascii(buf[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo])
            done.append(piece)
            sizes += np.diff(at).tolist()
        buf, offsets = np.concatenate(done), np.cumsum(np.asarray(sizes, np.int64))
        index = textscan.HashIndex()
        starts, ends, docs, found, times = [], [], [], [], []
        for lo, hi in textscan.row_chunks(offsets, 1 << 19):
            piece = buf[offsets[lo] : offsets[hi]]
            a, z, first = spread_out(*units(piece, offsets[lo : hi + 1] - offsets[lo]))
            keys = textscan.span_hashes(piece, a, z)
            new, where = np.unique(keys, return_index=True)
            fresh = index.get(new) < 0
            index.add(new[fresh])
            starts.append((a[where[fresh]] + offsets[lo]).astype(np.int32))
            ends.append((z[where[fresh]] + offsets[lo]).astype(np.int32))
            doc = np.repeat(np.arange(lo, hi, dtype=np.int64), np.diff(first))
            pairs, often = np.unique(doc << 32 | index.get(keys).astype(np.int64), return_counts=True)
            docs.append((pairs >> 32).astype(np.int32))
            found.append((pairs & 0xFFFFFFFF).astype(np.int32))
            times.append(often.astype(np.int32))
        self.buf, self.n_docs, self.n = buf, len(texts), index.n
        self.starts, self.ends, self.doc, self.unit, self.times = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (starts, ends, docs, found, times))

    def spread(self, docs: np.ndarray) -> np.ndarray:
        """In how many of the marked documents each unit stands."""
        return np.bincount(self.unit[docs[self.doc]], minlength=self.n)

    def worst(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per document its highest unit score and that unit (-1 for none)."""
        best, who = np.full(self.n_docs, -np.inf), np.full(self.n_docs, -1)
        np.maximum.at(best, self.doc, score[self.unit])
        hit = score[self.unit] == best[self.doc]
        who[self.doc[hit]] = self.unit[hit]
        return best, who

    def density(self, score: np.ndarray) -> np.ndarray:
        """Per document how dense its units on the toxic side are."""
        return density(np.repeat(self.doc, self.times), np.repeat(score[self.unit], self.times), self.n_docs)

    def dense(self, which: np.ndarray) -> np.ndarray:
        """Explicit feature vectors, a row each."""
        x, unit = windows(self.buf, self.starts[which], self.ends[which])
        cells, w = features(x)
        out = np.zeros((len(which), _CELLS), np.float32)
        np.add.at(out, (unit[:, None], cells), w)
        return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on the violating rows."""
    z1 = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-4
    for _ in range(rounds):
        active = y * (z1 @ w) < 1
        a = z1[active] * weight[active, None]
        new = np.linalg.solve(ridge + c * a.T @ z1[active], c * a.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _sigmoid_fit(measures: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the measures, none negative, and the shift of a logistic regression by Newton steps.

    ``PRIOR`` weights, held as firmly as ``FIRM`` says, keep both measures in use where few rows are toxic."""
    prior, firm = np.array([*PRIOR, 0.0]), np.array([FIRM] * len(PRIOR) + [1e-2])
    x = np.hstack([measures, np.ones((len(y), 1))])
    used = np.ones(x.shape[1], bool)
    while True:
        w, part = np.zeros(x.shape[1]), x[:, used]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = part.T @ (weight * (p - y)) + (firm * (w - prior))[used]
            h = (part * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ part + np.diag(firm[used])
            step = np.linalg.solve(h, g)
            w[used] -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        negative = np.flatnonzero(w[:-1] < 0)
        if not len(negative):
            return w[:-1], float(w[-1])
        used[negative] = False


def _trained(bags: _Bags, toxic: np.ndarray, clean: np.ndarray) -> tuple[dict, np.ndarray] | None:
    """The machine of the marked documents and its score of every unit; None without witnesses."""
    in_toxic, in_clean = bags.spread(toxic), bags.spread(clean)
    odds = np.log((in_toxic + 0.5) / (toxic.sum() + 1)) - np.log((in_clean + 0.5) / (clean.sum() + 1))
    _, who = bags.worst(odds)
    rng = np.random.default_rng(0)
    spread = np.sqrt(1 / (in_toxic + 0.5) + 1 / (in_clean + 0.5))
    apart = (in_clean == 0) | ((odds >= ODDS) & (odds >= SURE * spread))
    calm = np.flatnonzero(~apart)
    negatives = np.unique(np.concatenate([calm[np.argsort(-in_clean[calm], kind="stable")[:2000]], rng.permutation(calm)[:4000]]))
    model = {}
    for _ in range(ROUNDS):
        positives, times = np.unique(who[toxic & (who >= 0)], return_counts=True)
        times, positives = times[apart[positives]], positives[apart[positives]]
        if not len(positives) or not len(negatives):
            return None
        marks = np.concatenate([positives[np.argsort(-times, kind="stable")[: LANDMARKS // 2]], rng.permutation(negatives)[: LANDMARKS // 2]])
        phi = bags.dense(marks)
        values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-3))
        rows = np.concatenate([positives, negatives])
        z = np.concatenate([(bags.dense(rows[i : i + 128]) @ phi.T) @ root for i in range(0, len(rows), 128)])
        target = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
        weight = np.concatenate([np.sqrt(times), np.ones(len(negatives))])
        weight[: len(times)] *= len(negatives) / weight[: len(times)].sum()
        v, bias = _svm(z, target, weight / len(negatives) * 100)
        table = (phi.T @ (root @ v)).astype(np.float32)
        table[np.array([c for c in range(_CELLS) if not (c & 31 and c >> 5 & 31 and c >> 10)])] = 0
        score = unit_scores(bags.buf, bags.starts, bags.ends, table, bias)
        model = {"weights": table, "bias": bias}
        _, who = bags.worst(score + 0.1 * np.minimum(odds, 3) * apart)
        _, hard = bags.worst(np.where(apart, -np.inf, score))
        negatives = np.unique(np.concatenate([negatives, hard[clean & (hard >= 0)], calm[np.argsort(-score[calm], kind="stable")[:1500]]]))
    return model, score


def _measures(bags: _Bags, model: dict, score: np.ndarray) -> np.ndarray:
    return np.stack([np.maximum(bags.worst(score)[0], model["bias"]), bags.density(score)], 1)


def fit(texts: list[str], labels: list[int], share: float) -> dict:
    """The model of a labelled sample; ``share`` is the toxic share of all labels."""
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return {"constant": float(share)}
    bags, fold = _Bags(texts), np.arange(len(y)) % FOLDS
    found = _trained(bags, y == 1, y == 0)
    if found is None:
        return {"constant": float(share)}
    model, score = found
    measures, unseen = _measures(bags, model, score), np.zeros(len(y), bool)
    for k in range(FOLDS):
        part = _trained(bags, (y == 1) & (fold != k), (y == 0) & (fold != k))
        if part is not None:
            measures[fold == k] = _measures(bags, *part)[fold == k]
            unseen |= fold == k
    use = unseen if unseen.any() and y[unseen].min() != y[unseen].max() else np.ones(len(y), bool)
    prior = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
    model["slopes"], model["shift"] = _sigmoid_fit(measures[use], y[use], prior[use])
    return model


class _Known:
    """Scores of the units that a worker has met, emptied when there are more than CACHE."""

    def __init__(self) -> None:
        self.index, self.scores = textscan.HashIndex(), np.zeros(0)

    def get(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: dict) -> np.ndarray:
        keys = textscan.span_hashes(buf, starts, ends)
        if self.index.n > CACHE:
            self.__init__()
        at = self.index.get(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            where = missing[where]
            self.scores = np.concatenate([self.scores, unit_scores(buf, starts[where], ends[where], model["weights"], model["bias"])])
            self.index.add(new)
            at = self.index.get(keys)
        return self.scores[at]


def _text_scores(texts: pa.Array, broadcast) -> np.ndarray:
    model = broadcast.value
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    known = _known.get(broadcast, lambda _: _Known())
    buf, offsets = textscan.column_bytes(texts)
    out = [np.zeros(0)]
    with np.errstate(over="ignore"):
        for lo, hi in textscan.row_chunks(offsets):
            b, at = closed_up(textscan.lower_ascii(buf[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo])
            starts, ends, first = spread_out(*units(b, at))
            worst, row, score = np.full(hi - lo, model["bias"]), np.repeat(np.arange(hi - lo), np.diff(first)), known.get(b, starts, ends, model)
            np.maximum.at(worst, row, score)
            x = np.stack([worst, density(row, score, hi - lo)], 1) @ model["slopes"] + model["shift"]
            out.append(1 / (1 + np.exp(-np.clip(x, -700, 700))))
    return np.concatenate(out)


def _score(batches: Iterator[pa.RecordBatch], broadcast, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = _text_scores(batch["text"], broadcast)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def _accept(batches: Iterator[pa.RecordBatch], broadcast, threshold: float, place: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(_text_scores(batch.column(place), broadcast) < threshold))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, longest: int = LONGEST) -> dict:
    """Fits on a bounded sample: docs (doc_id, text), labels (doc_id, toxic)."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    chosen = per_class(known, "toxic", "doc_id", sample)
    rows = docs.where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in zip(*(batch[c].to_pylist() for c in ("doc_id", "toxic", "text")), strict=True)]
        found.sort(key=lambda r: ((r[0] * 2654435761) & 0xFFFFFFFF, r[2]))
        model = fit([r[2] for r in found], [r[1] for r in found], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # The bounded sample is fitted in one task, so that the driver never holds its texts.
    done = rows.repartition(1).mapInArrow(lambda it: tidy(fitted(it)), "model binary").collect()
    return pickle.loads(bytes(done[0].model)) if done else {"constant": float(share)}


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, held: int, sample: int):
    docs = renamed(docs, {"doc_id": id_col, "text": text_col}).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.withColumn("held_out", F.coalesce(crc_bucket("doc_id", modulus) == held, F.lit(False)))
    labels = renamed(labels, {"doc_id": id_col, "toxic": label_col}).where(crc_bucket("doc_id", modulus) != held)
    return docs, docs.sparkSession.sparkContext.broadcast(train(docs.where("not held_out"), labels, sample=sample))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 4, held: int = 2, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted; labels of held-out rows are never read."""
    docs, model = _model(docs, labels, id_col, text_col, label_col, modulus, held, sample)
    return docs.select("doc_id", "text", "held_out").mapInArrow(lambda it: tidy(_score(it, model, threshold)), "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 4, held: int = 2, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their own columns."""
    _, model = _model(docs, labels, id_col, text_col, label_col, modulus, held, sample)
    place = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: tidy(_accept(it, model, threshold, place)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over all of ``documents``; labels with crc32(doc_id) mod 4 = 2 are held out."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
