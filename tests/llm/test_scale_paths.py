"""The paths that only large inputs take: many model slices, long documents, large components, rows that share an id."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_groups, plain_documents

from gridloom.llm import common, op1_toxicity_kernel, op2_line_suffix, op6_positional_index, op9_superminhash, op10_lm_scoring, ppm, textscan


class _Held:
    def __init__(self, value):
        self.value = value


def test_every_slice_is_built_once_for_all_texts(monkeypatch):
    """Three slices, ten batches that fit together: three trees, not thirty."""
    import pyarrow as pa

    texts = [f"alpha beta {i} gamma delta {i * 7}" for i in range(200)]
    buf, offsets = textscan.column_bytes(pa.array(texts))
    counter = ppm.GramCounter(5)
    with np.errstate(over="ignore"):
        for _, _, norm, at, *_ in op10_lm_scoring._texts(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])):
            counter.add(norm, at)
    keys, counts = counter.total()

    def packed(which):
        body = np.diff(keys[which], prepend=np.uint64(0)).tobytes() + counts[which].tobytes()
        return [(int(which.sum()), pa.compress(body, "zstd", asbytes=True))]

    every = np.ones(len(keys), bool)
    own = [np.arange(1 << 16) % 3 == i for i in range(3)]
    models = [(_Held(packed(every)), o) for o in own]
    built = []
    tree = ppm.ContextTree
    monkeypatch.setattr(ppm, "ContextTree", lambda *a: built.append(1) or tree(*a))
    monkeypatch.setattr(op10_lm_scoring, "_built", common.Latest())
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 20)), pa.array([False] * 20), pa.array(texts[i : i + 20])], ["doc_id", "held_out", "text"]) for i in range(0, 200, 20)]
    none = _Held([])
    out = list(op10_lm_scoring._score(iter(batches), 5, models, none, True))
    assert len(built) == 3 and sum(map(len, out)) == 200
    built.clear()
    again = list(op10_lm_scoring._score(iter(batches), 5, models, none, True, hold=1))
    assert len(built) <= 1 + 2 * len(batches)  # the last tree of a group is the first of the next
    whole = list(op10_lm_scoring._score(iter(batches), 5, models[:1], none, True))
    for a, b, c in zip(out, again, whole, strict=True):
        assert a["score"].to_numpy() == pytest.approx(b["score"].to_numpy()) and a["score"].to_numpy() == pytest.approx(c["score"].to_numpy())


def test_document_of_100000_lines(spark):
    lines = [f"line {i % 5000} of a very long text" for i in range(100_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:20]))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in op2_line_suffix.dedup_lines(docs).collect()}
    assert (got[1].n_lines, got[1].n_removed, got[1].n_runs) == (100_000, 95_000, 1) and got[2].n_removed == 20
    assert time.time() - began < 100


def test_large_components_beside_strangers(spark, monkeypatch):
    """Blocks of one component only are never compared with each other, and no link is lost."""
    monkeypatch.setattr(op9_superminhash, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    near = lambda head, k: " ".join([*head, f"own{k}"])
    texts = [near(base, k) for k in range(60)] + [near(base[:104] + [f"x{i}" for i in range(16)], k) for k in range(40)] + ["quite another text here"] * 3
    docs = plain_documents(spark, texts)
    want = brute_groups([(i, t) for i, t in enumerate(texts)], 3, 85)
    got = {r.doc_id: r.component_id for r in op9_superminhash.near_duplicates(docs, words=3, percent=85, rows=1, bands=8).collect()}
    assert got == want
    tagged = spark.createDataFrame([(1, r, 100, 0 if r < 64 else r) for r in range(70)], "band long, rep long, n long, comp long")
    groups = op9_superminhash._groups(tagged).groupBy("band", "p", "q").agg(F.count("*").alias("k"), F.countDistinct("comp").alias("comps")).collect()
    assert groups and all(g.comps > 1 for g in groups) and sum(g.k for g in groups) < 3 * 70


def test_banding_misses_little():
    for percent in (70, 80, 85, 90):
        rows, bands = op9_superminhash.banding(percent)
        assert rows * bands <= op9_superminhash.PLACES and (1 - (percent / 100) ** rows) ** bands <= op9_superminhash.MISSED
    assert op9_superminhash.banding(85) == (6, 30) and op9_superminhash.banding(80) == (5, 36)


def test_training_sees_the_windows_of_scoring():
    buf = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzabcdefgh xy", np.uint8)
    starts, ends, first = op1_toxicity_kernel.units(buf, np.array([0, len(buf)]))
    a, z, f = op1_toxicity_kernel.spread_out(starts, ends, first)
    x, unit = op1_toxicity_kernel.windows(buf, starts, ends)
    y, own = op1_toxicity_kernel.windows(buf, a, z)
    assert len(own) == len(a) and (x == y).all() and f.tolist() == [0, len(a)] and len(set(unit)) == 2


def test_only_one_process_may_write_locally(spark):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_terms_too_large_to_broadcast(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(str, op6_positional_index.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(op6_positional_index, "BROADCAST_BYTES", 0)
    assert sorted(map(str, op6_positional_index.decontaminate(docs, bench).collect())) == want
