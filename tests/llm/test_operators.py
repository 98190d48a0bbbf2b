"""Every operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, no rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import check
from pyspark.sql import functions as F

from gridloom.llm import flac, op1_toxicity_kernel, op2_line_suffix, op3_temperature_mix, op4_url_markov, op5_language_ppm, op6_positional_index, op7_token_output, op8_media_flac, op9_superminhash, op10_lm_scoring, pfor, ppm, superminhash, textscan
from gridloom.llm.components import connected_components
from gridloom.llm.queries import ORACLES, QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} É{i}" for i in range(20000))
NEAR = " ".join(f"alpha{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "one", "one two", "One TWO three four", NEAR, NEAR, NEAR + " omega", "beta " + NEAR, "é à ñ 漢字 Ω", LONG,
    "repeated line of text here\nsecond line\nrepeated line of text here", "same words same words same words same words", "12345 !!! ???",
]
#: Names that the operators use inside.
CLASH = ("score", "key", "word", "band", "n", "rep", "held_out", "predicted", "wid", "budget", "copies", "rid", "media", "line", "idx", "component_id")


def documents(spark, texts=TEXTS, clash=True):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"src{i % 3}", 0) for i, t in enumerate(texts)]
    rows += [rows[5], rows[6], (None, "a text without an id", "en", "src0", 3), (5, "another text of document five", "en", "src1", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def plain_documents(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark).where("false")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def crc(doc_id, modulus):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 2


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(name, spark, sf_dir):
    check(QUERIES[name], ORACLES[name], spark, sf_dir)


# 1 -----------------------------------------------------------------------------------------------------------------


def _toy_model():
    rng = np.random.default_rng(0)
    syllables = ["ta", "re", "mon", "li", "sou", "ker", "pan", "dol"]
    clean = [" ".join("".join(rng.choice(syllables, 3)) for _ in range(30)) for _ in range(200)]
    toxic = [c + " " + rng.choice(["vexgrobnik", "zhurbaqop"]) + rng.choice(["", "s", "er"]) for c in clean[:100]]
    return op1_toxicity_kernel.fit(toxic + clean, [1] * 100 + [0] * 200, 0.1)


def _toxic_score(model, texts):
    class Held:
        value = model

    return op1_toxicity_kernel._text_scores(pa.array(texts, pa.string()), Held())


def test_toxicity_tolerates_gaps():
    model = _toy_model()
    bad = _toxic_score(model, ["tareli vexgrobnik monsou", "v e x g r o b n i k", "vex-grob*nik tareli", "z.h.u.r.b.a.q.o.p", "VEXGROBNIKS"])
    good = _toxic_score(model, ["tareli monsouker", "", None, "dolpanta 12 !!", "t a r e l i"])
    assert bad.min() >= 0.3 > good.max(), (bad, good)


def test_toxicity_table_equals_kernel_sum():
    """The weights' table gives the same value as the gap-weighted kernel computed by enumeration."""
    def phi(word):
        out = Counter()
        cls = [int(op1_toxicity_kernel._CLASS[b]) for b in word.encode()][: op1_toxicity_kernel.WIDTH]
        for i, j, k, w in op1_toxicity_kernel._OFFSETS:
            if k < len(cls) and cls[i] and cls[j] and cls[k]:
                out[(cls[i] * 32 + cls[j]) * 32 + cls[k]] += w
        size = math.sqrt(sum(v * v for v in out.values()))
        return {c: v / size for c, v in out.items()}

    marks, alpha = ["idiotic", "stupidly", "banana"], [0.7, -0.2, 1.1]
    table = np.zeros(32**3, np.float32)
    for m, a in zip(marks, alpha, strict=True):
        for c, v in phi(m).items():
            table[c] += a * v
    for word in ("idiot", "ban-a-na", "stupidity", "anana"):
        want = sum(a * sum(v * phi(m).get(c, 0) for c, v in phi(word).items()) for m, a in zip(marks, alpha, strict=True))
        got = op1_toxicity_kernel.unit_scores(np.frombuffer(word.encode(), np.uint8), np.array([0]), np.array([len(word)]), table, 0.0)[0]
        assert got == pytest.approx(want, abs=1e-5)


def test_toxicity_rows(docs, nothing, labels, spark):
    assert op1_toxicity_kernel.score(nothing, labels).count() == 0
    rows = op1_toxicity_kernel.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == crc(r.doc_id, 4) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    none = op1_toxicity_kernel.score(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.0}
    kept = op1_toxicity_kernel.reject_toxic(docs, labels)
    assert kept.columns == docs.columns


def test_toxicity_held_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = op1_toxicity_kernel.score(docs, labels).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == r.toxic for r in rows)
    assert hit >= 0.9 * len(rows)


# 2, 3 --------------------------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    """Greedy definition: a window of lines with enough words that equals an earlier one loses its lines."""
    seq = []
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        raw = (text or "").split("\n")
        seq.append((doc, [(i, x.strip(" \t\x0b\x0c\r")) for i, x in enumerate(raw) if x.strip(" \t\x0b\x0c\r")], raw))
    seen, out = set(), {}
    for doc, lines, raw in seq:
        gone = set()
        for a in range(len(lines)):
            for z in range(a + 1, len(lines) + 1):
                body = tuple(x for _, x in lines[a:z])
                if sum(len(WORD.findall(x)) for x in body) >= least:
                    if body in seen:
                        gone |= {i for i, _ in lines[a:z]}
                    seen.add(body)
        out[doc] = "\n".join(x for i, x in enumerate(raw) if i not in gone)
    return out


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(2)
    bank = [" ".join(["w%d" % i] * (1 + i % 4)) for i in range(6)]
    texts = ["\n".join(rng.choice(bank, rng.integers(0, 14))) + ("\n \n" if i % 3 else "") for i in range(40)] + ["", None]
    got = {r.doc_id: r.text for r in op2_line_suffix.dedup_lines(plain_documents(spark, texts), min_words=6).collect()}
    assert {k: v or "" for k, v in got.items()} == brute_lines(list(enumerate(texts)), 6)


def test_lines_edges(docs, nothing):
    assert op2_line_suffix.dedup_lines(nothing, min_words=3).count() == 0
    out = op2_line_suffix.dedup_lines(docs, min_words=3)
    assert set(docs.columns) <= set(out.columns) and out.count() == docs.count()


def test_mixing_meets_targets(spark):
    rows = [(f"s{k}", t, t // 10) for k, t in enumerate((100000, 5000, 4000, 300))]
    src = spark.createDataFrame(rows, "source string, tokens long, rows long")
    plan = op3_temperature_mix.budgets(src, target_entropy=0.8, max_repeats=1e9).collect()
    w = np.array([r.weight for r in plan])
    assert -(w * np.log(w)).sum() == pytest.approx(0.8 * math.log(4), abs=1e-6) and w.sum() == pytest.approx(1)
    limited = {r.source: r for r in op3_temperature_mix.budgets(src, target_entropy=1.0, max_repeats=3.0).collect()}
    repeats = {s: limited[s].budget / limited[s].tokens for s in limited}
    assert max(repeats.values()) == pytest.approx(3.0, abs=1e-3) and min(repeats.values()) == pytest.approx(1.0)


def test_mixing_places_are_dense(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op3_temperature_mix.draws(docs, max_repeats=2.0, block=4).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source, r.epoch), []).append((r.place, r.tokens))
    for spans in by.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    first = [r.doc_id for r in rows if r.epoch == 0]
    assert sorted(first) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_mixing_edges(docs, nothing):
    assert op3_temperature_mix.mix(nothing, max_repeats=2.0).count() == 0
    out = op3_temperature_mix.mix(docs, max_repeats=2.0)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


# 4, 5, 10 ----------------------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme here", "http://WWW.Example.COM/en/7?x=1", "https://a.b.example.net/de/88#t", "ftp://example.net/de/1", "http://x.org/es/", "x://casino-win.com?en/", "http://net/de/", "http://examplenet/de/8", "http://example.org/es", "a://b://c/d"]


def test_urls_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in op4_url_markov.judge(df).collect():
        url = URLS[r.page_id] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOW)
        fits = [(len(t), t, v) for t, v in op4_url_markov.RULES if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    assert op4_url_markov.judge(df.where("false")).count() == 0


def test_urls_learn_rejected_hosts(spark, sf_dir):
    pages = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/pages.parquet")
    rows = [r for r in op4_url_markov.judge(pages).collect() if r.rule is None]
    bad = [r.verdict == "block" for r in rows if re.search(r"casino|ads-|adult|spam|bets", r.host)]
    good = [r.verdict == "allow" for r in rows if not re.search(r"casino|ads-|adult|spam|bets|pills", r.host)]
    assert np.mean(bad) > 0.95 and np.mean(good) > 0.95


def brute_ppm(train, text, order):
    """Code length by the definition, with dictionaries."""
    counts = {}
    for t in train:
        s = bytes([255] * order) + t.encode() + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1
    bits, s = 0.0, bytes([255] * order) + text.encode() + b"\xff"
    for i in range(order, len(s)):
        barred = set()
        for k in range(order, -1, -1):
            here = {c: n for c, n in counts.get(s[i - k : i], {}).items() if c not in barred}
            if not here:
                continue
            n = sum(here.values())
            if s[i] in here:
                bits -= math.log2((2 * here[s[i]] - 1) / (2 * n))
                break
            bits -= math.log2(len(here) / (2 * n))
            barred |= set(here)
        else:
            bits += math.log2(256 - len(barred))
    return bits


def _model(train, order):
    counter = ppm.GramCounter(order)
    counter.add(*textscan.column_bytes(pa.array(train, pa.string())))
    return counter.total()


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths_against_brute_force(order):
    train = ["the cat sat on the mat", "a cat and a hat", "ñandú über", ""]
    texts = ["the hat", "", "zzz qqq", "cat\x00 mat ñ", "the cat sat on the mat"]
    buf, offsets = textscan.column_bytes(pa.array(texts, pa.string()))
    want = [brute_ppm(train, t, order) for t in texts]
    np.testing.assert_allclose(ppm.ContextRows([_model(train, order)], order).costs(buf, offsets)[:, 0], want, rtol=1e-5)
    np.testing.assert_allclose(ppm.ContextTree(*_model(train, order), order).costs(buf, offsets), want, rtol=1e-5)


def test_language(docs, nothing, spark, sf_dir):
    assert op5_language_ppm.identify(nothing).count() == 0
    for r in op5_language_ppm.identify(docs).collect():
        assert r.held_out == crc(r.doc_id, 4) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (0, 1, 2, 14))
    d = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = op5_language_ppm.identify(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_lm_scoring(docs, nothing):
    assert op10_lm_scoring.score(nothing).count() == 0
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [t for i, t in rows if not crc(i, 7)]
    counts = Counter(w for t in train for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    one = op10_lm_scoring.score(docs).collect()
    many = op10_lm_scoring.score(docs, slice_grams=500, frequent=3).collect()
    key = lambda r: (repr(r.doc_id), r.n_tokens, round(r.score, 4))
    got = sorted(one, key=key)
    for a, b in zip(got, sorted(many, key=key), strict=True):
        assert a.score == pytest.approx(b.score) and a.base_score == pytest.approx(b.base_score) and a.n_known == b.n_known
    want = []
    for i, t in rows:
        w = [*words(t), None]
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        want.append((repr(i), len(w), sum(counts[x] > 0 for x in w), base, crc(i, 7)))
    have = [(repr(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.held_out) for r in got]
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == b[4]
    assert {r.train_tokens for r in got} == {total}


def test_lm_score_is_code_length(spark):
    texts = ["the cat sat", "A cat  sat\non the mat", "dogs", "", None, "the the the"]
    got = {r.doc_id: r.score for r in op10_lm_scoring.score(plain_documents(spark, texts), order=3).collect()}
    norm = [" ".join(words(t)) for t in texts]
    train = [t for i, t in enumerate(norm) if not crc(i, 7)]
    for i, t in enumerate(norm):
        assert got[i] == pytest.approx(-brute_ppm(train, t, 3) * math.log10(2), rel=1e-5)


# 6 -----------------------------------------------------------------------------------------------------------------

ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_decontamination_against_brute_force(docs, nothing, spark):
    items = [(1, " ".join(f"alpha{i}" for i in range(5, 30))), (2, "two three"), (10, None), (11, "!!"), (12, "SAME words same"), (2, "omega")]
    bench = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, key string")
    split = lambda t: ITEM_WORD.findall((t or "").translate(LOW))
    got = sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op6_positional_index.decontaminate(docs, bench).collect())
    want = []
    for d in docs.collect():
        w, hit, found = split(d.text), set(), set()
        for i, t in items:
            x = split(t)
            m = min(len(x), 10)
            for a in range(len(x) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == x[a : a + m]:
                        hit |= set(range(p, p + m))
                        found.add(str(i))
        want.append((repr(d.doc_id), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)
    assert op6_positional_index.decontaminate(nothing, bench).count() == 0
    clean = op6_positional_index.decontaminate(docs, bench.where("false")).collect()
    assert len(clean) == docs.count() and not any(r.contaminated for r in clean)
    joined = op6_positional_index.decontaminate(docs, bench, limit=0).collect()  # the shuffled way
    assert sorted(r.n_hit for r in joined) == sorted(w[2] for w in want)
    near = op6_positional_index.proximity_matches(docs, bench, slop=1).collect()
    assert {r.doc_id for r in near} >= {d.doc_id for d, w in zip(docs.collect(), want, strict=True) if w[5]}


# 7, 8 --------------------------------------------------------------------------------------------------------------


def test_tokens_against_library(docs, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op7_token_output.tokenizer_path())
    assert op7_token_output.read_tokens(op7_token_output.write_tokens(nothing)).count() == 0
    got = op7_token_output.read_tokens(op7_token_output.write_tokens(docs, segment=1 << 10)).collect()
    enc = [(r.doc_id, np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")) for r in docs.collect()]
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((repr(i), len(x), zlib.crc32(x.tobytes())) for i, x in enc)
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    tok, cache = Tokenizer.from_file(op7_token_output.tokenizer_path()), op7_token_output.PieceCache(op7_token_output.tokenizer_path())
    odd = ["Éa,Éb! ß×x÷ É́ a's 're-x ('s) x'S 3.14abc1 K ﬁ Ça...va ''s", "don't I'LL we've '90s rock'n'roll", "½x²y ٣a", "a b  ć ́x", "x<|endoftext|>y <|startoftext|> <|", "İSTANBUL Σας", "", "\x1c\x85a", "é 가 "]
    for t in odd:
        out, n = cache.encode(*textscan.column_bytes(pa.array([t], pa.string())), 1)
        assert out.tolist() == tok.encode(t, add_special_tokens=False).ids + [1], t


@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**32])
def test_pfor_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        v = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        v[rng.random(n) < 0.02] = 2**32 - 1
        data = pfor.encode(v)
        assert (pfor.decode(data) == v).all() and (pfor.decode(data, n // 3, n // 2) == v[n // 3 : n // 2]).all()


def test_media(docs, nothing):
    assert op8_media_flac.media_features(op8_media_flac.encode_media(nothing)).count() == 0
    media = op8_media_flac.encode_media(docs).cache()
    want = sorted((repr(r.doc_id), (r.text or "").encode()) for r in docs.collect())
    padded = [b + b"\xff" * (max(-(-len(b) // 576), 1) * 576 - len(b)) for _, b in want]
    got = sorted(op8_media_flac.media_features(media).collect(), key=lambda r: (repr(r.doc_id), r.n_bytes))
    assert sorted((repr(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for (i, b), p in zip(want, padded, strict=True))
    blocks = op8_media_flac.pcm_blocks(media, frames=4).where("doc_id = 11").orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks)[: len(LONG.encode())] == LONG.encode() and [b.sample_offset for b in blocks] == [576 * 4 * i for i in range(len(blocks))]


def test_flac_detects_damage_and_reads_without_seek_table():
    rng = np.random.default_rng(1)
    payload = np.concatenate([rng.integers(0, 256, 576, dtype=np.uint8), np.full(576, 9, np.uint8), (np.arange(1152) % 251).astype(np.uint8)])
    stream = flac.encode(payload, np.array([4]))[0]
    assert (flac.decode([stream])[0][0] == payload).all()
    bare = stream[:4] + bytes([0x80]) + stream[5:42] + stream[46 + 18 * 4 :]
    assert (flac.decode([bare])[0][0] == payload).all()
    for at in (60 + 18 * 4, len(stream) - 5):
        with pytest.raises(ValueError):
            flac.decode([stream[:at] + bytes([stream[at] ^ 4]) + stream[at + 1 :]])


# 9 -----------------------------------------------------------------------------------------------------------------


def brute_groups(rows, n, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def test_near_duplicates_against_brute_force(docs, nothing, spark):
    assert op9_superminhash.near_duplicates(nothing).count() == 0
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for n, percent in ((3, 85), (5, 80)):
        want = brute_groups(rows, n, percent)
        got = op9_superminhash.near_duplicates(docs, words=n, percent=percent).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_large_family_is_compared_completely(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(120):
        t = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 7)):
            t[k] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(t))
    monkeypatch.setattr(op9_superminhash, "BLOCK", 16)
    got = {r.doc_id: r.component_id for r in op9_superminhash.near_duplicates(plain_documents(spark, texts), words=3, percent=85).collect()}
    assert got == brute_groups(list(enumerate(texts)), 3, 85)


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    for n, m in ((30, 64), (700, 64), (5000, 128)):
        pool = rng.integers(1, 2**63, 2 * n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            hits = [np.mean(superminhash.signature(pool[k : n + k], m) == superminhash.signature(pool[k + n // 4 : n + n // 4 + k], m)) for k in range(0, n // 2, max(n // 40, 1))]
        assert np.mean(hits) == pytest.approx(0.6, abs=0.06)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert connected_components(edges.where("false")).count() == 0
