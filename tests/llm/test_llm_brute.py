"""Queries that SQL can't express against plain versions of them."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from compare import connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import embedding_dedup, mixing, packing, quality_classifier, simhash
from keyloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def TOKENS(text):  # noqa: N802
    """A stand-in for a tokenizer: a quarter of the bytes."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def groups(n, linked):
    """Smallest number reachable of each of ``n``, by a plain search."""
    low = [-1] * n
    for i in range(n):
        todo = [i] if low[i] < 0 else []
        while todo:
            j = todo.pop()
            if low[j] < 0:
                low[j] = i
                todo += linked(j)
    return low


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs):
    got = QUERIES["op3_simhash"](spark, SF).toPandas().set_index("doc_id")
    ids = sorted(docs.doc_id)
    texts = docs.set_index("doc_id").text
    prints = np.array([plain_fingerprint(texts[i]) for i in ids], dtype=np.uint64)
    assert [got.fingerprint[i] for i in ids] == [f"{int(p):016x}" for p in prints]
    low = groups(len(ids), lambda j: np.flatnonzero(np.bitwise_count(prints ^ prints[j]) <= 4).tolist())
    assert [got.component_id[i] for i in ids] == [ids[x] for x in low]


@pytest.mark.parametrize("limit", [1, 8, 4096])
def test_simhash_links_at_every_distance(spark, limit):
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    flips = [int(sum(1 << int(b) for b in rng.choice(63, k, replace=False))) for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(20)]
    prints = sorted({int(b) ^ f for b in base for f in flips[:: len(base) // 8]})
    u = np.array(prints, dtype=np.uint64)
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"), limit).collect()
    at = {p: i for i, p in enumerate(prints)}
    # links over a hub of the linear way stand for two short ones: within four bits all the same
    assert links and all(bin((r.a ^ r.b) & M64).count("1") <= 4 for r in links)
    near = defaultdict(list)
    for r in links:
        near[at[r.a]].append(at[r.b])
        near[at[r.b]].append(at[r.a])
    assert groups(len(prints), lambda j: near[j]) == groups(len(prints), lambda j: np.flatnonzero(np.bitwise_count(u ^ u[j]) <= 4).tolist())


def test_finer_signatures_bring_all_links_together(spark):
    """Of two fingerprints within four bits, some finer signature is the same; equal ones agree in a signature and a piece."""
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 200)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = [(b, signed((b & M64) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)))) for b in base for k in (1, 2, 3, 4)]
    df = spark.createDataFrame(pairs, "x long, y long")
    of = lambda c: df.select(F.col(c).alias("fp")).withColumn("__keyloom_signatures", simhash.signatures()).select(simhash.finer_signatures().alias("s")).collect()
    xs, ys = of("x"), of("y")
    assert all(len(set(x.s)) == 64 * 5 and set(x.s) & set(y.s) for x, y in zip(xs, ys, strict=True))


@pytest.mark.parametrize("limit", [2, 4096])
def test_one_row_of_each_component_stays(spark, limit):
    """Repeated ids with other texts, copies under other ids, rows without an id: nothing unique goes, nothing twice stays."""
    rng = np.random.default_rng(limit)
    texts = [" ".join(rng.choice(["red", "oak", "sun", "sea", "cat", "ice", "fox", "gem"], 40)) for _ in range(25)]
    rows = [(3, "A a a b"), (5, "A a a b"), (5, "B q r s t"), (9, "C x"), (9, "D y z"), (9, "C x"), (None, "E only here"), (None, "E only here"), (None, "C x"), (None, None), (11, ""), (12, None)]
    rows += [(int(rng.choice([20, 21, 22, 23, 24, 25])) if rng.random() < 0.8 else None, str(rng.choice(texts))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, __keyloom_n long").repartition(3)
    kept = simhash.drop_near_duplicates(df, bucket_limit=limit)
    assert kept.columns == df.columns
    prints = np.array([plain_fingerprint(t) for _, t in rows], dtype=np.uint64)
    component = groups(len(rows), lambda j: np.flatnonzero(np.bitwise_count(prints ^ prints[j]) <= 4).tolist())
    want = {}
    for n, c in enumerate(component):
        i, text = rows[n]
        rank = (i is None, i or 0, int(prints[n].view(np.int64)), hashlib.md5((text or "").encode()).hexdigest(), text is not None, text or "", n)
        want[c] = min(want.get(c, rank), rank)
    assert sorted(r["__keyloom_n"] for r in kept.collect()) == sorted(r[-1] for r in want.values())


def test_token_counts(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = QUERIES["op5_token_counts"](spark, SF).toPandas().set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        n = len(sp.encode(text or ""))
        assert tuple(got.loc[i]) == (len((text or "").encode()), n, n > 4096)


def test_mixing_meets_its_targets(spark):
    got = QUERIES["op6_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    cells = got.groupby(["source", "lang", "topic"]).agg(w=("mix_weight", "first"), p=("mix_probability", "first"), t=("n_tokens", "sum")).reset_index()
    assert cells.w.sum() == pytest.approx(1)
    # brute force: raking over a full array
    s, l, t = (np.unique(cells[c], return_inverse=True) for c in ("source", "lang", "topic"))
    grid = np.zeros((len(s[0]), len(l[0]), len(t[0])))
    grid[s[1], l[1], t[1]] = cells.t / cells.t.sum()
    shares = mixing.PRODUCTION.shares
    wanted = [grid.sum((1, 2)) ** 0.5, np.array([shares["lang"][x] for x in l[0]]), np.array([shares["topic"][x] for x in t[0]])]
    for _ in range(50):
        for axis, w in enumerate(wanted):
            others = tuple(a for a in range(3) if a != axis)
            shape = [1, 1, 1]
            shape[axis] = -1
            grid = grid * (w / w.sum() / grid.sum(others)).reshape(shape)
    assert np.allclose(grid[s[1], l[1], t[1]], cells.w, rtol=1e-6)
    assert (cells.p * cells.t).sum() == pytest.approx(0.5 * cells.t.sum(), rel=1e-6)
    # tokens, topics and the draw of every document, one by one
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id").text
    for r in got.itertuples():
        text = texts[r.doc_id] or ""
        draw = int(hashlib.md5(f"mix\x01{r.doc_id}\x01{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert (r.n_tokens, r.topic, r.mix_kept) == (len(tokenizer.encode(text, add_special_tokens=False).ids), plain_form(text), draw < r.mix_probability)


def plain_form(text):
    if " | " in text:
        return "table"
    if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2}", text):
        return "contact"
    return "long" if len(text) > 6000 else "short" if len(text) < 800 else "prose"


def test_text_form_is_linear(spark):
    run = "x" * 1_000_000
    texts = [run, run + "@", run + "@a.de", "@" + run, run + "@" + run + ".c", "a@b..de", "é@b.de", "a @b.de", "_@-.zz", "@" * 200_000, "a@b.d e@f.gh"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    df.count()
    began = time.perf_counter()
    got = [r[0] for r in df.select(mixing.text_form(F.col("t"))).collect()]
    assert time.perf_counter() - began < 5
    assert got == ["long", "long", "contact", "long", "long", "contact", "short", "short", "contact", "long", "contact"]


@pytest.mark.parametrize(("budget", "cells"), [(0.2, 100_000), (0.5, 100_000), (0.5, 0)])
def test_mixing_keeps_the_marginals(spark, budget, cells):
    """Where a cell's tokens run out, others of its categories stand in; only topics without enough tokens fall short."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet" if cells else f"{SF}/documents.parquet")
    shares, flatten = mixing.PRODUCTION.shares, mixing.PRODUCTION.flatten
    # on the cluster, two languages of plenty and one source that runs out
    dims = mixing.dimensions() if cells else {"lang": F.col("lang"), "form": F.when(F.col("doc_id") % 5 == 0, "few").otherwise("many")}
    targets = mixing.Targets(shares if cells else {"lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}, "form": {"few": 0.6, "many": 0.4}}, flatten, budget, 50 if cells else 5)
    mixed = mixing.with_mix(docs, dims, TOKENS(docs.text), targets, max_local_cells=cells)
    got = mixing.marginals(mixed, dims, TOKENS(docs.text)).toPandas()
    off = (got.target - got.expected).abs().groupby(got.dimension).sum()
    if not cells:
        local = mixing.with_mix(docs, dims, TOKENS(docs.text), targets).toPandas().sort_values("doc_id")
        assert np.allclose(local.mix_probability, mixed.toPandas().sort_values("doc_id").mix_probability, rtol=1e-6)
        return
    assert off["source"] < 1e-6 and off["lang"] < 1e-6
    if budget == 0.2:
        assert off["topic"] < 1e-6
    else:
        # short and contact texts are taken whole and still too few
        tokens = mixed.groupBy(mixing.text_form(docs.text).alias("t")).agg(F.sum(TOKENS(docs.text)).alias("n")).toPandas().set_index("t").n
        topic = got[got.dimension == "topic"].set_index("category")
        lacking = [t for t in topic.index if tokens[t] < topic.target[t] * budget * tokens.sum()]
        assert {"short", "contact"} <= set(lacking)
        assert off["topic"] == pytest.approx(2 * sum(topic.target[t] - tokens[t] / (budget * tokens.sum()) for t in lacking), abs=1e-3)


def test_mixing_on_the_cluster_is_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = mixing.Targets(mixing.PRODUCTION.shares, mixing.PRODUCTION.flatten, 0.5, 4, 0.0)
    local, wide = (mixing.with_mix(docs, mixing.dimensions(), TOKENS(docs.text), few, max_local_cells=n).toPandas().sort_values("doc_id") for n in (100_000, 0))
    assert np.allclose(local.mix_weight, wide.mix_weight, rtol=1e-9)
    assert np.allclose(local.mix_probability, wide.mix_probability, rtol=1e-6)


def test_classifier_on_held_out_labels(spark):
    got = QUERIES["op7_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    rows = got.merge(labels, on="doc_id")
    rows = rows[[zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]]
    assert rows.held_out.all()
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.98
    assert (rows.predicted == rows.quality).mean() > 0.95
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()


M64 = (1 << 64) - 1


def plain_features(text):
    """The classifier's features, n-gram by n-gram."""
    base, data = int(quality_classifier._BASE), (text or "").encode()

    def number(code, kind):
        x = (code + kind * 0xD6E8FEB86659FD93) & M64
        return (((x ^ (x >> 32)) * 0xBF58476D1CE4E5B9) & M64) >> (64 - quality_classifier.BITS)

    def kind_of(b):
        c = chr(b)
        return 7 if b > 127 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in " \t\n\v\f\r" else 5 if c in "!?" else 6

    three = [int.from_bytes(data[i : i + 3], "little") for i in range(len(data) - 2)]
    out = {number(c, 1) for c in three} | {number(a | b << 24, 2) for a, b in zip(three, three[2:], strict=False)}
    runs = [k for i, k in enumerate(map(kind_of, data)) if not i or kind_of(data[i - 1]) != k]
    words = [sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(w)) & M64 for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    out |= {number(w, 20) for w in words} | {number((a * base + b) & M64, 21) for a, b in zip(words, words[1:], strict=False)}
    same = [int(a == b) for a, b in zip(words, words[1:], strict=False)]
    for items, bits, orders, kind in ((runs, 3, range(2, 6), 10), (same, 1, range(2, 5), 30)):
        for n in orders:
            for i in range(len(items) - n + 1):
                code = 0
                for x in items[i : i + n]:
                    code = (code << bits) | x
                out.add(number(code, kind + n))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 2, 5, 64, 1 << 20])
def test_features_are_those_of_the_whole_text(block, docs):
    rng = np.random.default_rng(block)
    texts = [None, "", " ", "a", "ab cd", "w" * 700 + " " + "w" * 700, *["".join(rng.choice(list(a), 300)) for a in ("ab ", "aB1! é?\n", "x", "a  ")]]
    texts += [t[:3000] for t in docs.text[:5] if t]
    for t in texts:
        assert quality_classifier.features(t, block=block).tolist() == plain_features(t)


def test_features_of_a_very_long_text():
    rng = np.random.default_rng(2)
    text = " ".join("".join(rng.choice(list("abcdeé1!"), 9)) for _ in range(120_000)) + "y" * 2_200_000 + " z"
    assert len(text.encode()) > 3 << 20
    assert (quality_classifier.features(text) == quality_classifier.features(text, block=1 << 30)).all()


def plain_scorer(spark, texts, labels):
    """A function of texts: the classifier's score, of training rows, ratios and fit without blocks, batches or hashing in numpy."""
    ranked = labels.where("quality in (0, 1)").select("doc_id", "quality", F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)).alias("rank")).toPandas()
    chosen = [(r.doc_id, int(r.quality)) for r in ranked.sort_values("rank").itertuples() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts.index]
    rows, y = [plain_features(texts[i]) for i, _ in chosen], [q for _, q in chosen]
    counts = [defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)]
    for k, (row, label) in enumerate(zip(rows, y, strict=True)):
        if k % 5 != 4:
            for f in row:
                counts[label][f] += 1
    total = [quality_classifier.SIZE + sum(v - 1 for v in c.values()) for c in counts]
    ratio = lambda f: np.log(counts[1][f] / total[1]) - np.log(counts[0][f] / total[0])
    unit = lambda row: (v := np.array([ratio(f) for f in row])) / max(np.sqrt(v @ v), 1e-300)
    fit = [k for k in range(len(rows)) if k % 5 != 4]
    ones = sum(y[k] for k in fit)
    cost = np.array([len(fit) / (2 * (ones if y[k] else len(fit) - ones)) for k in fit])
    w, bias = quality_classifier.dual_coordinate_descent([np.array(rows[k]) for k in fit], [unit(rows[k]) for k in fit], np.array([1.0 if y[k] else -1.0 for k in fit]), cost, quality_classifier.SIZE)
    margin = lambda row: float(w[row] @ unit(row)) + bias if row else bias
    held = [k for k in range(len(rows)) if k % 5 == 4]
    slope, shift = quality_classifier._logistic(np.array([margin(rows[k]) for k in held]), np.array([y[k] for k in held]))
    return lambda text: 1 / (1 + np.exp(-(slope * margin(plain_features(text)) + shift)))


def test_classifier_query_is_that_of_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = docs.toPandas().set_index("doc_id").text
    score = plain_scorer(spark, texts, labels)
    got = QUERIES["op7_quality_classifier"](spark, sf).toPandas().set_index("doc_id")
    some = texts.index[:60]
    assert np.allclose([got.score[i] for i in some], [score(texts[i]) for i in some], atol=1e-4)


def plain_packing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins[bins.index(min(fits))] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def check_packing(got, texts, capacity=2048):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lengths, filled = [], defaultdict(list)
    for (doc, text), own in zip(sorted(texts.items()), (g for _, g in got.sort_values(["doc_id", "piece"]).groupby("doc_id")), strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert own.piece.tolist() == list(range(-(-len(ids) // capacity)))
        for r in own.itertuples():
            part = ids[r.piece * capacity : (r.piece + 1) * capacity]
            assert (r.doc_id, r.start, r.length, r.ids_crc32) == (doc, r.piece * capacity, len(part), zlib.crc32(part.tobytes()))
            lengths.append(len(part))
            filled[r.sequence_id].append((r.offset, r.length))
    free = []
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        free.append(capacity - at)
    assert sorted(free) == plain_packing(lengths, capacity)


def test_packing(spark, docs):
    check_packing(QUERIES["op8_packing"](spark, SF).toPandas(), dict(zip(docs.doc_id, docs.text, strict=True)))


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_decreasing_is_exact(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([5, 16, 33]))
    lengths = rng.integers(1, capacity + 1, rng.integers(0, 80)).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, bins = packing.best_fit_decreasing(counts, capacity)
    used = defaultdict(int)
    for n, count in counts.items():
        own = runs[runs[:, 0] == n]
        for rank in range(count):
            run = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            used[int(run[2] + rank - run[1])] += n
    assert len(used) == bins
    assert sorted(capacity - v for v in used.values()) == plain_packing(lengths, capacity)


@pytest.mark.parametrize("text", ["The  end's!!", "É ÀÿØ ß ½ º µ", "a<|endoftext|>b", "日本 é ΑΣ İ", "'LL 12 _x_\t\n\r", "\x1c a b", ""])
def test_word_ids_are_the_tokenizers(text):
    path = P.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encode_texts(path, [text])[0], "<u4").tolist() == want


def plain_links(vectors):
    x = np.array(vectors, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    return linked


@pytest.mark.parametrize("block", [16, 2048])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    sizes = [150, 40, *[3] * 20, *[1] * 38]
    rows = np.concatenate([c + 0.08 * rng.standard_normal((n, 16)) for c, n in zip(centres, sizes, strict=True)]).astype(np.float32)
    rows = np.concatenate((rows, rows[:30])).tolist()
    got = embedding_dedup.embedding_components(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>"), block=block).toPandas().sort_values("vec_id")
    linked = plain_links(rows)
    assert got.n_links.sum() >= 0.97 * linked.sum() and (got.n_links.to_numpy() <= linked.sum(axis=1)).all()
    low = groups(len(rows), lambda j: np.flatnonzero(linked[j]).tolist())
    assert (got.component_id.to_numpy() == np.array(low)).mean() > 0.97


def near_the_threshold(n, dim, rng):
    """Groups of four, each vector at a cosine of 0.88 to 0.99 from a centre: thousands of links near 0.9, and as many misses."""
    centres = rng.standard_normal((n // 4, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    base = np.repeat(centres, 4, axis=0)
    other = rng.standard_normal(base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.93, 0.99, (len(base), 1))
    return (cosine * base + np.sqrt(1 - cosine**2) * other).astype(np.float32)


@pytest.mark.parametrize("per_cell", [512, 32])
def test_embedding_recall_near_the_threshold(spark, monkeypatch, per_cell):
    monkeypatch.setattr(embedding_dedup, "PER_CELL", per_cell)
    rows = near_the_threshold(8_000, 64, np.random.default_rng(9))
    linked = plain_links(rows)
    degree = linked.sum(axis=1)
    assert degree.sum() > 4_000
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())], "vec_id long, embedding array<float>").repartition(4)
    got = embedding_dedup.embedding_components(df).toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy() <= degree).all()
    assert got.n_links.sum() >= 0.95 * degree.sum()
    # components are those of the links that were found
    low = np.array(groups(len(rows), lambda j: np.flatnonzero(linked[j]).tolist()))
    complete = np.array([got.n_links.to_numpy()[low == low[i]].sum() == degree[low == low[i]].sum() for i in range(0, len(rows), 16)])
    assert (got.component_id.to_numpy()[::16][complete] == low[::16][complete]).all() and complete.mean() > 0.85


def test_embedding_query(spark):
    got = QUERIES["op10_embedding_dedup"](spark, SF).toPandas().sort_values("vec_id")
    linked = plain_links(spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id").embedding.tolist())
    assert got.n_links.sum() >= 0.9 * linked.sum() and (got.n_links.to_numpy() <= linked.sum(axis=1)).all()


def test_pipeline(spark):
    """Every stage against a plain version of it, on its own input."""
    import corpus_pipeline as c

    source, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stages, seen = dict(c.STAGES), [source]
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == source.columns, name
        seen.append(out.cache())
    rows = [{r.doc_id: r for r in df.collect()} for df in seen]
    ids = [set(r) for r in rows]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    # the classifier
    texts = source.toPandas().set_index("doc_id").text
    score = plain_scorer(spark, texts, labels)
    scores = {i: score(texts[i]) for i in ids[0]}
    assert all((i in ids[1]) == (x >= 0.3) for i, x in scores.items() if abs(x - 0.3) > 1e-3)
    # the rules, by their SQL over what the classifier kept
    con = connect(SF)
    con.register("kept_documents", seen[1].toPandas())
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM kept_documents")
    assert ids[2] == {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op1_quality_rules']}) WHERE kept").fetchall()}
    # near-dedup
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows[2].values()}
    order = sorted(prints)
    u = np.array([prints[i] for i in order], dtype=np.uint64)
    low = groups(len(order), lambda j: np.flatnonzero(np.bitwise_count(u ^ u[j]) <= 4).tolist())
    assert ids[3] == {order[x] for x in low}
    # the mixture: tokens and cells, raked, and the draw
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    cells = defaultdict(int)
    cell = {i: (r.source, r.lang, plain_form(r.text or "")) for i, r in rows[3].items()}
    for i, r in rows[3].items():
        cells[cell[i]] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
    names = sorted(cells)
    chances = dict(zip(names, mixing.rake([(*n, float(cells[n])) for n in names], ("source", "lang", "topic"), mixing.PRODUCTION)[1], strict=True))
    draw = lambda r: int(hashlib.md5(f"mix\x01{r.doc_id}\x01{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / (1 << 52)
    assert ids[4] == {i for i, r in rows[3].items() if draw(r) < chances[cell[i]]}
    packed = c.run(spark, SF).toPandas()
    check_packing(packed, {r.doc_id: r.text for r in rows[4].values()})
    assert list(stages)[-1] == "best-fit packing"
