"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import math
import re
import tempfile

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from keyloom.llm import chat, embedding_dedup, mixing, packing, quality_classifier, quality_rules, simhash, token_counts, url_filter, warc
from keyloom.llm.components import connected_components
from keyloom.llm.token_counts import vocabulary_path

PROSE = "The cat of the house was on the roof and it is that for a day in the sun to see . "
LONG = PROSE * 12_000
#: Columns that clash with names that operators use inside or return.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, label int, score double, n_words long, fp long, w string, part int, length long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", None, None, "x", 1, 0.5, 7, 3, "w", 2, 9) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, PROSE * 3), (5, PROSE * 3), (None, PROSE * 3), (None, None), (6, "é"), (7, "\x00�\U0001f600")]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


#: Two made languages: shares of two common words each, and of character classes.
REFS = quality_rules.References(
    ("aa", "bb"), ((0.8, 0.02, 0.005, 0.155, 0.0, 0.02), (0.75, 0.05, 0.005, 0.175, 0.0, 0.02)),
    ("der", "of", "the", "und"), ((0.0, 0.15, 0.25, 0.0), (0.2, 0.0, 0.0, 0.1)))


def test_quality_rules(spark, odd, none):
    for refs in (REFS, quality_rules.References()):
        got = quality_rules.with_quality(odd, refs, prefix="q_")
        assert got.columns[:13] == odd.columns
        by = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
        assert [by[i].q_n_words for i in (1, 2, 3)] == [0, 0, 0] and all(by[i].q_base_failed and not by[i].q_kept for i in (1, 2, 3))
        assert by[4].q_n_words == 12_000 * len(PROSE.split()) and by[4].q_n_repeat_words == by[4].q_n_words and not by[4].q_kept
        assert quality_rules.with_quality(none, refs, prefix="q_").count() == quality_rules.keep_good(none, refs).count() == 0
        assert quality_rules.keep_good(odd, refs).columns == odd.columns


@pytest.mark.parametrize(("text", "n"), [("a b c d", 0), ("a b c a b c", 6), ("a b c x a b c", 6), ("a a a a", 4), ("a a a", 0), ("a b a b a b x", 6)])
def test_repeat_words(spark, text, n):
    assert quality_rules.with_quality(frame(spark, [(1, text)]), REFS, prefix="q_").first().q_n_repeat_words == n


def test_dup_lines_and_symbols(spark):
    r = quality_rules.with_quality(frame(spark, [(1, "a\n\nb\na\n \n\na # <b>")]), REFS, prefix="q_").first()
    assert (r.q_n_dup_lines, r.q_n_symbols, r.q_word_chars) == (1, 3, 8)


def plain_distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    half = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0.0, (half(p) + half(q)) / 2))


def test_distances_are_jensen_shannon(spark):
    texts = ["The cat, THE dog. of (the) x", "der Hund und die Katze", "1234 $$ ÄÖ é日\t\n", "nothing common here", "the", "of the of the", "?!"]
    rows = {r.doc_id: r for r in quality_rules.with_quality(frame(spark, list(enumerate(texts))), REFS, prefix="q_").collect()}
    for i, t in enumerate(texts):
        words = [w for w in re.split(r'[\x20\x09-\x0D.,;:!?"()]+', t.lower()) if w]
        counts = [sum(map(str.islower, t)), sum(map(str.isupper, t)), sum(map(str.isdigit, t)), sum(c in " \t\n" for c in t), sum(c in quality_rules.SYMBOLS for c in t)]
        classes = [c / len(t) for c in [*counts, len(t) - sum(counts)]]
        for k, lang in enumerate(REFS.languages):
            assert rows[i].q_class_distances[lang] == pytest.approx(plain_distance(classes, REFS.classes[k]))
            if words:
                own = [words.count(v) / len(words) for v in REFS.vocabulary]
                assert rows[i].q_word_distances[lang] == pytest.approx(plain_distance([*own, 1 - sum(own)], [*REFS.words[k], 1 - sum(REFS.words[k])]), abs=1e-7)
        assert rows[i].q_class_distance == min(rows[i].q_class_distances.values())
        assert rows[i].q_word_distances is not None if words else rows[i].q_word_distance is None
    assert quality_rules.without_common_words(0.4) == pytest.approx(plain_distance([0, 1], [0.4, 0.6]))


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_references_are_those_of_good_documents(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", most)
    rows = [(1, "The cat, the DOG", "en"), (1, "the", "en"), (2, "le chat", "fr"), (3, "the junk junk junk", "en"), (4, "no label", "en"), (5, None, "fr"), (6, "none", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, word string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 0), (5, 1), (6, 1), (None, 1)], "doc_id long, quality int")
    refs = quality_rules.references(docs, labels)
    assert refs.languages == ("en", "fr") and refs.vocabulary == ("cat", "chat", "dog", "le", "the")
    assert refs.words == ((0.2, 0.0, 0.2, 0.0, 0.6), (0.0, 0.5, 0.0, 0.5, 0.0))
    assert refs.classes[1] == pytest.approx((6 / 7, 0, 0, 1 / 7, 0, 0)) and [sum(c) for c in refs.classes] == pytest.approx([1, 1])
    assert quality_rules.references(docs, labels.limit(0)) == quality_rules.references(docs.limit(0), labels) == quality_rules.References()


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    refs = quality_rules.references(docs, labels)
    good = quality_rules.with_quality(docs, refs).join(labels.where("quality = 1"), "doc_id").where("not base_failed")
    assert good.where("not kept").count() <= 0.01 * good.count()


def drawn(shares, n, rng):
    """``n`` words by the shares of common words, all others made up."""
    common = rng.choice([*shares, ""], n, p=[*shares.values(), 1 - sum(shares.values())])
    return " ".join(w or "".join(rng.choice(list("bcfghkmprt"), 6)) for w in common)


@pytest.mark.parametrize("n", [60, 300, 5000])
def test_long_texts_without_common_words_fail(spark, n):
    rng = np.random.default_rng(n)
    made = [drawn({}, n, rng) for _ in range(4)]
    clean = [drawn({w: s for w, s in zip(REFS.vocabulary, own, strict=True) if s}, n, rng) for own in REFS.words for _ in range(5)]
    short = [drawn({}, 59, rng)]
    got = quality_rules.with_quality(frame(spark, list(enumerate(made + clean + short))), REFS, prefix="q_").collect()
    assert not any(r.q_base_failed for r in got)
    assert [r.q_kept for r in sorted(got, key=lambda r: r.doc_id)] == [False] * 4 + [True] * 11


def test_simhash(spark, odd, none):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == odd.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {1, 2, 3, None} and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in got if r.doc_id == 5} == {4}  # the long text repeats the same shingles
    assert simhash.simhash_components(none).count() == simhash.drop_near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (200, None), (7, 3), (7, 3)], "a long, b long")
    assert {(r.node, r.root) for r in connected_components(edges).collect()} == {(i, 0) for i in range(51)}
    assert connected_components(edges.limit(0)).count() == 0


def test_token_counts(spark, odd, none):
    path = vocabulary_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r, t in zip(token_counts.count_tokens(odd, path).collect(), odd.collect(), strict=True):
        assert r.n_tokens == len(sp.encode(t.text or "")) and r.n_bytes == len((t.text or "").encode())
    assert token_counts.count_tokens(none, path).count() == 0


@pytest.mark.parametrize("alphabet", ["ab ", "a   ", "x", " ", "abcé日 \n▁", "<s> /☃\U0001f600"])
def test_splicing(alphabet):
    sp, proven = token_counts._loaded(vocabulary_path("piece_bpe_32k.model"))
    assert proven
    rng = np.random.default_rng(3)
    for chunk, overlap in ((5, 1), (20, 3), (60, 10)):
        for _ in range(40):
            text = "".join(rng.choice(list(alphabet), rng.integers(1, 400)))
            assert token_counts.count_long(sp, text, chunk, overlap) == len(sp.encode(text))


def test_mixing(spark, odd, none):
    got = mixing.with_mix(odd, {"source": F.col("source"), "lang": F.col("lang")}, mixing.production_tokens()(F.col("text")), mixing.PRODUCTION)
    assert got.columns == [*odd.columns, "mix_weight", "mix_probability", "mix_kept"] and got.count() == odd.count()
    assert mixing.with_mix(none, {"lang": F.col("lang")}, F.lit(1), mixing.PRODUCTION).count() == 0
    assert mixing.with_mix(odd, {"lang": F.col("lang")}, F.lit(None).cast("long"), mixing.PRODUCTION).where("mix_kept").count() == 0
    assert mixing.with_mix(odd, {"lang": F.col("lang")}, F.lit(None).cast("long"), mixing.PRODUCTION, max_local_cells=0).where("mix_kept or mix_weight > 0").count() == 0
    everything = mixing.Targets(budget=1.0)
    assert mixing.sample_mix(odd, {"lang": F.col("lang")}, F.lit(1), everything).count() == odd.count()


@pytest.mark.parametrize("seed", range(10))
def test_probabilities_meet_the_budget(seed):
    rng = np.random.default_rng(seed)
    tokens, weights = rng.integers(0, 50, 12).astype(float), rng.random(12)
    possible = tokens[weights > 0].sum()
    p = mixing.probabilities(weights, tokens, 0.6 * possible)
    assert (p <= 1).all() and (p * tokens).sum() == pytest.approx(0.6 * possible)


def test_classifier(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (4, 0), (1, None), (99, 1)], "doc_id long, quality int")
    model = quality_classifier.train(odd, labels)
    got = quality_classifier.with_scores(odd, model, score_col="own")
    assert got.columns == [*odd.columns, "own"] and got.count() == odd.count()
    assert all(0 <= r.own <= 1 for r in got.collect())
    assert quality_classifier.with_scores(none, quality_classifier.train(none, labels)).count() == 0
    assert quality_classifier.keep_good(odd, model).columns == odd.columns
    replaced = quality_classifier.with_scores(odd, model)
    assert sorted(replaced.columns) == sorted(odd.columns) and replaced.where("score = 0.5").count() == 0
    repeated = [r.own for r in got.where("doc_id = 5").collect()]
    assert len(repeated) == 2 and len(set(repeated)) == 1


def test_training_rows_are_bounded_before_the_driver(spark, monkeypatch):
    docs = frame(spark, [(5, f"{PROSE} {i}") for i in range(60)] + [(4, LONG[:100])] * 60)
    labels = spark.createDataFrame([(5, 1), (4, 0)], "doc_id long, quality int")
    sizes, whole = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: sizes.append((t := whole(df)).num_rows) or t)
    quality_classifier.train(docs, labels, max_rows=80)
    assert sizes == [80]


def test_dual_coordinate_descent_is_optimal():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    x = rng.standard_normal((60, 5)) + 0.8 * y[:, None]
    w, b = quality_classifier.dual_coordinate_descent([np.arange(5)] * 60, list(x), y, np.full(60, 0.5), 5, rounds=500)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    assert all(best <= loss(w + d[:5], b + d[5]) + 1e-2 for d in 0.05 * rng.standard_normal((200, 6)))


def test_packing(spark, odd, none):
    path = vocabulary_path("word_bpe_49k.json")
    got = packing.pack(odd, path).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert sorted(r.length for r in got if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert packing.pack(none, path).count() == 0
    filled = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length


def test_packing_with_another_tokenizer():
    from tokenizers import Tokenizer

    import public_tokenizers

    path = vocabulary_path("word_bpe_49k.json")
    other = tempfile.mkdtemp() + "/cased.json"
    parts = json.loads(Tokenizer.from_file(path).to_str())
    parts["normalizer"] = {"type": "NFC"}
    with open(other, "w") as f:
        json.dump(parts, f)
    text = "The  End's\nOF it"
    for p in (other, public_tokenizers.path("word_bpe_49k.json")):
        assert np.frombuffer(packing.encode_texts(p, [text])[0], "<u4").tolist() == Tokenizer.from_file(p).encode(text, add_special_tokens=False).ids


def test_chat_language():
    render = lambda t, **names: "".join(s for s, _ in chat.compile_template(t)(**names))
    assert render("a{{ 'b' ~ 'c' | upper }}{% if 1 == 2 %}x{% elif true and not false %}y{% else %}z{% endif %}") == "abCy"
    assert render("{% for m in ms %}{{ loop.index0 }}{{ m.t }}{% if not loop.last %},{% endif %}{% endfor %}", ms=iter([{"t": "p"}, {"t": "q"}])) == "0p,1q"
    assert render("{{ missing.field }}{{ none }}") == ""
    assert chat.fold(chat.parse("a{{ 'b' }}{% if false %}{{ x }}{% endif %}c")) == [("text", "abc")]
    for bad in ("{{ x.__class__ }}", "{{ __import__ }}", "{{ f(1) }}", "{% for x in y %}", "{% nope %}", "{{ x | nope }}", "{{ 'a' ~ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


@pytest.mark.parametrize("text", ["</s>", "[\\INST]", "\\", "\\\\</s>", "<<s>", "[", "<<<SYS>>", "[INST][/INST]", ""])
def test_chat_escape(text):
    assert chat.unescape(chat.escape(text)) == text and not chat._CONTROL.search(chat.escape(text))


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a</s>"), (1, 1, "assistant", None), (1, 2, None, "x"), (None, 0, "assistant", "[INST]"), (2, 0, "assistant", LONG), (2, 0, "assistant", LONG), (3, 5, "assi\nstant", "<"), (3, 4, "assistant", "\\")]
    turns = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, first string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    want = hashlib.sha256("user\na</s>\nassistant\n\n\nx\n".encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (3, want, 0)
    assert got[None].loss_chars == 6 and got[2].loss_chars == 2 * len(LONG) and got[3].loss_sha256 == hashlib.sha256(b"\\").hexdigest()
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0
    marks = chat.Marks("<s><<SYS>>", "<s>", "[INST]", "</s>")
    other = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns, marks.template()), marks=marks).collect()}
    assert all((other[i].turns_sha256, other[i].loss_sha256) == (got[i].turns_sha256, got[i].loss_sha256) for i in got) and set(other) == set(got)
    prompted = [r.text for r in chat.format_conversations(turns.where("conv_id = 3"), add_generation_prompt=True).collect()]
    assert prompted[-1] == "[INST] assistant [/INST] "


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.1]), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<double>, gid long, cell int")
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(df).collect()))
    assert got == [(-1, 3, 7, False), *[(i, 0, i, True) for i in range(1, 7)], (7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (9, 0, 9, True), (10, 0, 10, True)]
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_traversal_is_nearest_first():
    rng = np.random.default_rng(1)
    x, books = rng.standard_normal((600, 6)), (rng.standard_normal((7, 3)), rng.standard_normal((7, 3)))
    sums = (embedding_dedup._squares(x[:, :3], books[0])[:, :, None] + embedding_dedup._squares(x[:, 3:], books[1])[:, None, :]).reshape(600, -1)
    for reach in (0.0, 0.5, 3.0, np.inf):
        row, cell = embedding_dedup.Index(books, reach).visited(x)
        for i in range(600):
            own = np.argsort(sums[i])
            assert cell[row == i].tolist() == own[sums[i][own] - sums[i].min() <= reach + (1e-12 if reach else 0)].tolist()


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.NET/en/x?utm_source=1#f"), (5, "HTTP://example.com/de/"), (6, "https://x.org/fr/a"), (7, "https://net"), (8, "http://bad.com/p/?ref=1"), (8, "http://bad.com/p/?ref=1"), (9, "http://www.bad.com/p#x"), (10, "http://bad.com/q"), (None, "ftp://a.net/" + "y" * 100_000)]
    pages = spark.createDataFrame([(*r, "b", "h") for r in rows], "page_id long, url string, block string, host string")
    listed = url_filter.listed_urls(spark.createDataFrame([("http://bad.com/p",), (None,), ("nothing",)], "url string"))
    rules = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
    for blocks, most in ((1, 1), (None, 1 << 16), (64, 8)):
        got = sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in url_filter.judge_urls(pages, listed, rules, max_blocks=most, blocks=blocks).collect())
        assert got == [(0, "a.net", "net/", "block"), (1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "a.example.net", "example.net/en/", "allow"), (5, "example.com", "example.com/de/", "block"), (6, "x.org", "org/fr/", "allow"), (7, "net", None, "allow"), (8, "bad.com", None, "block"), (8, "bad.com", None, "block"), (9, "www.bad.com", None, "block"), (10, "bad.com", None, "allow")]
    assert url_filter.judge_urls(pages.limit(0), listed, rules).count() == 0
    assert url_filter.judge_urls(pages, listed.limit(0), rules).where("listed").count() == 0


def test_full_filter_stays_exact(spark):
    """A filter of one block lets nearly all through; the exact join still decides."""
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/"), "id").alias("url"))
    listed = url_filter.listed_urls(pages.where("page_id < 500"))
    for blocks, most in ((1, 1), (None, 1 << 16), (None, 4)):
        assert url_filter.judge_urls(pages, listed, (), max_blocks=most, blocks=blocks).where("verdict = 'block'").count() == 500


def test_the_list_is_used(spark):
    from keyloom.llm.queries import op4_url_filter

    got = op4_url_filter(spark, "/root/testdata/sf0.1")
    assert got.where("rule is null and verdict = 'block'").count() > 0


def test_warc_parts():
    body = bytes(range(256)) * 100
    assert warc.unchunked(warc.chunked(body, 1000)) == body and warc.unchunked(warc.chunked(b"")) == b""
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    assert warc.reassemble([(2, 5, b"de"), (1, None, b"abc")]) == b"abcde"
    for bad in ([(1, None, b"a")], [(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 9, b"b")], [(1, None, b"a"), (1, 2, b"b")]):
        with pytest.raises(warc.ArchiveError):
            warc.reassemble(bad)
    with pytest.raises(warc.ArchiveError):
        warc.unchunked(b"5\r\nabc")
    with pytest.raises(warc.ArchiveError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_warc_round_trip(spark):
    same = "<p>é" + "x" * 200
    rows = [(1, None, None), (2, "http://a\r\nX: y", ""), (3, "u", same), (4, "u", same), (5, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\n" + "é\r\n\r\n" * 40_000), (8, "u", same), (None, "u", same), (3, "u", same)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/archive"
    got = sorted(warc.archived(pages, path=path).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest() and r.payload_bytes == len(html[r.page_id]) for r in got)
    assert [(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"] == [(4, 3), (8, 3)] and len(got) == len(rows)
    whole = {r.key: bytes(r.payload) for r in warc.read_warc(spark, path).collect()}
    assert whole == {None if k is None else str(k): v for k, v in html.items()}  # revisits have the payload of what they name
    assert warc.archived(pages.limit(0)).count() == 0


def one_record(spark, name, rows):
    """An archive of records as they stand, in a plain file."""
    folder = tempfile.mkdtemp(prefix="spark-warc-")
    with open(f"{folder}/{name}", "wb") as f:
        f.write(b"".join(r + warc.END for r in rows))
    return folder


def test_warc_revisits_are_resolved(spark):
    body = b"x" * 300
    digest = hashlib.sha256(body).hexdigest()
    response = list(warc.records("a", "1", "http://u", body, digest, None))
    revisit = list(warc.records("b", "2", "http://v", body, digest, "a", "http://u"))
    lost = list(warc.records("c", "3", "http://w", body, digest, "nowhere"))
    other = list(warc.records("d", "4", "http://w", body, "0" * 64, "a"))
    got = warc.read_warc(spark, one_record(spark, "x.warc", revisit + response)).collect()
    assert sorted((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_key, bytes(r.payload)) for r in got) == [("1", 300, digest, "response", None, body), ("2", 300, digest, "revisit", "1", body)]
    for bad, says in ((lost, "absent record"), (other, "digest")):
        with pytest.raises(Exception, match=says):
            warc.read_warc(spark, one_record(spark, "x.warc", response + bad)).collect()


@pytest.mark.parametrize("packed", [False, True])
def test_large_archives_are_read_in_pieces(spark, packed):
    """One file far larger than a split: plain ones are read by many tasks and put in order."""
    import gzip

    rng = np.random.default_rng(8)
    bodies = [bytes(rng.integers(0, 256, int(n), dtype=np.uint8)) + warc.END * 2 + b"WARC/1.1\r\n" for n in rng.integers(0, 90_000, 150)]
    rows = [r for i, b in enumerate(bodies) for r in warc.records(f"id{i}", str(i), None, b, hashlib.sha256(b).hexdigest(), None)]
    folder = one_record(spark, "big.warc", rows)
    if packed:
        folder2 = tempfile.mkdtemp(prefix="spark-warc-")
        with open(f"{folder2}/big.warc.gz", "wb") as f:
            f.write(b"".join(gzip.compress(r + warc.END) for r in rows))  # a member for each record
        folder = folder2
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        got = {r.key: bytes(r.payload) for r in warc.read_warc(spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {str(i): b for i, b in enumerate(bodies)}


def test_archives_are_the_same_each_time(spark):
    pages = spark.createDataFrame([(i, f"http://u/{i}", "y" * 200 if i % 3 else f"z{i}" * 60) for i in range(20)], "page_id long, url string, html string")
    ids = []
    for _ in range(2):
        path = tempfile.mkdtemp(prefix="spark-warc-") + "/archive"
        warc.write_warc(pages, path)
        ids.append(sorted((r.record_id, r.refers_to_id or "") for r in warc.read_warc(spark, path).collect()))
    assert ids[0] == ids[1] and len({r for r, _ in ids[0]}) == 20


def test_pipeline_stages_take_odd_rows(spark, odd, none):
    """Every stage on nulls, empty and very long texts, repeated rows and clashing columns, and on an empty table."""
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        assert {(r.doc_id, r.text) for r in out.collect()} <= {(r.doc_id, r.text) for r in odd.collect()}, name
        assert stage(spark, none, sf).count() == 0, name
    packed = c.pack(spark, odd, sf).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and c.pack(spark, none, sf).count() == 0


def test_intermediate_tables_are_removed(spark, tmp_path):
    from keyloom.llm import common

    with common.removing(spark):
        df, path = common.written_at(spark.range(3), "x")
        assert df.count() == 3
    with pytest.raises(Exception, match="exist"):
        spark.read.parquet(path).count()
