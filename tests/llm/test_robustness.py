"""Null and repeated ids, ties, empty and very long texts, clashing columns, for each operator and for every stage of the pipeline."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from leadframe.llm import common, exact_dedup, langid, ngram_join, packing, sharding, spotsigs, tokens, toxicity, warc

LONG = "the night of day and moon " * 60_000  # 1.6 million characters
RUN = "ab" * 400_000
ROWS = [
    (1, "the house of night"), (1, "the house of night"), (1, "the house of night"), (None, "the house of night"), (None, None), (None, "nul and void of the day"), (None, "nul and void of the day"),
    (5, "tie of one and the day"), (4, "tie of one and the day"), (6, ""), (7, None), (8, LONG), (9, RUN), (8, "same id with the other text of day"), (-(2**63), "least of the long and the day"), (2**63 - 1, "greatest of the long and the day"),
]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, slot long, shard int, n long, item long, chunk long, label int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else None, "s", 1, 2, "k", 3, 4, 5, 6, 7, 8) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, CLASH).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def many(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_parts_are_bounded_in_bytes_and_whole():
    import pyarrow as pa

    texts = ["x" * 10, None, "y" * 3_900_000, "z" * 200_000, "w" * 9_000_000] + ["v"] * 2500
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "i": pa.array(range(len(texts)))})
    parts = list(common.small_parts([batch, batch.slice(0, 0)]))
    assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or p.num_rows <= common.PART_ROWS and sum(len(t or "") for t in p.column("text").to_pylist()) <= common.PART_BYTES for p in parts)


def test_stored_tables_leave_settings_alone_and_go_with_their_run(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    there = lambda path: common.hadoop_path(spark, path)[0].exists(common.hadoop_path(spark, path)[1])
    with common.run_folder(spark, "try"):
        path = common.fresh_path(spark, "one")
        assert common.stored(spark.range(3), "one", path).count() == 3 and there(path)
    assert not there(path) and [spark.conf.get(n) for n in names] == before


def test_joins_of_hot_keys(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 3000), (2, 3), (3, 1), (4, 2)) for i in range(n)], "k long, i long")
    groups = spark.createDataFrame([(1, 3000, "a"), (2, 3, "b"), (3, 1, "c")], "k long, n long, v string")
    for how in ("inner", "left"):
        got = Counter((r["k"], r["v"]) for r in common.joined(rows, groups, ["k"], 3006, how).collect())
        assert got == {(1, "a"): 3000, (2, "b"): 3, (3, "c"): 1} | ({(4, None): 2} if how == "left" else {})
    assert common.joined(rows, groups, ["k"], 3006, "left_semi").count() == 3004
    plan = common.joined(rows, groups, ["k"], 3006)._jdf.queryExecution().optimizedPlan().toString()
    assert "(n#" in plan and "* 1000) > 3006" in plan


def test_exact_dedup(docs, empty):
    text = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
    want, kept = Counter(), 0
    for i, t in ROWS:
        same = [(-len(u or ""), j is None, j or 0) for j, u in ROWS if text(u) == text(t)]
        best = min(same)
        want[i, None if best[1] else best[2], len(same), hashlib.sha256(text(t).encode()).hexdigest()] += 1
        kept += 1 / len(same)
    got = exact_dedup.exact_dedup(docs)
    assert many(got, "doc_id", "keep_id", "group_size", "text_sha256") == want and got.where("kept").count() == round(kept)
    one = exact_dedup.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == round(kept) and exact_dedup.one_of_each(empty).count() == 0


def test_language_id(docs, empty):
    got = langid.predict_held_out(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ROWS)
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == "und" for r in got) == sum(not (t or "") for _, t in ROWS)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (4, 5)}) == 1
    assert langid.predict_held_out(empty).count() == 0


def test_tied_languages_take_the_first_name(spark):
    rows = [(i, "same words in both", lang) for i, lang in enumerate(["xx", "aa"] * 20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table)
    model.probs[:, 1] = model.probs[:, 0]
    assert {r["lang_pred"] for r in langid.identify(table, model).collect()} == {"aa"}


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces or k == 1:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k] if word[:k] in pieces else "?", *rest]


def test_fit_is_expectation_maximisation():
    """Two rounds against counting the pieces of every segmentation of every word."""
    pieces, words = ["a", "b", "ab", "bca", "cab"], ["ab", "abcab", "cabbca", "aab", "c"]
    counts = np.array([[3.0, 1], [2, 0], [1, 5], [4, 1], [0, 2]])
    names = ["?", *sorted(pieces)]
    probs = np.full((len(names), 2), 1 / len(names))
    for _ in range(2):
        got = np.zeros_like(probs)
        for w, n in zip(words, counts):
            ways = [[names.index(p) for p in s] for s in segmentations(w, pieces)]
            for lang in range(2):
                weight = [math.prod(probs[p, lang] for p in way) for way in ways]
                for way, x in zip(ways, weight):
                    for p in way:
                        got[p, lang] += n[lang] * x / sum(weight)
        got += langid.FLOOR * got.sum(0)
        probs = got / got.sum(0)
    assert np.allclose(langid.Model(["x", "y"], pieces).fit(words, counts, rounds=2).probs, probs)
    model = langid.Model(["x", "y"], pieces, probs)
    want = [[math.log(sum(math.prod(probs[names.index(p), lang] for p in s) for s in segmentations(w, pieces))) for lang in range(2)] for w in words]
    assert np.allclose(model.word_scores(words), want)


def test_pieces_of_the_whole_vocabulary_are_found():
    vocabulary = langid.vocabulary()
    found = langid.Pieces(vocabulary)
    ids = {p: i for i, p in enumerate(sorted(set(vocabulary)), 1)}
    draw = np.random.default_rng(1)
    words = ["".join(draw.choice(list("abcdeinrstéü"), 12)) for _ in range(300)] + [p for p in vocabulary if len(p) == 12]
    for k, table in enumerate(found.lattice(words), 1):
        assert [[ids.get(w[i : i + k], 0) for i in range(12 - k + 1)] for w in words] == table.tolist()
    longest = max(vocabulary, key=len)
    assert found.longest == len(longest) and found.lattice([longest])[-1][0, 0] == ids[longest]


def test_long_runs_are_scored_whole(monkeypatch):
    pieces = ["a", "b", "ab", "aba", "bbab", "abababababab"]
    probs = np.random.default_rng(0).dirichlet(np.ones(7), 3).T
    model = langid.Model(["x", "y", "z"], pieces, probs)
    draw = np.random.default_rng(2)
    for n in (1, 5, 33, 200):
        word = "".join(draw.choice(list("abc"), n))
        want = np.log(langid.forward(model.pieces.lattice([word]), probs)[-1, 0])
        for stretch in (1 << 14, 7, 13):
            monkeypatch.setattr(langid, "STRETCH", stretch)
            assert np.allclose(langid.long_score(model.pieces, word, probs), want)
    assert np.isfinite(langid.long_score(model.pieces, "ab" * 5000, probs)).all()


def test_texts_of_no_known_language_are_rejected(spark):
    draw = np.random.default_rng(3)
    known = {"en": "the house of night and day with moon under water over stone".split(), "fr": "la maison du soir et le jour avec lune sous eau sur pierre".split()}
    rows = [(i, " ".join(draw.choice(known[lang], 40)), lang) for i, lang in enumerate(["en", "fr"] * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table)
    assert np.isfinite(model.levels).all()
    asked = [(i, t) for i, t, _ in rows] + [(1000, " ".join(draw.choice("xkqz wvvj pfgh zzyx qqkk jxjx".split(), 40))), (1001, "это русский текст без общих слов " * 5), (1002, rows[0][1] + " " + rows[1][1])]
    kept = langid.in_known_language(spark.createDataFrame(asked, "doc_id long, text string"), model, 0.5)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in asked} - {1000, 1001}  # mixed known languages stay
    only = langid.in_known_language(spark.createDataFrame(asked, "doc_id long, text string"), model, 0.5, ("fr",))
    assert {r["doc_id"] for r in only.collect()} - {1002} == {i for i, _, lang in rows if lang == "fr"}


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert all(len({(r["shard"], r["grown_shard"]) for r in got if r["doc_id"] == i}) == 1 for i in {i for i, _ in ROWS})
    assert sharding.shard_documents(empty).count() == 0


def test_a_changed_weight_moves_rows_of_its_own_subtree_only(spark):
    from pyspark.sql import functions as F

    before = sharding.tree_of(16)
    after = {g: {r: dict(s) for r, s in racks.items()} for g, racks in before.items()}
    after["g0"]["r1"][5] = 3.0
    key = F.col("id").cast("string")
    rows = [tuple(r) for r in spark.range(20_000).select(sharding.shard_of(key, before), sharding.shard_of(key, after)).collect()]
    moved = [(a, b) for a, b in rows if a != b]
    assert moved and all(b == 5 or a // 4 == b // 4 == 1 or b // 8 == 0 for a, b in moved)  # into the heavier shard, its rack or its region
    assert {a for a, b in moved if a // 8 == 1} and all(b // 8 == 0 for a, b in moved if a // 8 == 1)
    share = Counter(b for _, b in rows)
    assert 2 < share[5] / np.mean([share[s] for s in range(16) if s != 5]) < 4


def test_ngram_join(docs, empty, monkeypatch):
    for rows in (1000, 2):
        monkeypatch.setattr(common, "PART_ROWS", rows)
        got = many(ngram_join.similar_groups(docs), "doc_id", "component_id")
        assert got == Counter((i, {5: 4}.get(i, i)) for i, _ in ROWS)  # a null id is linked with nothing, rows of one id are one node
    one = ngram_join.one_of_each(docs)
    assert one.columns == docs.columns
    texts = Counter(r["text"] for r in one.collect())
    assert all(texts[t] == (1 if t and t.strip() else n) for t, n in Counter(t for _, t in ROWS).items())
    assert ngram_join.one_of_each(empty).count() == 0


def test_counts_of_shared_shingles_do_not_depend_on_chunks_or_ranges(spark, monkeypatch):
    """Items carry the full hash at every size, and the same document counts however rows are cut."""
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(draw.choice(words, 25))) for i in range(60)] + [(100 + i, "one line that all of them share " + words[i % 30]) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    seen = Counter(s for _, t in rows for s in {tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)})
    results = []
    for part, size in ((1000, 12_000_000), (7, 12_000_000), (1000, 300), (3, 40)):
        monkeypatch.setattr(common, "PART_ROWS", part)
        monkeypatch.setattr(ngram_join, "RANGE_BYTES", size)
        got = {r["doc_id"]: r["items"] for r in ngram_join.shared_items(table, ngram_join.shingler(2), 1, 100).collect()}
        results.append(got)
        for i, t in rows:
            own = {tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)}
            levels = sorted(int(math.log2(seen[s])) for s in own if seen[s] > 1)
            assert [x >> ngram_join.BITS for x in got[i]] == levels and sorted(got[i]) == got[i]
    assert all(r == results[0] for r in results) and len({x & (1 << 58) - 1 for v in results[0].values() for x in v}) == sum(n > 1 for n in seen.values())
    assert max(x & (1 << 58) - 1 for v in results[0].values() for x in v) > 1 << 56  # not cut to fewer bits


def test_large_components_in_blocks(spark, monkeypatch):
    """A chain of loosely linked documents, too large for a block, against all pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 6)
    draw = np.random.default_rng(6)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(70):
        words = list(base)
        for at in draw.integers(0, 40, draw.integers(0, 9)):
            words[at] = f"x{draw.integers(0, 12)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 2]) for k in range(39)} for _, t in rows]
    root = list(range(70))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(70), 2):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 8, 10).collect()}
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < 70


def test_fingerprints(docs, empty):
    got = spotsigs.with_edits(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t in ROWS)
    own = {t: {r["fingerprint"] for r in got if (r["doc_id"], r["n_chars"]) == (i, len(t))} for i, t in ROWS if t}
    assert own["tie of one and the day"] == {r["fingerprint"] for r in got if r["doc_id"] in (4, 5)} and len(own["the house of night"]) == 1
    first = next(r for r in got if r["doc_id"] == 4)
    assert first["edited_sha256"] == hashlib.sha256(b"tie of one " + b"tie of one ").hexdigest() and first["near_next"] == 1  # 5 follows, with the same text
    assert spotsigs.with_edits(empty).count() == 0
    assert many(spotsigs.alike(docs), "doc_id", "class_id") == Counter((i, {5: 4, 7: 6, 2**63 - 1: -(2**63)}.get(i, i)) for i, _ in ROWS) and spotsigs.alike(empty).count() == 0


def test_toxicity(docs, empty, spark):
    labels = spark.createDataFrame([(i, k) for i in range(60) for k in ([1] if i % 3 == 0 else [0])] + [(None, 1), (3, 0), (4, None)], "doc_id long, toxic int")
    got = toxicity.predict_held_out(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5)}) == len({r["score"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert toxicity.predict_held_out(empty, labels).count() == 0


def test_ftrl_against_one_coordinate_at_a_time():
    draw = np.random.default_rng(7)
    rows = [np.unique(draw.integers(0, 30, draw.integers(1, 12))) for _ in range(80)]
    labels, weights = draw.integers(0, 2, 80), draw.random(80)
    alpha, beta, l1, l2, bits = 0.15, 1.0, 1.0, 1.0, 5
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(4):
        for k in order.permutation(80):
            at = [*rows[k].tolist(), 32]
            w = [weight(i) for i in at]
            g = (1 / (1 + math.exp(-sum(w))) - labels[k]) * weights[k]
            for i, x in zip(at, w):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * x
                n[i] += g * g
    got = toxicity.fit(rows, labels, weights, bits)
    assert np.allclose(got, [weight(i) for i in range(33)]) and (got == 0).any()


def test_features_are_words_neighbours_and_skips():
    h = [xx for xx in toxicity.word_hashes(["a", "b", "c", "a"])]
    assert len(toxicity.features(np.array(h, "u8"))) == 4 + 3 + 2
    one, other = (set(toxicity.features(np.array([h[i] for i in order], "u8")).tolist()) for order in ((0, 1, 2), (0, 2, 1)))
    assert len(one & other) == 3  # the words; a-b and a-c are a neighbour here and a skip there
    assert toxicity.features(np.zeros(0, "u8")).tolist() == []


def test_byte_bpe(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.read_ranks(tokens.default_path()), special_tokens={})
    want = Counter()
    for i, t in ROWS:
        t = t or ""
        ids = enc.encode_ordinary(t) if len(t) < 10**6 or " " in t else None
        want[i, len(ids) if ids is not None else None, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = many(tokens.round_trip_digests(docs), "doc_id", "n_tokens", "decoded_sha256")
    assert got == want
    assert tokens.round_trip_digests(empty).count() == 0


SPECIAL = ["hi <|endoftext|> there", "<|startoftext|>", "<|ENDOFTEXT|> a", "<|endoftext|><|endoftext|>é", "x<|startoftext|>y's <| endoftext |>"]


def test_packing(docs, empty, spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(packing.default_path())
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(SPECIAL)], "doc_id long, text string"))
    rows = packing.pack(table).collect()
    want = Counter()
    for i, t in [*ROWS, *((100 + i, t) for i, t in enumerate(SPECIAL))]:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            want[i, at, min(2048, len(ids) - at), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o[0] for o in own] == list(np.cumsum([0] + [o[1] for o in own])[:-1]) and sum(o[1] for o in own) <= 2048
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("few", [10**6, 0])
def test_warc(spark, monkeypatch, few):
    """A payload that most pages have, repeated and null ids, with payloads to refer to broadcast and shuffled."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    rows = [(i, f"http://h{i % 5}.example.com/{i}", "<p>404</p>" if i % 3 else f"<p>{i}</p>") for i in range(90)]
    rows += [(7, "http://h.example.com/7", "<p>404</p>"), (89, "http://h.example.com/89", "<p>404</p>"), (None, None, "<p>404</p>"), (None, "http://x.example.com/", None), (200, "http://y.example.com/a\r\nb", None)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, key int, first string").repartition(4)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = Counter()
    for i, _, t in rows:
        last = max((j for j, _, u in rows if (u or "") == (t or "") and j is not None), default=None)
        revisit = i is not None and last is not None and i != last
        want[i, len(t or ""), digest(t), "revisit" if revisit else "response", last if revisit else None] += 1
    assert many(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want


def test_warc_files_are_members_with_digests(spark):
    """What another reader needs: a warcinfo record first, whole gzip members, lengths, and digests of blocks."""
    import gzip

    root = common.fresh_path(spark, "warc")
    lines = warc.write_archives(spark.createDataFrame([(1, "http://a.example.com/", "x"), (2, "http://b.example.com/", "x")], "page_id long, url string, html string").coalesce(1), root).collect()
    path = lines[0]["path"]
    system, where = warc.file_system(path)
    data = system.open_input_file(where).read()
    whole, kinds = gzip.decompress(data), []
    while whole:
        head, rest = whole.split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block, whole = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
        assert whole.startswith(b"\r\n\r\n") and fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        kinds.append((fields["WARC-Type"], fields.get("WARC-Refers-To-Target-URI")))
        whole = whole[4:]
    assert kinds[0] == ("warcinfo", None) and sorted(kinds[1:], key=str) == [("response", None), ("revisit", "http://b.example.com/")]


def test_pipeline_stages(docs, empty, spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, int(i == 5)) for i in range(10)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        before, after = (Counter((r["doc_id"], r["text"]) for r in x.collect()) for x in (docs, out))
        assert not after - before and after, name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    packed = pipeline.STAGES[-1][1]
    assert packed(spark, empty, str(tmp_path)).count() == 0 and packed(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len({i for i, _ in ROWS})


def test_pipeline_against_brute_force(spark, tmp_path):
    """The whole run over planted documents: toxic, foreign, exact and near copies go, all others stay and are packed whole."""
    pipeline = pytest.importorskip("corpus_pipeline")
    draw = np.random.default_rng(8)
    words = {"en": [f"th{a}{b}" for a in "aeiou" for b in "nrst"], "fr": [f"qu{a}{b}" for a in "aeiou" for b in "lmx"]}
    make = lambda lang, n=60: " ".join(draw.choice(words[lang], n))
    clean = [(i, make("en" if i % 2 else "fr"), "en" if i % 2 else "fr") for i in range(160)]
    toxic = [(1000 + i, make("en") + " you vile idiot scum you vile idiot scum", "en") for i in range(60)]
    foreign = [(2000 + i, " ".join(draw.choice(["zzkk", "wvwx", "jjqz", "xkxk"], 60)), None) for i in range(5)]
    copies = [(3000 + i, clean[i][1] + "  \n", clean[i][2]) for i in range(10)]
    near = [(4000 + i, clean[20 + i][1] + " thas", clean[20 + i][2]) for i in range(10)]
    rows = [(i, t, lang, "s", len(t)) for i, t, lang in clean + toxic + foreign + copies + near]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(1000 <= i < 2000)) for i, *_ in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    kept = {i for i, *_ in clean} - {i for i in range(10)} | {3000 + i for i in range(10)}  # of equal texts the longest stays, of linked ones the smallest id
    assert {r["doc_id"] for r in got} == kept
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(packing.default_path())
    texts = {i: t for i, t, *_ in rows}
    for i in kept:
        assert sum(r["length"] for r in got if r["doc_id"] == i) == len(library.encode(texts[i], add_special_tokens=False).ids) + 1
