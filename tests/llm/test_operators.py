"""The ten operators on a small fixture of odd cases, against brute force."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from leadframe.llm import exact_dedup, langid, ngram_join, packing, sharding, spotsigs, token_counts, tokens, toxicity, warc
from leadframe.llm.common import HashCache
from leadframe.llm.graph import components

BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t", "a", "a b", "A  b", "a b c", "the quick brown fox and the lazy dog of the house", BASE, BASE + " tail", "head " + BASE, BASE.replace("word30", "other"),
    BASE + "\n", "Ünï çödé   x  y 　 你好 😀 the end", "x" * 5000, ("long text of the day and night " * 3000).strip(), "<|endoftext|> it's a 'test'", BASE, "word0\x1cword1 word2", "mot pour le monde et la vie",
]
SCHEMA = "extra int, doc_id long, text string, lang string, source string, row long, slot string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, i, t, ["en", "fr", None][i % 3], "s" if i % 2 else None, 7, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def strip(t):
    return "".join(c for c in t or "" if c not in " \t\n\v\f\r")


def test_exact_dedup(docs, empty, spark):
    got = by_id(exact_dedup.exact_dedup(docs))
    for i, t in enumerate(TEXTS):
        same = [j for j, u in enumerate(TEXTS) if strip(u) == strip(t)]
        keep = min(same, key=lambda j: (-len(TEXTS[j] or ""), j))
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(same), i == keep, hashlib.sha256(strip(t).encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(twice).collect()
    assert len(rows) == 4 and sum(r["kept"] for r in rows) == 2 and {r["keep_id"] for r in rows if r["group_size"] == 3} == {1}


def test_sharding(docs, empty, spark):
    rows = sharding.shard_documents(docs).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(TEXTS)}
    many = spark.range(20000).selectExpr("id AS doc_id", "'' AS text")
    rows = sharding.shard_documents(many).collect()
    for shard in range(16):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own))) and 1000 < len(own) < 1500
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {16}
    key = str(rows[0]["doc_id"])

    def pick(names):
        def draw(n):
            u = (xxhash.xxh64_intdigest(n, seed=xxhash.xxh64_intdigest(key, seed=42)) >> 11) + 0.5
            return -np.log(u / 2**53) / names[n]
        return min(names, key=draw)

    tree = sharding.tree_of(16)
    g = pick({g: 8.0 for g in tree})
    r = pick({f"{g}/{r}": 4.0 for r in tree[g]})
    s = pick({f"{r}/{s}": 1.0 for s in tree[g][r.split("/")[1]]})
    assert rows[0]["shard"] == int(s.split("/")[-1])
    assert sharding.shard_documents(empty).count() == 0


def brute_groups(size, num, den):
    def shingles(t):
        w = (t or "").encode().lower().replace(b"\x1c", b"\x1c").split()
        return set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    sets = [shingles(t) for t in TEXTS]
    root = list(range(len(TEXTS)))
    for _ in TEXTS:
        for i, j in itertools.combinations(range(len(TEXTS)), 2):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[i] = root[j] = min(root[i], root[j])
    return [len(s) for s in sets], root


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_ngram_join(docs, empty, monkeypatch, size, num, den):
    sizes, root = brute_groups(size, num, den)
    expected = {i: (sizes[i], root[i]) for i in range(len(TEXTS))}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(ngram_join.similar_groups(docs, size, num, den)).items()} == expected
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 1)
    monkeypatch.setattr(ngram_join, "RANGE_BYTES", 1000)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(ngram_join.similar_groups(docs, size, num, den)).items()} == expected
    assert ngram_join.similar_groups(empty).count() == 0


def test_prefix_tree_against_all_pairs():
    draw = np.random.default_rng(3)
    sets = list({tuple(sorted(draw.choice(60, draw.integers(5, 40), replace=False))) for _ in range(150)})
    arrays = [np.array(s, "i8") for s in sets]
    tree = ngram_join.PrefixTree(arrays, np.array([len(s) for s in sets], "i8"), 5, 10)
    for i, s in enumerate(sets):
        assert sorted(tree.similar(arrays[i], len(s))) == [j for j, u in enumerate(sets) if 10 * len({*s} & {*u}) >= 5 * len({*s} | {*u})]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (7, None)], "u long, v long")
    assert {(r["node"], r["component"]) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_byte_bpe(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.read_ranks(tokens.default_path()), special_tokens={})
    got = by_id(tokens.round_trip_digests(docs))
    coded = tokens.encode(docs)
    full = by_id(coded)
    back = by_id(tokens.decode(coded))
    for i, t in enumerate(TEXTS):
        t = t or ""
        ids = enc.encode_ordinary(t)
        assert full[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() and back[i]["text"] == t
        assert all(a < b for a, b in zip(full[i]["starts"], full[i]["ends"])) and (not ids or full[i]["ends"][-1] == len(t))
    bpe = tokens.byte_bpe(tokens.default_path(), tokens.default_pattern())
    ids = bpe.ids(["ab😀c"])[0]
    assert "".join(bpe.decode_pieces(ids)) == "ab😀c"
    assert tokens.round_trip_digests(empty).count() == 0


def test_packing(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(packing.default_path())
    rows = packing.pack(docs).collect()
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert [o[0] for o in own] == list(np.cumsum([0] + [o[1] for o in own])[:-1]) and sum(o[1] for o in own) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in own) and {r["doc_tokens"] for r in rows if r["doc_id"] == i} == {len(ids)}
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o[0] for o in own] == list(np.cumsum([0] + [o[1] for o in own])[:-1]) and sum(o[1] for o in own) <= 2048
    assert packing.pack(empty).count() == 0


def test_packing_plan_is_whole_and_tight():
    draw = np.random.default_rng(5)
    histogram = Counter(draw.integers(1, 129, 20000).tolist())
    plan = packing.plan(dict(histogram), 128)
    placed = Counter()
    for pattern, repeats in plan:
        assert sum(s * k for s, k in pattern.items()) <= 128
        placed.update({s: k * repeats for s, k in pattern.items()})
    assert placed == histogram
    assert sum(r for _, r in plan) <= 1.02 * sum(s * n for s, n in histogram.items()) / 128 + 5


def test_knapsack_against_brute_force():
    sizes, values = np.array([3, 5, 7]), np.array([0.3, 0.55, 0.7])
    best = max(a * 0.3 + b * 0.55 + c * 0.7 for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 20)
    value, pattern = packing.price(values, sizes, 20)
    assert value == pytest.approx(best) and pattern @ values == pytest.approx(best) and pattern @ sizes <= 20


def test_fingerprints(docs, empty, spark):
    got = by_id(spotsigs.with_edits(docs))
    cache = HashCache(spotsigs.word_values)
    for i, t in enumerate(TEXTS):
        t, after = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = spotsigs.signature_sets([t, edited, after], cache)
        like = lambda x, y: len({*x.tolist()} & {*y.tolist()}) / len({*x.tolist()} | {*y.tolist()})
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.fingerprint(a))
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))
        x, y, z = (set(re.findall(".{8}", f)) for f in (r["fingerprint"], r["edited_fingerprint"], got[(i + 1) % len(TEXTS)]["fingerprint"]))
        assert r["near_edited"] == pytest.approx(len(x & y) / len(x | y)) and r["near_next"] == pytest.approx(len(x & z) / len(x | z))
    assert got[8]["fingerprint"] == got[17]["fingerprint"]
    assert spotsigs.with_edits(empty).count() == 0
    one = spark.createDataFrame([(None, "the cat sat")], "doc_id long, text string")
    assert spotsigs.with_edits(one).collect()[0]["near_next"] == 1.0


def brute_spots(text):
    """An anchor and the two content words after it, whatever anchors stand between."""
    words = re.findall(r"[^\W_]+", text.lower())
    out = set()
    for i, w in enumerate(words):
        content = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][:2]
        if w in spotsigs.ANCHORS and len(content) == 2:
            out.add((w, *content))
    return out


def test_spots_against_brute_force():
    cache = HashCache(spotsigs.word_values)
    for text in [t or "" for t in TEXTS[:15]] + ["the a of x", "the the x y z of", "der Hund und die Katze in dem Haus"]:
        want = brute_spots(text)
        got = spotsigs.signature_sets([text], cache)[0]
        assert len(got) == max(1, len(want)) and (spotsigs.signatures_of(spotsigs.fingerprint(got)) == got).all()


def test_alike_against_all_pairs(spark, docs, empty, monkeypatch):
    said = " ".join(f"the thing{i} of place{i} and time{i}" for i in range(30))
    draw = np.random.default_rng(4)
    texts = [said, said.replace("thing3 ", "xx "), said.replace("thing", "yy"), said, None, "", "lone words"]
    for _ in range(40):
        words = said.split()
        for at in draw.integers(0, len(words), draw.integers(1, 12)):
            words[at] = f"other{at % 7}"
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = [brute_spots(t or "") or {t or ""} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
    table = spark.createDataFrame([*rows, (None, said), (None, "no other has this"), (3, said)], "doc_id long, text string")
    for block in (1500, 2):
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
        got = spotsigs.alike(table).collect()
        assert sorted((r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None) == sorted([*enumerate(root), (3, root[3])])
        assert [r["class_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert spotsigs.alike(empty).count() == 0


def test_warc(spark):
    rows = [(1, "http://a.example.com/x?y", "<p>one</p>"), (2, "http://b.example.com/", "<p>one</p>"), (3, None, None), (4, "http://a.example.com/z", ""), (5, "no url", "<p>zwö</p>\r\n\r\n"), (6, "http://a.example.com/x?y", "<p>one</p>")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, key int")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        last = max(j for j, _, h in rows if (h or "") == (html or ""))
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == last else ("revisit", last))
    root = warc.fresh_path(spark, "warc")
    directory = warc.write_index(warc.write_archives(pages, root), root, block_lines=2)
    found = warc.lookup(directory, "com,example,a)/x?y")
    assert sorted(r.page_id for r in found) == [1, 6] and {r.payload for r in found if r.page_id == 6} == {b"<p>one</p>"}
    assert warc.lookup(directory, "nothing") == []
    keys = spark.createDataFrame([("com,example,a)/x?y",), ("nothing",), ("com,example,a)/x?y",), ("no url",)], "key string")
    assert sorted(r["page_id"] for r in warc.lookup_all(directory, keys).collect()) == [1, 5, 6]
    assert warc.round_trip(pages.where("false")).count() == 0


def test_language_id(docs, empty, spark):
    got = by_id(langid.predict_held_out(docs))
    assert len(got) == len(TEXTS) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert langid.predict_held_out(empty).count() == 0


def test_forward_sums_all_segmentations():
    model = langid.Model(["l"], ["a", "b", "ab", "ba", "aba"])
    ids = {p: i for i, p in enumerate(sorted({"a", "b", "ab", "ba", "aba"}), 1)}
    probs = np.linspace(0.05, 0.3, model.pieces.size).reshape(-1, 1)

    def total(word):
        return 1.0 if not word else sum(probs[ids[word[:k]], 0] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in ids)

    for word in ("a", "ab", "abab", "baab", "ababa"):
        assert langid.forward(model.pieces.lattice([word]), probs)[-1, 0, 0] == pytest.approx(total(word))


def test_language_id_learns(spark):
    rows = [(i, " ".join(["the house of night"] * 5) if i % 2 else " ".join(["la maison du soir"] * 5), "en" if i % 2 else "fr") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "fr") for r in langid.predict_held_out(table).collect())


def test_toxicity(docs, empty, spark):
    rows = [(i, ("you idiot go away " if i % 4 == 0 else "you friend come here ") + f"w{i % 50} " * 20, 1 if i % 4 == 0 else 0) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = by_id(toxicity.predict_held_out(table.select("doc_id", "text"), table.select("doc_id", "toxic")))
    assert all(got[i]["predicted"] == t for i, _, t in rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    labels = table.select("doc_id", "toxic")
    assert toxicity.predict_held_out(empty, labels).count() == 0
    assert toxicity.predict_held_out(docs, labels.where("false")).count() == len(TEXTS)


def test_token_counts(docs, empty, spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.read_ranks(tokens.default_path()), special_tokens={})
    twice = docs.union(docs.where("doc_id = 7")).union(docs.where("doc_id = 8").selectExpr("extra", "CAST(NULL AS BIGINT)", "text", "lang", "source", "row", "slot"))
    expected: Counter = Counter()
    for i, t in [*enumerate(TEXTS), (7, TEXTS[7]), (8, TEXTS[8])]:
        group = "s" if i % 2 else None, ["en", "fr", None][i % 3]
        expected[(*group, "docs")] += 1
        expected[(*group, "tokens")] += len(enc.encode_ordinary(t or ""))
    got = token_counts.maintained(twice).collect()
    assert {(r["source"], r["lang"], k): r[c] for r in got for k, c in (("docs", "n_docs"), ("tokens", "n_tokens"))} == dict(expected)
    assert token_counts.maintained(empty).count() == 0


def test_ledger(docs, spark):
    root = token_counts.fresh_path(spark, "ledger")
    ledger = token_counts.Ledger(spark, root)
    total = lambda: sorted((r["tokenizer"], r["n_docs"], r["n_tokens"]) for r in ledger.totals().groupBy("tokenizer").sum("n_docs", "n_tokens").toDF("tokenizer", "n_docs", "n_tokens").collect())
    assert total() == [] and ledger.fold() and total() == []
    exact = token_counts.counted(docs, "v1").cache()
    assert ledger.commit("1", token_counts.inserts(exact)) and not ledger.commit("1", token_counts.inserts(exact))
    once = total()
    assert once[0][:2] == ("v1", len(TEXTS))
    # an attempt that broke before its rename, and a writer that comes second with the folder half moved
    token_counts.inserts(exact).groupBy("source", "lang", "tokenizer").agg({"docs": "sum"}).write.parquet(f"{root}/aside/broken")
    assert not ledger._publish(token_counts.inserts(exact), f"{root}/batches/1", "{}") and total() == once
    there = ledger._there
    ledger._there = lambda path: False if path.endswith("batches/1") else there(path)
    assert not ledger.commit("1", token_counts.inserts(exact)) and total() == once
    ledger._there = there
    assert ledger.fold() and total() == once and ledger.fold() and total() == once
    assert not ledger.commit("1", token_counts.inserts(exact)) and total() == once
    assert ledger.commit("2", token_counts.revisions(exact, token_counts.estimated(docs, "v2")))
    assert ledger.fold() and {r[0] for r in total()} == {"v2"}
    assert ledger.commit("3", token_counts.deletes(token_counts.estimated(docs, "v2"))) and total() == []
    assert ledger.fold() and total() == [] and not ledger.commit("2", token_counts.inserts(exact))
    with pytest.raises(ValueError):
        ledger.commit("../x", token_counts.inserts(exact))


def test_pipeline_keeps_whole_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        before, docs = docs.count(), out.cache()
        assert 0.7 * before < docs.count() <= before, name
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_row_filters_agree_with_the_scores(docs, empty):
    model = np.array([], "i8"), np.array([]), -3.0
    assert sorted(toxicity.without_toxic(docs, model).collect(), key=str) == sorted(docs.collect(), key=str)
    assert toxicity.without_toxic(docs, (*model[:2], 3.0)).count() == 0
    learned = langid.train(docs)
    want = {r["doc_id"] for r in langid.identify(docs, learned).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    kept = langid.in_known_language(docs, learned, 0.5)
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    assert toxicity.without_toxic(empty, model).count() == langid.in_known_language(empty, learned, 0.5).count() == 0
