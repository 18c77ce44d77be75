"""Operators on small tables against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, ecoc_langid, exact_dedup, ngram_join, packing, pitman_yor, spotsigs, toxicity_kn, training_order, warc

DOCS = "doc_id long, text string, lang string, rid long, gid string, id string, score double"
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def documents(seed=1, n=60):
    rng = random.Random(seed)
    words = [a + b for a in ("the", "of", "an", "tion", "er") for b in ("ing", "able", "est", "ou", "ly", "")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(n)]
    near = texts[3].split()
    near[len(near) // 2] = "changed"
    texts += [None, "", " \n\t", texts[0], texts[0].replace(" ", "\n"), texts[1] + " ", " ".join(near), "x" * 5000, "y " * 3000, "\U0001f600!", "x" * 5000, "x" * 4999 + "z"]
    return [(k, t, "en") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "g", "i", 0.5) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_duplicates(spark, docs, rows, none):
    strip = lambda t: (t or "").translate(dict.fromkeys([32, *range(9, 14)]))
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(strip(t), []).append((-len(t or ""), d))
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        own = groups[strip(t)]
        assert (got[d].keep_id, got[d].group_size, got[d].kept) == (min(own)[1], len(own), min(own)[1] == d)
        assert got[d].text_sha256 == hashlib.sha256(strip(t).encode()).hexdigest()
    assert exact_dedup.exact_duplicates(none).count() == 0
    twice = exact_dedup.exact_duplicates(docs.union(docs)).collect()
    assert len(twice) == 2 * len(rows) and sum(r.kept for r in twice) == len(groups)


def test_packing(docs, rows, none):
    bpe = byte_bpe.ByteBPE.from_json(byte_bpe.file_bytes(JSON))
    ids = {d: np.append(np.frombuffer(next(iter(bpe.encode([t or ""]))), "<u4"), np.uint32(0)).astype("<u4") for d, t, _ in rows}
    got = packing.pack(docs, JSON).collect()
    per_doc, per_sequence = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        per_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for groups, whole in ((per_doc, lambda k, n: n == len(ids[k])), (per_sequence, lambda k, n: n <= 1024 and n & (n - 1) == 0)):
        for k, parts in groups.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert whole(k, at)
    assert set(per_doc) == set(ids) and packing.pack(none, JSON).count() == 0


def jaccard_sets(rows):
    out = {}
    for d, t, _ in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w)) or 1
        out[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    return out


def test_ngram_join(spark, docs, rows, none, monkeypatch):
    sets = jaccard_sets(rows)
    linked = {a: {b for b in sets if a != b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))} for a in sets}
    root = {}
    for a in sets:
        seen, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        root[a] = min(seen)
    for members in (512, 1):  # also block against block
        monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", members)
        got = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
        assert {d: (r.class_id, r.n_links, r.kept) for d, r in got.items()} == {d: (root[d], len(linked[d]), root[d] == d) for d in sets}
    assert ngram_join.near_duplicates(none).count() == 0
    assert ngram_join.bands_and_rows(0.8, 0.9999) == (24, 5)


def test_training_order(spark, docs, rows, none, tmp_path):
    got = training_order.round_trip(docs, JSON, sequence=64).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got)))
    bpe = byte_bpe.ByteBPE.from_json(byte_bpe.file_bytes(JSON))
    assert sum(r.n_tokens for r in got) == sum(len(x) // 4 + 1 for x in bpe.encode([t or "" for _, t, _ in rows]))
    order = training_order.Feistel(1000, 3)
    assert sorted(order.slots(np.arange(1000)).tolist()) == list(range(1000))
    folder = f"file://{tmp_path}/shards"
    manifest = training_order.write(docs, JSON, folder, sequence=64, shard_bytes=2048)
    twice = training_order.digest(training_order.read(folder, manifest, 64), 64).orderBy("slot").collect()
    whole = training_order.write(docs, JSON, f"{folder}-whole", sequence=64, shard_bytes=2048, waves=1)
    assert twice == training_order.digest(training_order.read(f"{folder}-whole", whole, 64), 64).orderBy("slot").collect()
    assert [r.shard for r in manifest.orderBy("shard").collect()] == list(range(manifest.count())) and manifest.count() >= 16
    assert [r.slot for r in training_order.read(folder, manifest, 64, 5, 40).orderBy("slot").collect()] == list(range(5, 40))
    assert training_order.round_trip(none, JSON).count() == 0


def test_pitman_yor(docs, rows, none):
    held = F.col("doc_id") % 5 == 1
    got = {r.doc_id: r for r in pitman_yor.score(docs, ~held).collect()}
    counts = {}
    tokens = {d: (t or "").encode().lower().split() + [None] for d, t, _ in rows}
    for d, own in tokens.items():
        for w in own if d % 5 != 1 else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for d, own in tokens.items():
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert got[d].base_score == pytest.approx(base) and got[d].n_tokens == len(own) and got[d].train_tokens == n
        assert got[d].n_known == sum(w in counts for w in own) and got[d].score < 0
    assert pitman_yor.score(none, ~held).count() == 0
    assert all(r.train_tokens == 0 and np.isfinite(r.score) for r in pitman_yor.score(docs, F.lit(False)).collect())


def test_pitman_yor_keeps_contexts_apart(spark, docs, monkeypatch):
    import xxhash

    seen = {}
    for k in range(5000):  # two words whose hashes agree in the first 18 bits
        a = seen.setdefault(xxhash.xxh3_64_intdigest(f"w{k}".encode()) >> 46, k)
        if a != k:
            break
    texts = [f"w{a} x"] * 200 + [f"w{k} unknown", "other unknown"]
    few = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score(few, F.col("doc_id") < 200).collect()}
    assert got[200] == got[201]
    held = F.col("doc_id") % 5 == 1
    whole = {r.doc_id: r for r in pitman_yor.score(docs, ~held).collect()}
    monkeypatch.setattr(pitman_yor, "HOT_TOKENS", 40)  # many contexts are spread over buckets
    for r in pitman_yor.score(docs, ~held).collect():
        own = whole[r.doc_id]
        assert r[:4] == own[:4] and r.base_score == pytest.approx(own.base_score) and r.score == pytest.approx(own.score, rel=0.05, abs=0.3)


def test_spotsigs(spark, docs, rows, none):
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    order = sorted((r[0] for r in rows), reverse=True)
    texts = {d: t or "" for d, t, _ in rows}
    cut = lambda f: {f[i : i + 8] for i in range(0, len(f), 8)}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    alike = lambda a, b: j if (j := jaccard(a, b)) >= spotsigs.LEAST else 0.0
    for k, d in enumerate(order):
        nxt, t = order[(k + 1) % len(order)], texts[d]
        third = len(t) // 3
        edited = t[: len(t) - third] + texts[nxt][:third]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(t)
        assert got[d].near_edited == pytest.approx(alike(cut(got[d].fingerprint), cut(got[d].edited_fingerprint)))
        assert got[d].near_next == pytest.approx(alike(cut(got[d].fingerprint), cut(got[nxt].fingerprint)))
    assert spotsigs.fingerprints(none).count() == 0
    pairs = {(r.a, r.b) for r in spotsigs.similar_pairs(docs, 0.8).collect()}
    least = {}
    for d in sorted(got):
        least.setdefault(got[d].fingerprint, d)
    reps = {d: cut(f) for f, d in least.items() if f}
    assert pairs == {(a, b) for a in reps for b in reps if a < b and alike(reps[a], reps[b]) >= 0.8}


def test_spotsigs_buckets_and_null_ids(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 7)
    a = spotsigs.fingerprints(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 2000)
    assert a == spotsigs.fingerprints(docs).orderBy("doc_id").collect()
    assert spotsigs.fingerprints(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(rows)


def test_language(spark, none):
    rng = random.Random(2)
    own = {"en": ["the", "thing", "with", "shall"], "de": ["der", "schön", "über", "nicht"], "fr": ["être", "ça", "quoi", "leur"]}
    rows = [(k, " ".join(rng.choice(own[x]) for _ in range(12)), x) for k, x in enumerate(["en", "de", "fr"] * 40)] + [(200, None, "en"), (201, "123 !", None), (202, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ecoc_langid.fit(docs, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in ecoc_langid.predict(docs, model).collect()}
    assert all(got[d].lang_pred == x and 0 <= got[d].score <= 1 for d, _, x in rows[:120])
    assert {got[d].lang_pred for d in (200, 201, 202)} == {"und"}
    assert ecoc_langid.fit(none, F.lit(True)) is None and {r.lang_pred for r in ecoc_langid.predict(docs, None).collect()} == {"und"}
    code = ecoc_langid.codewords(20)
    assert ((code[:, None] != code[None]).sum(2) + 99 * np.eye(20)).min() >= 10


def test_byte_bpe(spark, docs, rows, none):
    import tiktoken

    ranks = byte_bpe.ByteBPE.from_ranks(byte_bpe.file_bytes(RANKS)).vocab
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()
    for r, (d, t, _) in zip(sorted(both, key=lambda r: r.doc_id), rows, strict=True):
        assert np.frombuffer(r.ids, "<u4").tolist() == theirs.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode()
    rng, bpe = random.Random(5), byte_bpe.ByteBPE.from_ranks(byte_bpe.file_bytes(RANKS))
    parts = [*"ab'stmdrevl  \n\t 　\x1c12²é日\U0001f600!?ſ", "'s", "'re", "'ll", " '", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]
    ids, where = bpe.encode_with_offsets("don't  stop")
    assert theirs.decode(ids) == "don't  stop" and where[0] == 0 and where == sorted(where)
    assert byte_bpe.encode(none, RANKS).count() == 0


def test_added_tokens(spark):
    bpe, ranks = byte_bpe.ByteBPE.from_json(byte_bpe.file_bytes(JSON)), byte_bpe.ByteBPE.from_ranks(byte_bpe.file_bytes(RANKS))
    plain = lambda t: np.frombuffer(bpe.encode_plain([t])[0], "<u4").tolist()
    end = "<|endoftext|>"
    texts = ["a" + end + "b", end, end + end, "no token", "", f" one {end}  two\n{end}", "<|endoftext|"]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)]
    assert got[:3] == [[64, 50256, 65], [50256], [50256, 50256]] and 50256 not in got[6]
    assert got[3] == plain("no token") and got[4] == [] and got[5] == [*plain(" one "), 50256, *plain("  two\n"), 50256]
    assert [bpe.decode(np.array(x, "<u4").tobytes()).decode() for x in got] == texts
    assert bpe.encode_with_offsets(texts[0]) == ([64, 50256, 65], [0, 1, 14])
    assert 50256 not in np.frombuffer(next(iter(ranks.encode([end]))), "<u4")
    docs = spark.createDataFrame([(1, texts[0])], "doc_id long, text string")
    assert {r.doc_tokens for r in packing.pack(docs, JSON).collect()} == {4}


def test_toxicity(spark, none):
    rng = random.Random(3)
    plain = ["house", "river", "garden", "window", "letter", "market"]
    rows = []
    for k in range(300):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 80))]
        if k % 4 == 0:
            words[3:3] = ["zorgblat" + rng.choice("aeiou"), "zorgblat" + rng.choice("aeiou")]
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame([(*r[:2], "x") for r in rows] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(900, None)], "doc_id long, toxic int")
    model = toxicity_kn.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.toxicity for r in toxicity_kn.score(docs, model).collect()}
    assert np.mean([(got[d] >= 0.5) == bool(y) for d, _, y in rows if d % 5 == 0]) >= 0.95
    assert got[900] == got[901] and 0 <= got[900] < 0.5
    assert toxicity_kn.fit(docs, labels.where("toxic = 0"), F.lit(True)) is None and toxicity_kn.score(none, model).count() == 0


def test_warc(spark, tmp_path):
    big, rng = "é" * 80, random.Random(4)
    rows = [(5, "http://a/", big), (2, None, big), (9, "http://b/\r\nX: y", big), (1, "u", "small"), (3, "u", "small"), (4, "u", None), (None, "u", "null id " * 20), (-7, "u", "".join(rng.choice("abc \r\n") for _ in range(9000)))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages, folder, roll_bytes=500)
    got = {r.page_id: r for r in warc.read(folder, manifest).collect()}
    assert len(got) == len(rows) and not list(tmp_path.glob("w/_temporary/*"))
    for page, _, html in rows:
        body, r = (html or "").encode(), got[page]
        first = 2 if html == big and page != 2 else None
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if first else "response", first)
        assert first or bytes(r.payload) == body
    again = warc.write(pages, f"file://{tmp_path}/again", roll_bytes=500)
    assert sorted(manifest.collect()) == sorted(again.collect())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = documents(9, 40)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    with_letter = [(d, t, x) for d, t, x in rows if t and any(map(str.isalpha, t))]
    root = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(docs.where(F.col("doc_id").isin([r[0] for r in with_letter]))).collect()}
    assert {root[d] for d in got} == set(root.values()) and len(got) <= len(set(root.values())) + 1
