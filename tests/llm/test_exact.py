"""The encoder against the libraries, the sampler against exact posteriors and a plain model, files rebuilt, determinism, components."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, common, components, ecoc_langid, ngram_join, packing, pitman_yor, spotsigs, toxicity_kn, training_order, warc

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def libraries():
    import tiktoken
    import tokenizers

    ranks = byte_bpe.ByteBPE.from_ranks(byte_bpe.file_bytes(RANKS))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.vocab, special_tokens={})
    other = tokenizers.Tokenizer.from_file(JSON)
    return [(ranks, theirs.encode_ordinary), (byte_bpe.ByteBPE.from_json(byte_bpe.file_bytes(JSON)), lambda t: other.encode(t, add_special_tokens=False).ids)]


def ids_of(bpe, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)]


def test_encoder_equals_libraries(libraries, monkeypatch):
    rng = random.Random(5)
    parts = [*"ab'stmdrevl  \n\t 　\x1c12²é日\U0001f600!?ſ", "'s", "'re", "'ll", " '", "  ", "<|endoftext|>", "<|endoftext"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    for chars in (500_000, 40):  # also window by window
        monkeypatch.setattr(byte_bpe, "BATCH_CHARS", chars)
        for bpe, reference in libraries:
            assert ids_of(bpe, texts) == [reference(t) for t in texts]


def test_encoder_survives_colliding_pieces(libraries):
    word = "a"  # the Thue-Morse word and its complement collide under polynomial hashes modulo powers of two
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    pair = ["x" + word + "x", "x" + word.translate(str.maketrans("ab", "ba")) + "x"]
    for bpe, reference in libraries:
        for texts in (pair, pair[::-1], [" ".join(pair)], pair[:1], pair[1:]):
            assert ids_of(bpe, texts) == [reference(t) for t in texts]
            assert [bpe.decode(x).decode() for x in bpe.encode(texts)] == texts


def test_offsets_decode_any_span(spark, libraries):
    rng, bpe = random.Random(6), libraries[0][0]
    for _ in range(300):
        text = "".join(rng.choice(["the ", "é", "日本", "  \n", "xyz", "12", "\U0001f600"]) for _ in range(rng.randint(0, 60)))
        raw, ids = text.encode(), next(iter(bpe.encode([text])))
        where = byte_bpe.unpack_offsets(byte_bpe.pack_offsets(bpe.offsets(np.frombuffer(ids, "<u4"))), len(ids) // 4)
        i = rng.randint(0, len(raw))
        j = rng.randint(i, len(raw) + 2)
        assert bpe.decode(ids, where) == raw and bpe.decode(ids, where, i, j) == raw[i:j]
    wide = np.array([0, 255, 600, 601])
    assert byte_bpe.unpack_offsets(byte_bpe.pack_offsets(wide), 4).tolist() == wide.tolist()
    docs = spark.createDataFrame([("a", "one two", b"x"), ("a", "one two", b"y"), (None, None, b"z")], "doc_id string, text string, decoded binary")
    both = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS)
    assert sorted((r.doc_id or "", bytes(r.decoded)) for r in both.collect()) == [("", b""), ("a", b"one two"), ("a", b"one two")]
    with pytest.raises(ValueError, match="offsets"):
        bpe.decode(np.array([64, 65], "<u4").tobytes(), np.array([0, 7]))


def test_long_text(libraries):
    bpe, reference = libraries[0]
    text = "Some words, 123 numbers and don't  stop\n" * 40_000
    assert ids_of(bpe, [text])[0] == reference(text)


def exact_mean(customers, parent, others, discount):
    k = np.arange(customers)
    w = np.log((pitman_yor.THETA + discount * (others + k)) * parent).cumsum() + pitman_yor.stirling(discount, max(customers, 2))[customers, 1 : customers + 1]
    w = np.exp(w - w.max())
    return (w * (k + 1)).sum() / w.sum()


@pytest.mark.parametrize("customers,parent,discount,others", [(50, 0.5, 0.7, 0), (500, 0.2, 0.8, 0), (500, 0.2, 0.8, 20), (500, 0.02, 0.8, 20), (1000, 0.3, 0.5, 5000), (2000, 0.01, 0.7, 100000), (2, 0.3, 0.4, 3)])
def test_seating_follows_the_posterior(customers, parent, discount, others):
    drawn = pitman_yor.seat(np.random.default_rng(1), np.full(6000, customers), np.full(6000, others), np.full(6000, parent), discount)
    assert drawn.mean() == pytest.approx(exact_mean(customers, parent, others, discount), rel=0.02, abs=4 * drawn.std() / 77)


def plain_model(texts, train, sweeps, burn_in, discounts, seed):
    """Scores by a Chinese restaurant of single customers, each taken out and seated anew in turn."""
    rng = random.Random(seed)
    streams = [[None, *(t.encode().lower().split()), None] for t in texts]
    pairs = collections.Counter(p for s, own in zip(streams, train, strict=True) if own for p in zip(s, s[1:], strict=False))
    words = {w for _, w in pairs}
    base, (d0, d1) = len(words) + 1, discounts
    tables, parent = {}, {}  # sizes of tables
    total = lambda r: (sum(map(sum, r.values())), sum(map(len, r.values())))

    def p0(w):
        c, t = total(parent)
        own = parent.get(w, [])
        return (sum(own) - d0 * len(own) + (1 + d0 * t) / base) / (1 + c)

    def sit(own, weight_new, d):
        k = rng.choices(range(len(own) + 1), [n - d for n in own] + [weight_new])[0]
        if k == len(own):
            own.append(0)
        own[k] += 1
        return own[k] == 1

    def leave(own):
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            return True
        return False

    def parent_sit(w):
        sit(parent.setdefault(w, []), (1 + d0 * total(parent)[1]) / base, d0)

    customers = [p for p, n in pairs.items() for _ in range(n)]
    for u, w in customers:
        room = tables.setdefault(u, {})
        if sit(room.setdefault(w, []), (1 + d1 * total(room)[1]) * p0(w), d1):
            parent_sit(w)
    scores, used = np.zeros(len(texts)), 0
    sums = collections.Counter()
    for s in range(sweeps):
        rng.shuffle(customers)
        for u, w in customers:
            room = tables[u]
            if leave(room[w]):
                leave(parent[w])
            if sit(room[w], (1 + d1 * total(room)[1]) * p0(w), d1):
                parent_sit(w)
        if s >= burn_in:
            used += 1
            for own in streams:
                for u, w in zip(own, own[1:], strict=False):
                    room = tables.get(u, {})
                    c, t = total(room)
                    mine = room.get(w, [])
                    sums[u, w, id(own)] += (sum(mine) - d1 * len(mine) + (1 + d1 * t) * p0(w)) / (1 + c)
    for k, own in enumerate(streams):
        scores[k] = sum(math.log10(sums[u, w, id(own)] / used / own_count(own, u, w)) for u, w in zip(own, own[1:], strict=False))
    return scores


def own_count(stream, u, w):
    return sum((a, b) == (u, w) for a, b in zip(stream, stream[1:], strict=False))


def test_scores_equal_a_plain_model(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(12)], k=rng.randint(3, 30))) for _ in range(24)] + ["w0 new w1", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [k % 5 != 1 for k in range(len(texts))]
    streams = [[None, *(t.encode().lower().split()), None] for t in texts]
    pairs = collections.Counter(p for s, own in zip(streams, train, strict=True) if own for p in zip(s, s[1:], strict=False))
    above = collections.Counter(w for _, w in pairs)
    discounts = [pitman_yor.discount(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())) for c in (above, pairs)]
    expected = np.mean([plain_model(texts, train, 60, 20, discounts, s) for s in range(3)], 0)
    got = {r.doc_id: r.score for r in pitman_yor.score(docs, F.col("doc_id") % 5 != 1, sweeps=30, burn_in=5).collect()}
    got = np.array([got[k] for k in range(len(texts))])
    sizes = np.array([len(s) - 1 for s in streams])
    assert np.abs(got - expected).sum() / sizes.sum() < 0.02  # log10 a token


def test_training_order_gives_documents_back(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "<|endoftext|>", "gamma", "don't"]) for _ in range(rng.randint(0, 200))) for _ in range(60)] + [None, "", "same", "same"]
    names = [f"id-{k}" for k in range(len(texts) - 2)] + ["twice", "twice"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(names, texts, strict=True)], "doc_id string, text string, shard string").repartition(3)
    folder = f"file://{tmp_path}/shards"
    manifest = training_order.write(docs, JSON, folder, sequence=32, key=9, shard_bytes=1024)
    rows = training_order.read(folder, manifest, 32, id_type="string").collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        ends = [*r.offsets[1:], r.n_tokens]
        for doc, a, z, start in zip(r.doc_ids, r.offsets, ends, r.starts, strict=True):
            pieces[doc].append((start, ids[a:z].tolist()))
        assert (ids[r.n_tokens :] == 0).all()
    bpe = byte_bpe.ByteBPE.from_json(byte_bpe.file_bytes(JSON))
    for doc in set(names):
        whole = sorted([*np.frombuffer(next(iter(bpe.encode([t or ""]))), "<u4").tolist(), 0] for i, t in zip(names, texts, strict=True) if i == doc)
        if doc != "twice":
            assert [x for _, own in sorted(pieces[doc]) for x in own] == whole[0]
        else:
            assert sorted(x for _, own in pieces[doc] for x in own) == sorted(x for own in whole for x in own)
    assert {r.sha256 for r in manifest.collect()} == {hashlib.sha256((tmp_path / "shards" / f"{r.file}.bin").read_bytes()).hexdigest() for r in manifest.collect()}
    assert not list((tmp_path / "shards").glob("_placed/*")) and not (tmp_path / "shards/_sequences").exists()


def test_warc_is_deterministic(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([None, k, k // 50]), f"http://h/{k % 7}", "p" * rng.randint(0, 400) + str(k % 900)) for k in range(4000)]
    rows += rows[:50]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    manifests = []
    for k, frame in enumerate((pages.repartition(2), pages.repartition(13, "html"), pages.coalesce(1))):
        spark.conf.set("spark.sql.shuffle.partitions", str(3 + 4 * k))
        manifest = warc.write(frame, f"file://{tmp_path}/{k}", range_bytes=100_000, roll_bytes=20_000)
        manifests.append(sorted(tuple(r) for r in manifest.collect()))
        assert warc.read(f"file://{tmp_path}/{k}", manifest, False).count() == len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert manifests[0] == manifests[1] == manifests[2] and len({m[0][:11] for m in manifests[0]}) >= 5
    alone = spark.createDataFrame([(None, f"u{k}", "y" * 300 + str(k)) for k in range(800)], "page_id long, url string, html string")
    parts = warc.write(alone, f"file://{tmp_path}/alone", range_bytes=50_000)
    assert parts.count() >= 5  # one id is split by digest


def test_components_shrink(spark, tmp_path):
    rng = random.Random(1)
    star = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(3000, 3400)] + [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2000)] + [(7, 7)]
    sizes = []
    got = {r.node: r.root for r in components.components(spark.createDataFrame(star, "a long, b long"), f"file://{tmp_path}/c", sizes).collect()}
    assert got == {**dict.fromkeys(range(3000), 0), **dict.fromkeys(range(3000, 3401), 3000)}
    assert all(b * 2 <= a for a, b in zip(sizes, sizes[1:], strict=False))
    assert components.components(spark.createDataFrame([(5, 5)], "a long, b long"), f"file://{tmp_path}/d").count() == 0


def test_near_copies_have_few_edges(spark, monkeypatch):
    rng = random.Random(4)
    whole = [f"w{rng.randrange(500)}" for _ in range(80)]
    texts = []
    for _ in range(900):
        own = list(whole)
        for _ in range(3):
            own[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rounds, plain = [], components.components

    def watched(edges, folder, sizes=None):
        out = plain(edges, folder, own := [])
        rounds.append(own)
        return out

    monkeypatch.setattr(ngram_join, "components", watched)
    got = ngram_join.near_duplicates(docs).collect()
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (x.split() for x in texts)]
    linked = [[j for j in range(900) if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(900)]
    assert {r.doc_id: r.n_links for r in got} == dict(enumerate(map(len, linked)))
    assert rounds[0][0] < 6 * 900 and all(b * 2 <= a for a, b in zip(rounds[0], rounds[0][1:], strict=False))


def test_repeats_clashes_nulls(spark):
    rows = [(1, "the cat sat on the mat again", "en", 0.1), (1, "the cat sat on the mat again", "en", 0.1), (None, "le chat noir est sur la table", "fr", 0.2), (2, None, None, None), (3, "", "en", 0.3)]
    docs = spark.createDataFrame([(*r, "x", "y", True) for r in rows], "doc_id long, text string, lang string, score double, toxicity string, lang_pred string, ambiguous boolean")
    assert packing.pack(docs, JSON).where("start = 0").count() == 5
    assert ngram_join.near_duplicates(docs).count() == 5 and pitman_yor.score(docs, F.lit(True)).count() == 5
    assert spotsigs.fingerprints(docs).count() == 5
    model = ecoc_langid.fit(docs, F.lit(True))
    out = ecoc_langid.predict(docs, model)
    assert out.columns.count("score") == 1 and dict(out.dtypes)["score"] == "double" and out.count() == 5
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    toxic = toxicity_kn.score(docs, toxicity_kn.fit(docs, labels, F.lit(True)))
    assert toxic.columns.count("toxicity") == 1 and toxic.count() == 5
    assert common.free_names(docs, "score", "new") == ["_score", "new"]


def test_language_is_decoded_by_loss():
    rng = np.random.default_rng(1)
    code = ecoc_langid.codewords(5)
    model = ecoc_langid.Model([f"l{k}" for k in range(5)], code, rng.normal(size=(6, code.shape[1])))
    x = rng.normal(size=(40, 6))
    best, sure, gap = model.decode(x)
    for row, b, s, g in zip(x, best, sure, gap, strict=True):
        margins = np.clip(row @ model.weights, -4, 4)
        loss = [np.mean([math.exp(-2 * m * c) for m, c in zip(margins, word, strict=True)]) for word in code]
        order = sorted(range(5), key=loss.__getitem__)
        assert b == order[0] and g == pytest.approx(loss[order[1]] - loss[order[0]])
        assert s == pytest.approx(1 / sum(math.exp(-4 * (v - loss[b])) for v in loss))


def test_toxicity_ratios_are_likelihoods():
    """Every byte's ratio equals the difference of two Kneser-Ney models, computed by definition."""
    toxic = [toxicity_kn.prepared(t) for t in ("you zorg blat", "zorg zorg now", "a blat zorgy")]
    plain = [toxicity_kn.prepared(t) for t in ("you are now here", "the house of now", "a river and a house")]
    model = toxicity_kn.Model(toxicity_kn.likelihood_tables(toxic, plain), np.ones(3), np.zeros(4))
    pad, order, discount = toxicity_kn.PAD, toxicity_kn.ORDER, toxicity_kn.DISCOUNT

    def counts(texts):
        stream = pad + pad.join(texts) + pad
        levels, above = {}, None
        for n in range(order, 0, -1):
            found = collections.Counter(stream[k : k + n] for k in range(len(stream) - n + 1)) if above is None else collections.Counter(g[1:] for g in above)
            levels[n] = {g: c for g, c in found.items() if g[-1]}
            above = set(levels[n])
        return levels

    def probability(levels, n, gram, lower):
        inside = [c for g, c in levels[n].items() if g[:-1] == gram[:-1]]
        if not inside:
            return lower
        return (max(levels[n].get(gram, 0) - discount, 0) + discount * len(inside) * lower) / sum(inside)

    both = counts(toxic + plain)
    stream_both = pad + pad.join(toxic) + pad + pad + pad.join(plain) + pad
    assert stream_both.count(pad) >= 8
    sides = [counts(x) for x in (toxic, plain)]
    text = toxicity_kn.prepared("you zorgy house now blat")
    data = np.frombuffer(pad + text + pad, np.uint8)
    got = model.ratios(data)
    raw = pad + text + pad
    for k in range(len(pad), len(pad) + len(text)):
        shared = 1 / 256
        for n in range(1, toxicity_kn.SHARED + 1):
            shared = probability(both, n, raw[k - n + 1 : k + 1], shared)
        p = [shared, shared]
        for n in range(toxicity_kn.SHARED + 1, order + 1):
            p = [probability(s, n, raw[k - n + 1 : k + 1], low) for s, low in zip(sides, p, strict=True)]
        assert got[k] == pytest.approx(math.log10(p[0] / p[1]), abs=2e-4)


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    own = {"en": ["the", "river", "shall", "garden", "window", "letter"], "de": ["der", "fluss", "nicht", "garten", "fenster", "über"], "fr": ["être", "jardin", "quoi", "fenêtre", "lettre", "leur"]}
    rows, toxic = [], {}
    for k in range(240):
        lang = ("en", "de", "fr")[k % 3]
        words = [rng.choice(own[lang]) for _ in range(rng.randint(30, 60))]
        if k % 8 == 0:
            words[2:2] = ["zorgblat", "blatzorg"]
        toxic[k] = int(k % 8 == 0)
        rows.append((k, " ".join(words), lang))
    rows += [(300, rows[1][1], "de"), (301, rows[1][1].replace(" ", "\n"), "de"), (302, rows[2][1] + " leur", "fr"), (303, "123 456", "en"), (304, None, "en"), (305, "", None)]
    docs = spark.createDataFrame([(d, t, x, "s", len(t or ""), 0.5, True) for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, ambiguous boolean")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, v) for k, v in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    plain = {d for d, t, _ in rows if t and any(map(str.isalpha, t))}
    found = ids(kept := stages["language"](spark, kept, str(tmp_path)))
    assert found <= plain and len(plain - found) <= 3 and kept.columns == docs.columns
    found_clean = ids(kept := stages["toxicity"](spark, kept, str(tmp_path)))
    assert found_clean == {d for d in found if not toxic.get(d)} and kept.columns == docs.columns
    texts = {d: t for d, t, _ in rows}
    groups = collections.defaultdict(list)
    for d in found_clean:
        groups["".join(texts[d].split())].append((-len(texts[d]), d))
    found = ids(kept := stages["exact_duplicates"](spark, kept, str(tmp_path)))
    assert found == {min(g)[1] for g in groups.values()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for d, w in ((d, texts[d].lower().split()) for d in found)}
    near = {(a, b) for a in found for b in found if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near
    left = ids(kept := stages["near_duplicates"](spark, kept, str(tmp_path)))
    assert left == found - {b for _, b in near}
    bpe = byte_bpe.ByteBPE.from_json(byte_bpe.file_bytes(JSON))
    tokens = {d: np.append(np.frombuffer(next(iter(bpe.encode([texts[d]]))), "<u4"), np.uint32(0)).astype("<u4") for d in left}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == left and sum(r.length for r in pieces) == sum(map(len, tokens.values()))
    assert all(r.ids_crc32 == zlib.crc32(tokens[r.doc_id][r.start : r.start + r.length].tobytes()) for r in pieces)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def test_large_batches_are_worked_in_slices(spark, monkeypatch):
    text = [None, "", "zorg blat " * 300_000, *(f"text {k} " * 300 for k in range(5000)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(text)), pa.int64()), pa.array(text)], ["doc_id", "text"])
    docs, runs = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *_: runs.append(run) or self)
    toxicity_kn.score(docs, None), ecoc_langid.predict(docs, None)
    for run in runs:
        got = list(run(iter([batch, batch.slice(0, 0)])))
        assert pa.Table.from_batches([x.select(batch.schema.names) for x in got]).to_pydict() == batch.to_pydict()
        assert max(x.num_rows for x in got) < 1000 and sum(x.num_rows == 1 for x in got) <= 2
    assert [x.num_rows for x in common.slices([batch.slice(0, 4), batch.slice(0, 0)], 1, 10)] == [2, 1, 1, 0]
