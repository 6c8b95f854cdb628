"""Every text operator against brute force, the library it stands for, a round trip or held-out labels."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scorelens.llm import (
    near_dedup,
    offset_pieces,
    packing,
    paragraph_sketch,
    prefix_counts,
    quality_cnn,
    quality_rules,
    queries,
    repeats,
    token_store,
    toxicity,
)
from scorelens.llm.common import gathered, per_worker
from scorelens.llm.components import components
from scorelens.llm.labelled import labelled_sample
from scorelens.llm.words import WordEncoder
from scorelens.session import scratch_path

BYTE, WORD, PIECE = (
    public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")
)

#: Nulls, blanks, odd white space, special strings, other scripts, ties, and a long text without a space.
EDGES = [
    None, "", " ", "\n\n", "a", "  two  blanks ", "tab\tand\r\nline", "I'll 'll they've 's'", "x <|endoftext|> y<|endoftext|>",
    "日本語 テキスト 🎉🎉", "é ﬁ ½ \x00 \x1c z", "a ▁ b▁c", "same text twice", "same text twice", "q" * 30_000,
    "word " * 5_000, "loser! " * 3,
]


@pytest.fixture(scope="module")
def edges(spark):
    """Extra columns with the names that operators use inside, a null id, and a row that comes twice."""
    rows = [(i if i else None, t, 1, "x", 0.5) for i, t in enumerate(EDGES)]
    rows.append((5, EDGES[5], 1, "x", 0.5))
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, n_tokens INT, _salt STRING, score DOUBLE").repartition(3)


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING")


def run(name, spark, sf_dir):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}


ON_EDGES = {
    "rules": quality_rules.apply_rules,
    "counts": lambda d: prefix_counts.token_counts(d, BYTE),
    "pieces": lambda d: offset_pieces.encode_offsets(d, PIECE),
    "digests": lambda d: offset_pieces.offset_digests(d, PIECE),
    "packing": lambda d: packing.pack_documents(d, WORD),
    "sketch": paragraph_sketch.edited_and_next,
    "prints": paragraph_sketch.fingerprints,
    "near": near_dedup.near_duplicates,
    "repeats": repeats.remove_repeats,
    "quality": lambda d: quality_cnn.score(d, quality_cnn.fit(["good words here", "## ## ##"] * 8, [1, 0] * 8, [1.0] * 16)),
    "toxic": lambda d: toxicity.score(d, toxicity.fit(["fine day.", "you loser!"] * 8, [0, 1] * 8, [1.0] * 16)),
}


@pytest.mark.parametrize("name", ON_EDGES)
def test_edges_give_a_row_each_and_empty_tables_none(edges, empty, name):
    rows = ON_EDGES[name](edges).collect()
    per_row = [r for r in rows if "piece" not in r.asDict() or r["piece"] == 0]
    assert Counter(r["doc_id"] for r in per_row) == Counter(r["doc_id"] for r in edges.select("doc_id").collect())
    assert ON_EDGES[name](empty).collect() == []


# -- 1 and 4: classifiers


def auc(y, p):
    order = np.argsort(np.argsort(p)) + 1
    y = np.array(y)
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


@pytest.mark.parametrize("name,label,floor", [("op1_toxicity_instances", "toxic", 0.8), ("op4_byte_network", "quality", 0.9)])
def test_held_out_rows_are_ranked_well(spark, name, label, floor):
    sf = "/root/testdata/sf0.01"
    got = run(name, spark, sf)
    known = duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall()
    held = [(y, got[i]["score"]) for i, y in known if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert auc(*zip(*held)) > floor


def test_long_clean_texts_stay_clean_and_a_long_offence_is_found():
    train = [f"all is well here. word{k} again." for k in range(60)] + [f"all is well. you pathetic moron. ok{k}." for k in range(60)]
    scorer = toxicity._Scorer(toxicity.fit(train, [0] * 60 + [1] * 60, [1.0] * 120))
    short, long = scorer.score("all is well here."), "\n".join(f"all is well here, on day {k}." for k in range(20_000))
    assert scorer.score(long) == pytest.approx(short) and short < 0.5
    assert scorer.score(long + "\nyou pathetic moron.") >= 0.5


def test_long_labelled_texts_are_learnt_from(spark):
    docs = spark.createDataFrame([(i, "fine day. " * (20_000 if i % 2 else 1)) for i in range(12)], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id LONG, toxic INT")
    texts_, y, _ = labelled_sample(docs, labels, "toxic", 100)
    assert sum(y) == sum(len(t) > 100_000 for t in texts_) > 0


def test_labels_of_dropped_rows_leave_room_for_others(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id LONG, toxic INT")
    every = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id LONG, text STRING")
    first, _, _ = labelled_sample(every, labels, "toxic", 5)
    left = every.filter(~F.col("text").isin(first))
    texts_, y, weight = labelled_sample(left, labels, "toxic", 5)
    assert len(texts_) == 10 and sum(y) == 5 and not set(texts_) & set(first)
    n = {v: sum(i % 2 == v and zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200)) - 5 for v in (0, 1)}
    assert weight[y.index(1)] / weight[y.index(0)] == pytest.approx(n[1] / n[0])


def test_sentences_of_an_offence_are_found(spark):
    train = [f"all is well here. word{k} again." for k in range(60)] + [f"all is well. you pathetic moron. ok{k}." for k in range(60)]
    model = toxicity.fit(train, [0] * 60 + [1] * 60, [1.0] * 120)
    df = spark.createDataFrame([(1, "all is well.\nyou pathetic moron. all is well."), (2, "all is well here.")], "doc_id LONG, text STRING")
    found = toxicity.offending_sentences(df, model).collect()
    assert [(r.doc_id, r.sentence) for r in found] == [(1, "you pathetic moron.")]
    scores = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert scores[1] >= 0.5 > scores[2]


def test_noisy_or_and_constant_models():
    model = toxicity.fit([], [], [])
    assert model.constant == 0 and toxicity._Scorer(model).score("a") == 0
    assert quality_cnn.fit(["a"], [1], [1.0]).constant == 1.0


def test_the_fit_of_toxicity_holds_few_times_its_sample():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 9))) + rnd.choice(["", "", ".", ","])
    batch = [" ".join(word() for _ in range(300)) for _ in range(400)]
    tracemalloc.start()
    toxicity.fit(batch, [0, 1] * 200, [1.0] * 400, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * sum(map(len, batch))


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        raw = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        cut = quality_cnn.chunks(raw)
        joined = bytes(cut[0]) + b"".join(bytes(c[quality_cnn.CHUNK - quality_cnn.STEP :]) for c in cut[1:])
        assert joined.rstrip(b"\0") == raw


# -- 2: near-duplicates


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i in sorted(sets):
        for j in {j for s in sets[i] for j in by[s]}:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            by[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_all_pairs(spark, sf_dir, texts):
    got = run("op2_near_dedup", spark, sf_dir)
    want = brute_components(texts)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_groups_of_unlike_texts_with_a_common_passage(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, base = words(30), words(150)
    docs = {i: " ".join(words(40) + passage + words(20)) for i in range(260)}
    for i in range(260, 420):  # a chain of edits: neighbours are alike, the ends are not
        base = list(base)
        for _ in range(2):
            base[rng.randrange(len(base))] = words(1)[0]
        docs[i] = " ".join(base)
    df = spark.createDataFrame(list(docs.items()), "doc_id LONG, text STRING").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(docs)


def test_unlike_texts_that_share_a_passage_are_not_compared_in_pairs(spark, monkeypatch):
    rng, seen, plain = random.Random(8), [], near_dedup._likely

    def counted(pairs, sets, percent):
        seen.append(pairs.count())
        return plain(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "_likely", counted)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage, made = words(150), {}
    for n in (200, 800):
        seen.clear()
        texts = [f"{words(60)} {passage} {words(60)}" for _ in range(n)]
        near = [t.rsplit(" ", 3)[0] for t in texts[:20]]  # each is linked with its own text alone
        df = spark.createDataFrame(list(enumerate(texts + near)), "doc_id LONG, text STRING")
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
        assert got == {i: i - n if i >= n else i for i in range(n + 20)}
        made[n] = sum(seen)
    assert made[800] < 8 * made[200] and made[800] < 800 * 799 // 2 // 10


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for share in (0.2, 0.5, 0.75, 0.9):
        both = int(2000 * 2 * share / (1 + share))
        x = rng.integers(0, 2**63, 4000 - both, dtype=np.uint64)
        a, b = near_dedup.registers(x[:2000]), near_dedup.registers(x[2000 - both :])
        errors.append(abs(near_dedup.estimate(a, b, 2000, 2000)[0] - both / (4000 - both)))
    assert max(errors) < 0.15


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    root = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    assert got == {x: root[x] for p in pairs if p[0] != p[1] for x in p}


# -- 3, 5, 6, 10: tokens


def test_packed_pieces_are_the_librarys_ids(spark, sf_dir, texts):
    rows = queries.QUERIES["op3_pattern_packing"](spark, sf_dir).collect()
    tok = Tokenizer.from_file(WORD)
    want = {}
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[i, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.02 * -(-sum(w[1] for w in want.values()) // 2048) + 1


@pytest.mark.parametrize("seed,n,size", [(1, 400, 128), (2, 5000, 512), (3, 1, 64), (4, 0, 64)])
def test_a_plan_uses_up_the_histogram(seed, n, size):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(np.log(size / 3), 0.8, n).astype(int), 1, size)
    histogram = np.bincount(lengths, minlength=size + 1)
    chosen = packing.plan(histogram, size)
    used = np.zeros(size + 1, int)
    for parts, k in chosen:
        assert sum(parts) <= size and k > 0
        for v in parts:
            used[v] += k
    assert (used == histogram).all()
    assert sum(k for _, k in chosen) <= 1.05 * -(-int(lengths.sum()) // size) + 1


def test_packed_sequences_hold_the_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 30")
    pieces = packing.cut_pieces(docs, WORD, with_ids=True).cache()
    whole = packing.sequences(packing.pack(pieces)).collect()
    assert sum(len(r.ids) for r in whole) == pieces.agg(F.sum("length")).first()[0]
    assert all(len(r.ids) <= 2048 for r in whole)


def test_counts_of_texts_and_prefixes_equal_the_library(spark, sf_dir, texts):
    got = run("op5_prefix_token_counts", spark, sf_dir)
    tok = Tokenizer.from_file(BYTE)
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for i, t in texts.items():
        r = got[i]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n(t), n(t) > 512)
        assert n(t[: r["kept_chars"]]) <= 512
        if r["kept_chars"] < len(t):
            assert all(n(t[:k]) > 512 for k in range(r["kept_chars"] + 1, min(len(t), r["kept_chars"] + 4)))
    counter = prefix_counts.PrefixCounter(BYTE)
    for t in [*[e[:60] for e in EDGES if e], *[t[:150] for t in list(texts.values())[:15]]]:
        assert counter.prefixes(t) == [n(t[:k]) for k in range(len(t) + 1)]


@pytest.mark.parametrize("shared", [4, 128])
def test_prefix_counts_of_runs_equal_the_library(monkeypatch, shared):
    monkeypatch.setattr(prefix_counts, "SHARED", shared)
    tok, counter, rng = Tokenizer.from_file(BYTE), prefix_counts.PrefixCounter(BYTE), random.Random(5)
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    kinds = [" ", "'", "=", "\n", "ab", "the", "'s", "'ll", " '", "é", "7", "."]
    for _ in range(100):
        text = "".join(rng.choice(kinds) * rng.randint(1, 7) for _ in range(rng.randint(1, 9)))
        limit, want = rng.randint(0, 12), [n(text[:k]) for k in range(len(text) + 1)]
        assert counter.prefixes(text) == want
        assert counter.count(text, limit) == (want[-1], max(k for k, c in enumerate(want) if c <= limit))


@pytest.mark.parametrize("make", ["=", "abcdefgh", " ", "'", "x "])
def test_a_long_run_takes_linear_memory_and_stays_in_no_cache(make):
    rng = random.Random(9)
    text = "x " + "=" * 20_000 if make == "x " else "".join(rng.choice(make) for _ in range(20_000))
    tok, counter = Tokenizer.from_file(BYTE), prefix_counts.PrefixCounter(BYTE)
    tracemalloc.start()
    total, kept = counter.count(text, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000  # every prefix as a string of its own takes 200 MB
    caches = (counter.table, counter.counts.data, counter.first.data)
    assert all(len(k) <= prefix_counts.SHARED for cache in caches for k in cache)
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    assert total == n(text) and n(text[:kept]) <= 100 < n(text[: kept + 1])


def test_words_encode_like_whole_texts(texts):
    for path, spaces in ((BYTE, True), (WORD, False)):
        tok, words = Tokenizer.from_file(path), WordEncoder(path, spaces)
        for t in [*(e for e in EDGES if e is not None), *list(texts.values())[:60]]:
            assert np.frombuffer(words.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_words_joined_for_the_library_are_cut_apart_again(path, spaces):
    """Every letter below U+0250 before a sign, special strings, and words that hide a border."""
    tok, rnd = Tokenizer.from_file(path), random.Random(4)
    batch = [f"x{chr(c)}{s} {chr(c)}{s} {chr(c)}y" for c in range(0x250) for s in ".,"]
    batch += ["".join(rnd.choice("abcdeTH '\n.İßжx1 Ġ<,\x1c\x85|") for _ in range(rnd.randrange(120))) for _ in range(2_000)]
    batch += [t for t in EDGES if t is not None] + ["a <|endoftext|>b <|endoftext|> c</w> </w>", "  ", " İ."]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
    assert WordEncoder(path, spaces).encode_all(batch) == want
    few = WordEncoder(path, spaces, limit=20)  # generations change all the time
    assert [x for at in range(0, len(batch), 7) for x in few.encode_all(batch[at : at + 7])] == want


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_signs_behind_letters_are_encoded_once_for_all_words(path, spaces):
    tok, rnd = Tokenizer.from_file(path), random.Random(8)
    signs = ["***", "&&&", "!?", ".%%%", ",#", "$$$", "<|", "|>", "_~", ")]}", '"', "^`", ":;", "@"]
    batch = [" ".join(["a", *("".join(rnd.choices("abcdeXYé", k=9)) + rnd.choice(signs) for _ in range(30))]) for _ in range(80)]
    odd = ["it's!' x'*** 'll, 're. n't' '*", "a\u0338< b\u0301> c<\u0338 ", "9*** x9.. ٣!", "x***\ny... z.\n", "<|endoftext|>!! a<|endoftext|>***"]
    words = WordEncoder(path, spaces)
    words.tok = seen = Recorder(words.tok, "encode", "encode_batch", "encode_batch_fast")
    want = lambda some: [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
    assert words.encode_all(batch) == want(batch) and {t.strip() for t in seen.texts} <= {"a", *signs}
    assert words.encode_all(odd) == want(odd)


def test_a_word_is_encoded_once_while_there_is_room():
    rnd, fills = random.Random(9), []
    batch = [" ".join(["a", *("".join(rnd.choices("abcdefgh", k=5)) for _ in range(50))]) for _ in range(400)]
    words, tok = WordEncoder(BYTE, limit=20_000), Tokenizer.from_file(BYTE)
    fill = words._fill
    words._fill = lambda parts: fills.append(len(parts)) or fill(parts)
    got = [x for _ in range(3) for at in range(0, 400, 100) for x in words.encode_array(pa.array(batch[at : at + 100])).to_pylist()]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
    assert got == 3 * want and sum(fills) == len({w for t in batch for w in t.split(" ")[1:]})
    assert words.encode_array(pa.array(["", "b c"]), b"....").to_pylist() == [x + b"...." for x in words.encode_all(["", "b c"])]


def test_batches_are_gathered_by_their_bytes():
    batch = pa.RecordBatch.from_pydict({"i": list(range(1_000)), "t": ["x" * (10 if k < 500 else 5_000) for k in range(1_000)]})
    got = list(gathered(iter([batch.slice(0, 0), batch.slice(0, 400), batch.slice(400)]), 100_000))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(1_000)) and len(got) == 3
    assert not list(gathered(iter([])))


def test_the_store_gives_back_what_was_written(spark, sf_dir, texts):
    got = run("op6_token_store", spark, sf_dir)
    tok, at = Tokenizer.from_file(BYTE), 0
    for i in sorted(texts):
        ids = np.array(tok.encode(texts[i], add_special_tokens=False).ids + [2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_stores_of_edges_and_of_nothing(spark, edges, empty):
    for df, n in ((edges, len(EDGES) + 1), (empty, 0)):
        path = scratch_path(spark, "store")
        token_store.write_store(df, path, BYTE)
        back = token_store.read_store(spark, path).collect()
        assert len(back) == n and all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in back)


@pytest.mark.parametrize("n", [1, 2, 127, 128, 5000, 300_000])
def test_blocks_decode_from_any_checkpoint_and_notice_damage(n):
    ids = (np.random.default_rng(n).pareto(1, n) * 3).astype(np.int64) % 50_000
    coder = token_store.Coder(token_store.frequencies(np.bincount(ids)))
    payload = coder.encode(ids)
    assert (coder.decode(payload) == ids).all()
    if n > 2 * token_store.EVERY * token_store.LANES:
        step = token_store.EVERY * token_store.LANES
        assert (coder.decode(payload, 1, 2) == ids[step : 2 * step]).all()
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(broken))


def test_pieces_and_spans(spark, sf_dir, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = run("op10_offset_pieces", spark, sf_dir)
    for i, t in texts.items():
        ids = [*sp.encode(t), 2]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == sha(sp.decode(ids))
    encoder = offset_pieces.OffsetEncoder(PIECE)
    for t in [*(e for e in EDGES if e), *list(texts.values())[:40]]:
        ids, starts, ends, _ = encoder.encode(t)
        slow = encoder._aligned(t)
        assert ids.tolist() == sp.encode(t) == list(slow[0])
        assert starts.tolist() == slow[1].tolist() and ends.tolist() == slow[2].tolist()
        assert ends[-1] == len(t.encode()) and starts[0] == 0 and (starts[1:] == ends[:-1]).all()


def test_the_character_map_normalises_like_the_library(texts):
    theirs = sentencepiece.SentencePieceNormalizer(
        rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True
    )
    spec = [v for f, v in offset_pieces.message_fields(theirs.serialized_model_proto()) if f == 3][-1]
    ours = offset_pieces.Normalizer(spec)
    for t in ["ﬁne ｆｕｌｌ　width ①② ㍿  x", "    lead  trail 　 ", "é ½ ™", *(e[:500] for e in EDGES if e), *list(texts.values())[:40]]:
        out, starts, ends = ours.normalize(t)
        assert out.decode() == theirs.normalize(t)
        assert len(out) == len(starts) == len(ends) and (starts <= ends).all() and (np.diff(starts) >= 0).all()


# -- 7: rules are compared with SQL by test_registered


def test_rules_name_what_fails(spark):
    df = spark.createDataFrame([(1, "## " * 80), (2, "the cat and the dog of it " * 3)], "doc_id LONG, text STRING")
    got = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert "symbols" in got[1].failed_rules and got[2].failed_rules[0] == "too_short"
    assert got[1].n_repeat_words == 80 and not got[1].kept


# -- 8: sketches


def test_sketches_equal_sets_of_paragraphs(spark, sf_dir, texts):
    got = run("op8_paragraph_sketch", spark, sf_dir)
    digests, order = paragraph_sketch.Digests(), sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, following = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        a, b, c = (set(digests.of(x).tolist()) for x in (t, edited, following))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - like(a, b)) < 1e-12 and abs(r["near_next"] - like(a, c)) < 1e-12
        assert r["fingerprint"] == paragraph_sketch.fingerprint(t, digests.of(t))


def test_peeling_recovers_differences_of_any_size():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 100, 3000):
        x = rng.integers(0, 2**63, 2 * n + 50, dtype=np.uint64)
        ours, theirs = paragraph_sketch.difference(x[: n + 50], x[n:])
        assert set(ours.tolist()) == set(x[:n].tolist()) and set(theirs.tolist()) == set(x[n + 50 :].tolist())
    assert paragraph_sketch.Sketch(x, 24).minus(paragraph_sketch.Sketch(x[:0], 24)).peel() is None


def test_many_pairs_are_peeled_at_once_and_from_any_first_size():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 40, 700, 0, 5000)]
    sets += [np.concatenate([sets[3][:600], sets[2]]), sets[5][:-1], sets[5]]
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    want = [(set(sets[a].tolist()), set(sets[b].tolist())) for a, b in zip(left, right)]
    for size in (None, 24):  # by the estimate, and doubled from the smallest sketch
        digest, pair, side = paragraph_sketch.differences(items, owner, left, right, len(sets), size)
        for k, (a, b) in enumerate(want):
            of = lambda sign: set(digest[(pair == k) & (side == sign)].tolist())  # noqa: B023, E731
            assert of(1) == a - b and of(-1) == b - a
    like = paragraph_sketch.likeness(items, owner, left, right, len(sets))
    assert np.allclose(like, [len(a & b) / len(a | b) if a | b else 1.0 for a, b in want])


def test_digests_of_a_text_do_not_depend_on_its_neighbours():
    digests, many = paragraph_sketch.Digests(), ["", "a b\nc", " \n", "x" * 5000, "a b\nc", "a b\nc\na b", "é 日本 " * 40, "b\na"]
    items, owner = digests.of_all(many)
    for k, t in enumerate(many):
        assert items[owner == k].tolist() == paragraph_sketch.Digests().of(t).tolist()
    assert len(set(digests.of("a b\nc\na b").tolist())) == 3 and set(digests.of("a\nb")) == set(digests.of("b\n a"))


# -- 9: repeats


def brute_repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        hit = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                hit[k : k + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, h in zip(raw, hit) if not h)
        runs = sum(1 for k, h in enumerate(hit) if h and (not k or not hit[k - 1]))
        out[i] = (len(raw), sum(hit), runs, hashlib.sha256(left).hexdigest())
    return out


def test_removed_bytes_equal_brute_force(spark, sf_dir, texts):
    got = run("op9_repeated_bytes", spark, sf_dir)
    fields = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert {i: tuple(r[f] for f in fields) for i, r in got.items()} == brute_repeats(texts)


def test_removed_bytes_of_periodic_and_shared_texts(spark):
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(150))
    docs = {1: "a" * 500, 2: "ab" * 300, 3: line, 4: "x" + line + "y", 5: line[:99], 6: line[:100], 7: line[20:] + line[:130], 8: "é" * 200}
    for i in range(10, 40):
        at = rng.randrange(140)
        docs[i] = line[:at] + str(i) + line[at:]
    df = spark.createDataFrame(list(docs.items()), "doc_id LONG, text STRING").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
    assert got == brute_repeats(docs)
    # The path by windows, which very common names take, finds the same.
    lists = {r.doc_id: r.list for r in repeats.repeated_spans(df, held=2).collect()}
    ids = sorted(docs)
    cut = repeats.cut_texts([docs[i] for i in ids], [lists.get(i) for i in ids])
    assert {i: (len(raw), len(raw) - len(left)) for i, (raw, left, _) in zip(ids, cut)} == {i: g[:2] for i, g in got.items()}


# -- the pipeline


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in kept.collect()}
        path = scratch_path(spark, name)
        stage(spark, kept, sf_dir).write.parquet(path)
        kept = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in kept.collect()}
        if k < 4:
            assert kept.columns == columns
        if name in ("quality", "toxicity"):
            assert set(after) < set(before) and len(after) > 0.8 * len(before)
        if name == "near_duplicates":
            want = brute_components({i: r["text"] for i, r in before.items()})
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        if name == "repeats":
            want = brute_repeats({i: r["text"] for i, r in before.items()})
            assert set(after) == set(before)
            clean = [i for i in want if not want[i][1]]
            assert all(after[i]["text"] == before[i]["text"] for i in clean)
            assert all(after[i]["n_chars"] == len(after[i]["text"]) for i in after)
            assert all(len(after[i]["text"].encode()) <= want[i][0] - want[i][1] for i in after)
        if name == "packing":
            assert set(after) == set(before)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_registered(spark, sf_dir, name):
    from tests.oracle import compare, connect

    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) is None


def test_entry_has_the_eleven():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names


# -- memory of the workers

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_near_duplicates_hands_python_few_rows_at_once(spark, monkeypatch):
    """A batch of texts, or of pairs of them, stands in the buffers of both sides at once."""
    seen, before = [], spark.conf.get(BATCH)
    for name in ("signatures", "verify"):
        step = getattr(near_dedup, name)
        monkeypatch.setattr(near_dedup, name, lambda *a, _step=step, **k: seen.append(spark.conf.get(BATCH)) or _step(*a, **k))
    rows = [(i, " ".join(f"w{k}" for k in range(40)) + f" v{i}") for i in range(4)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}
    assert len(seen) >= 2 and {int(x) for x in seen} == {1024} and spark.conf.get(BATCH) == before


def test_token_store_encodes_and_numbers_in_one_worker(spark, tmp_path, monkeypatch):
    """No step in Python feeds another one in the same task: both workers of the task would keep the words."""
    rows = [(i, f"one text {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, chained, made = type(df).mapInArrow, [], []

    def step(self, *args, **kwargs):
        chained.append(any(self is x for x in made))
        made.append(plain(self, *args, **kwargs))
        return made[-1]

    monkeypatch.setattr(type(df), "mapInArrow", step)
    token_store.write_store(df, str(tmp_path / "store"), BYTE)
    assert chained and not any(chained)
    assert [r["doc_id"] for r in token_store.read_store(spark, str(tmp_path / "store")).orderBy("start").collect()] == [0, 1, 2, 3, 4]


def test_a_worker_keeps_the_objects_of_one_operator():
    """Spark hands workers on, and each would come to hold the caches of every operator of a pipeline."""
    per_worker("first", dict)
    kept = per_worker("second", dict, alone=True)
    assert per_worker("second", dict, alone=True) is kept
    kept["used"] = True
    assert per_worker("first", lambda: {"new": True}) == {"new": True} and per_worker("second", dict)["used"]


def test_repeats_work_on_few_bytes_at_once(monkeypatch):
    """Names, minima and places are arrays of eight bytes for each byte that is worked on."""
    seen, plain = [], repeats.names
    monkeypatch.setattr(repeats, "names", lambda raw: seen.append(len(raw)) or plain(raw))
    rnd = random.Random(3)
    values = ["".join(rnd.choices("abcdefg ", k=1_000)) for _ in range(1_000)] + ["xy" * 400_000]
    done = list(repeats.cut_texts(values, [None] * len(values)))
    assert [raw.decode() for raw, _, _ in done] == values and [left for _, left, _ in done[:-1]] == [t.encode() for t in values[:-1]]
    assert max(seen[:-1]) <= 1 << 18 and seen[-1] == 800_000


# -- work of the encoders


class Recorder:
    """Passes calls on and keeps the texts that ``names`` were called with."""

    def __init__(self, to, *names):
        self.to, self.names, self.texts, self.calls = to, names, [], 0

    def __getattr__(self, name):
        found = getattr(self.to, name)
        if name not in self.names:
            return found

        def call(some, *args, **kwargs):
            self.calls += 1
            self.texts += [some] if isinstance(some, str) else some
            return found(some, *args, **kwargs)

        return call


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_words_of_letters_skip_the_rule_that_splits_texts(path, spaces):
    rnd, fills = random.Random(6), []
    word = lambda: "".join(rnd.choices("abcdefgéèßŁXYZ", k=rnd.randrange(2, 12)))
    batch = [" ".join(["a", *(word() + rnd.choice(["", "", ",", "."]) for _ in range(40)), "it's"]) for _ in range(300)]
    words, tok = WordEncoder(path, spaces, limit=2_000), Tokenizer.from_file(path)
    words.tok = seen = Recorder(words.tok, "encode", "encode_batch", "encode_batch_fast")
    fill = words._fill
    words._fill = lambda parts: fills.append(len(parts)) or fill(parts)
    got = [x for at in range(0, 300, 100) for x in words.encode_all(batch[at : at + 100])]
    assert got == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
    assert {t.strip() for t in seen.texts} <= {"a", "it's"} and len(fills) == 3


def test_offset_pieces_ask_the_library_once_for_the_new_words_of_a_batch(texts):
    encoder, sp = offset_pieces.OffsetEncoder(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    batch = [t for t in list(texts.values())[:60] if t and t == t.strip(" ") and "  " not in t and offset_pieces.MARK not in t]
    encoder.sp = seen = Recorder(encoder.sp, "encode")
    got = list(encoder.encode_all([*batch, *batch]))
    assert [x[0].tolist() for x in got] == [sp.encode(t) for t in [*batch, *batch]]
    assert len(batch) > 20 and seen.calls == -(-len(seen.texts) // 4096) and len(seen.texts) == len(set(seen.texts))


def test_copies_just_below_the_threshold_stay_apart(spark):
    """Half of the copies are linked with the first text, the others with nothing, though all share most of it."""
    rng = random.Random(12)
    base, docs = [f"w{rng.randrange(10**9)}" for _ in range(240)], {}
    for i in range(160):
        copy = list(base)
        for at in rng.sample(range(8, 232, 8), 0 if not i else 6 if i % 2 else 7):
            copy[at] = f"w{rng.randrange(10**9)}"
        docs[i] = " ".join(copy)
    df = spark.createDataFrame(list(docs.items()), "doc_id LONG, text STRING")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(docs)
