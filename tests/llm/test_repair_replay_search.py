"""Conversation repair, merge replay and ranked search against brute force and the library."""

import base64
import hashlib
import os
import random
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from scorelens.llm import conversation_repair, merge_replay, norm_buckets, queries
from tests.oracle import compare, connect

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# -- 11: conversation repair

MOVES = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        pick = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if pick == 0:
            continue
        text = "" if pick == 1 else "".join(c for c in text if c not in ".!?") if pick == 2 else text
        kept += [(turn, "user" if pick == 4 else role, text)] * (2 if pick == 3 else 1)
    return out


def cheapest(signs):
    """Least (cost, audit) by the best suffix from every state, relaxed until insertions settle."""
    far = (10**9, "~")
    best = {q: (0, "") if q in "03" else far for q in "0123"}

    def insert(best):
        for _ in range(4):
            for (q, _s), to in MOVES.items():
                if _s != "s":
                    best[q] = min(best[q], (best[to][0] + 3, "I" + best[to][1]))
        return best

    best = insert(best)
    for initial, fault in reversed(signs):
        now = {}
        for q in "0123":
            ways = [(best[q][0] + 4, "D" + best[q][1])]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                for put, cost, letter in ((initial, 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                    if (q, put) in MOVES:
                        to = best[MOVES[q, put]]
                        ways.append((to[0] + cost + extra, letter + to[1]))
            now[q] = min(ways)
        best = insert(now)
    return best["0"]


def repaired_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, signs = set(), []
    for _, role, text in rows:
        shown = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        signs.append((role[:1], fault))
        seen.add((role, text))
    cost, audit = cheapest(signs)
    put, source, lead = [], iter(rows), sum(c != "D" for c in audit) % 2
    for letter in audit:
        _, role, text = next(source) if letter != "I" else (None, "", "")
        if letter != "D":
            put.append(f"{role if letter == 'K' else ('user', 'assistant')[(len(put) - lead) % 2]}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    faults = [f for _, f in signs]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(signs, signs[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(put).encode()).hexdigest(),
    )


def conversations(seed):
    rnd, rows = random.Random(seed), []
    for conv in [None, *range(120)]:
        n = rnd.choice([1, 1, 2, 3, 5, 9, 14, 40]) if conv != 7 else 1_400
        for i in range(n):
            turn = rnd.choice([None, *range(-3, n + 4)]) if rnd.random() < 0.3 else i
            role = rnd.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"])
            rows.append((conv, turn, role, rnd.choice([None, "", " ", "Hi.", "Ok", "Fine!\n", "é?", f"x{i}.", f"y{i}"])))
    # A conversation of many rows at one turn, and one that is only blank.
    rows += [(500, 3, "user", f"same turn {i % 300}.") for i in range(700)] + [(501, None, None, None)] * 3
    return rows


def test_repair_equals_suffix_dynamic_program(spark):
    rows = conversations(1)
    df = spark.createDataFrame(
        [(*r, i, "x", 0) for i, r in enumerate(rows)],
        "conv_id long, turn long, role string, text string, slot long, audit string, kind int",
    ).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.repair(df).collect()}
    assert got == {conv: repaired_by_hand(kept) for conv, kept in damage(rows).items()}


def test_repair_of_given_rows_and_lost_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, 5, "assistant", "No.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "conv_id long")
    got = {r["conv_id"]: r.asDict() for r in conversation_repair.repair_rows(df, ids).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == (0, "KKK")
    assert got[1]["repaired_sha256"] == hashlib.sha256(b"system:Be kind.\nuser:Hi.\nassistant:Yes.").hexdigest()
    assert (got[2]["cost"], got[2]["audit"]) == (3, "IK")
    lost = got[3]
    assert lost["audit"] == "" and lost["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(lost[c] == 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))


def test_repair_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(empty).collect() == []


def test_op11_equals_suffix_dynamic_program(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert got == {conv: repaired_by_hand(kept) for conv, kept in damage(rows).items()}


@pytest.mark.parametrize("seed", range(3))
def test_agenda_finds_the_least_weight_of_every_item(seed):
    """Against relaxing all deductions until nothing changes; ties go to the least audit."""
    rnd = random.Random(seed)
    signs = tuple(rnd.choice(["s", "u", "a", "o", "x", "u-", "a-"]) for _ in range(9))
    items = {(x["source"], x["target"]): (x["cost"], x["audit"]) for x in conversation_repair.block_items(signs)}
    faults = {"x": "blank"}
    by_hand = cheapest([(s[0], faults.get(s, "truncated" if s.endswith("-") else "")) for s in signs])
    assert min(items[0, q] for q in (0, 3) if (0, q) in items) == by_hand


# -- 12: merge replay


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    "", " ", "   ", " a", "\n\n a  b\r\n", "q" * 30_000, " " * 1_000, "=" * 70_001, "aaab" * 999, "the" * 5_000, "tab\tand",
    "x <|endoftext|> y", "日本語 テキスト 🎉🎉", "é ﬁ ½ \x00 \x1c z", "I'll 'll they've 's' 'S", "İ. ª, º;", "a b  c", "x  \n  y ",
]


def test_replay_equals_the_library(library):
    encoder = merge_replay.Replayer(RANKS, public_tokenizers.PATTERN)
    rnd = random.Random(0)
    letters = [t for t in (x.decode("utf8", "ignore") for x in encoder.merges.tokens[:20_000]) if t.isalpha()]
    texts = [*ODD, *("".join(rnd.choice("abcdeth '\n.İßжx1 ") for _ in range(rnd.randrange(200))) for _ in range(1_500))]
    # Words made of tokens meet merges whose result ranks before one that was merged already.
    texts += ["".join(rnd.choices(letters, k=rnd.randrange(1, 6))) for _ in range(20_000)]
    for size in (len(texts), 700):
        got = [x for at in range(0, len(texts), size) for x in encoder.encode(texts[at : at + size])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(t) for t in texts]


def test_generations_forget_words_without_changing_ids(library, monkeypatch):
    monkeypatch.setattr(merge_replay, "KEPT", 50)
    encoder = merge_replay.Replayer(RANKS, public_tokenizers.PATTERN, {" w1": np.array(library.encode(" w1"), "<u4").tobytes()})
    for at in range(0, 900, 30):
        texts = [" ".join(f"w{(k * 7 + at) % 200}," for k in range(20)), f"w1 W{at}!  w1"]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert len(encoder.spaced.young) < 200


def test_ids_and_decoding_of_edges(spark, library):
    rows = [(i if i else None, t, 7, "x") for i, t in enumerate([None, *ODD, ODD[4]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(3)
    ids = merge_replay.encode(df, RANKS, public_tokenizers.PATTERN)
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in ids.collect()) == [
        (i or 0, library.encode_ordinary(t or "")) for i, t, *_ in rows
    ]
    back = {r["doc_id"]: bytes(r["bytes"]) for r in merge_replay.decode(ids, RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t, *_ in rows}
    assert merge_replay.encode(df.limit(0), RANKS, public_tokenizers.PATTERN, True).collect() == []


def test_frequent_words_are_those_with_the_highest_counts(spark):
    df = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k + 1))) for k in range(60)], "doc_id long, text string")
    counts = {r["word"]: r["n"] for r in merge_replay.word_counts(df, public_tokenizers.PATTERN).collect()}
    assert (counts["w"], counts["0"], counts["59"]) == (60, 60, 1)
    few = merge_replay.frequent_words(df, RANKS, public_tokenizers.PATTERN, most=12)
    assert 0 < len(few) <= 12 and min(counts[w] for w in few) >= max(n for w, n in counts.items() if w not in few)


def test_op12_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    known = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_merge_replay"](spark, sf).collect()}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    for i, text in known.items():
        ids = library.encode_ordinary(text)
        assert got.pop(i) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))
    assert not got


def test_replay_cuts_a_text_once(library):
    """Splitting is most of the work on known words; texts with runs of white space are cut by a search instead."""

    class Text(str):
        cuts = 0

        def split(self, *args):
            Text.cuts += 1
            return super().split(*args)

    encoder = merge_replay.Replayer(RANKS, public_tokenizers.PATTERN)
    texts = ["w1 w2, it's n0", "a\tb c", "", "one", "a \n b", " a", "a ", "a  b", "a \u00a0b", "日本 語"]
    got = encoder.encode([Text(t) for t in texts])
    assert Text.cuts == 5
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert [encoder.decode(np.frombuffer(x, "<u4")).decode() for x in got] == texts


# -- 13: ranked search


def score_all(docs, items, top):
    """Every document's score for every item, by the formula, in Python integers."""
    words = [(i, norm_buckets.terms_of(t or "")) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, total = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in words:
            m = 50 + (50 * len(w) * n_docs) // total
            score = sum(
                norm_buckets.weight(n_docs, df[t]) * ((1_000_000_000 * w.count(t)) // (1000 * w.count(t) + 20 * m))
                for t in set(norm_buckets.terms_of(text or "")) & set(w)
            )
            scores.append((-score, i is None, i or 0, i))
        kept = [x for x in sorted(scores, key=lambda x: x[:3]) if x[0] < 0][:top]
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(kept)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def searched():
    """Ties, copies, a hot word, nulls, a long text and words outside ASCII."""
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "straße", "日本", "N0"]
    docs = [(k, "hot " + " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 5, 30])))) for k in range(700)]
    docs += [(1_000 + k, "Hot w1,w1;W2") for k in range(200)] + [(5, "w1 w2")] * 2
    docs += [(None, "w1 W2 hot"), (2_000, None), (2_001, ""), (2_002, " .,;"), (2_003, "w3 " * 3_000)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 12, 40])))) for k in range(25)]
    items += [(None, "W1 w2"), (100, None), (101, ""), (102, "nowhere"), (103, "hot w1 w1 w2"), (103, "w9 hot")]
    return docs, items


def asked(items):
    """One item for each id, with the terms of all its rows."""
    out = {}
    for i, t in items:
        out[i] = f"{out.get(i, '')} {t or ''}"
    return out.items()


@pytest.mark.parametrize("top,head,block", [(50, 4_096, 1_000), (3, 1, 4), (10, 100, 1_000)])
def test_search_equals_scoring_everything(spark, searched, monkeypatch, top, head, block):
    monkeypatch.setattr(norm_buckets, "HEAD", head)
    monkeypatch.setattr(norm_buckets, "ITEMS", block)
    docs, items = searched
    df = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, text string, item_id int, score double")
    asks = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    assert found(norm_buckets.search(df.repartition(4), asks, top)) == score_all(docs, asked(items), top)


def test_search_in_empty_tables(spark, searched):
    docs = spark.createDataFrame(searched[0][:5], "doc_id long, text string")
    asks = spark.createDataFrame(searched[1], "item_id long, text string")
    assert norm_buckets.search(docs.limit(0), asks).collect() == []
    assert norm_buckets.search(docs, asks.limit(0)).collect() == []


def test_op13_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_norm_buckets"](spark, sf)
    assert compare(got, connect(sf), queries.ORACLES["op13_norm_buckets"]) is None


def test_workers_need_no_copy_of_the_package(tmp_path):
    """From another folder, where a worker could not import anything of this repository."""
    script = tmp_path / "run.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {os.getcwd()!r})
import __spark_entry__
from scorelens.session import local_session
spark = local_session(2, 2)
for name, query in __spark_entry__.queries().items():
    if name.startswith(("op1_", "op4_", "op11_", "op12_", "op13_")):
        print(name, query(spark, "/root/testdata/sf0.001").count())
"""
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) == 10 and "op12_merge_replay 200" in done.stdout
