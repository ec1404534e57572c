"""Periodic runs, conversation repair and token files, each against brute force or the library itself."""

import hashlib
import heapq
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from digestflow.llm import periodic_runs, queries, token_files, turn_repair
from digestflow.llm._shared import WORD

SF = "/root/testdata/sf0.001"
BPE = "byte_bpe_50k.json"


def brute_runs(w):
    """Every lag's stretches of equal words; of stretches found at several lags, the least."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def odd_texts(rng):
    """Words of small and large alphabets, with stretches repeated at random, Fibonacci words, one word over and over."""
    fib = ["a", "b"]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    yield from ["", None, " \n", "x", "x " * 11, "x " * 12, "x y " * 40, " ".join(fib[-1]), "a b\t" * 300 + "c", ("q " * 30 + "r ") * 12]
    for _ in range(400):
        n = rng.randint(1, 120)
        w = [str(rng.randrange(rng.choice([1, 2, 3, 40]))) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            s, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            for i in range(s, min(n, s + rng.randint(1, 5) * p + rng.randint(0, p))):
                w[i] = w[s + (i - s) % p]
        yield " ".join(w)


def test_runs_are_those_of_brute_force(frame):
    texts = list(odd_texts(random.Random(3)))
    rows = [(i, t, "other", 1) for i, t in enumerate(texts)] + [(None, "z " * 20, "", 0), (0, "z " * 20, "", 0)]
    got = periodic_runs.find_runs(frame(rows, "doc_id long, text string, runs string, id int")).collect()
    assert len(got) == len(rows)
    known = {(i, len(re.findall(WORD, t or ""))): t for i, t, _, _ in rows}
    for r in got:
        w = re.findall(WORD, known[r.id, r.n_words] or "")
        want = brute_runs(w)
        assert [tuple(x) for x in r.runs] == want
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic_runs.find_runs(frame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("words", [np.zeros(300_000, np.int64), np.array(([0] * 500 + [1]) * 400), np.array([0] * 90_000 + [1] + [0] * 90_000), np.repeat(np.arange(20_000), 8)])
def test_long_documents_take_linear_work(words):
    """One word over and over and the like: candidates stay in proportion to the words (quadratic work would not end)."""
    grams = periodic_runs.runs_of(words, np.array([len(words)]))
    stretches = sorted(zip(*(x.tolist() for x in grams[1:])))
    for start, length, period in stretches[:50]:
        part = words[start : start + length]
        assert (part[period:] == part[:-period]).all()
    assert len(stretches) <= len(words) // 12


def test_op11_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        w = re.findall(WORD, d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs, r = brute_runs(w) if n < 1500 or h % 10 == 0 and n < 6000 else None, got[d.doc_id]
        if runs is None:
            continue
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def brute_repair(rows):
    """rows (turn, role, text) in order -> what op12 tells, by Dijkstra's search over (cost, letters)."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, made = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            break
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in follow:
                heapq.heappush(heap, (cost + 2, audit + "I", at, role[0], (*made, f"{role}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, made))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                if (state, role[:1]) in follow:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, follow[state, role[:1]], (*made, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if (state, other[0]) in follow:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, other[0], (*made, f"{other}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(), list(made))


def told(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


@pytest.mark.parametrize("piece", [2, 4096])
def test_repairs_are_those_of_brute_force(frame, piece):
    """Odd roles, null turns, gaps and copies; conversations in pieces of two rows and whole ones; a long one; one without rows."""
    rng, convs = random.Random(piece), {}
    for c in [None, *range(120)]:
        n = 150 if c == 7 else rng.randint(1, 9)
        turns = sorted(rng.sample(range(-3, n + 5), n))
        roles = ["user", "assistant", "system", "tool", "", "s", "um"] if rng.random() < 0.5 else ["user", "assistant"]
        texts = ["yes.", "no", " ", "", "why?\n", "end. \t", "a ", " "]
        convs[c] = [(None if i == 0 and rng.random() < 0.2 else t, rng.choice(roles), rng.choice(texts) + str(rng.choice(["", "", i])) * rng.randint(0, 1)) for i, t in enumerate(turns)]
    rows = [(c, t, r, x, "clash") for c, part in convs.items() for t, r, x in part]
    rng.shuffle(rows)
    every = frame([(c,) for c in [*convs, 999]], "conv long")
    repair = turn_repair.Repair(frame(rows, "conv long, turn long, role string, text string, kind string"), every, piece)
    got = {r.conv: r for r in repair.digests().collect()}
    assert len(got) == len(convs) + 1
    mended = defaultdict(list)
    for r in repair.repaired().orderBy("turn").collect():
        mended[r.conv].append(f"{r.role}:{r.text}")
    for c, part in convs.items():
        want = brute_repair(part)
        assert told(got[c]) == want[:-1], c
        assert mended[c] == want[-1]
    assert told(got[999]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_awkward_rows(frame):
    ddl = "conv string, turn int, role string, text string"
    assert turn_repair.Repair(frame([], ddl)).digests().count() == 0
    # null roles and texts are one space; rows of one turn go by role; repeated rows are duplicates
    got = turn_repair.Repair(frame([("c", 1, "user", "hi."), ("c", 1, "assistant", "ho."), ("c", 1, "user", "hi."), ("c", None, None, None), ("d", None, "user", "x" * 300_000 + "!")], ddl)).digests()
    r = {x.conv: x for x in got.collect()}
    assert (r["c"].blank, r["c"].duplicate, r["c"].gaps, r["c"].illegal) == (1, 1, 0, 2)
    # Delete, Keep the assistant's row after an inserted user's, ...: the cheapest
    assert (r["c"].cost, r["c"].audit) == brute_repair([(None, " ", " "), (1, "assistant", "ho."), (1, "user", "hi."), (1, "user", "hi.")])[5:7]
    assert (r["d"].cost, r["d"].audit) == (2, "KI")


def test_op12_on_the_given_conversations(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    damaged, convs = defaultdict(list), {c for c, *_ in rows}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        damaged[c] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    got = {r.conv_id: r for r in queries.op12_turn_repair(spark, SF).collect()}
    assert set(got) == convs
    for c in convs:
        assert told(got[c]) == brute_repair(damaged[c])[:-1]


def test_auction_finds_every_distance():
    """Prices between all states, against relaxation until nothing changes."""
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice("suat"), rng.randrange(4)) for _ in range(rng.randint(0, 7))]
        for ends in [(0,), (1,), (2,), (3,), (0, 3)]:
            far = {(len(rows), e): 0 for e in ends}
            for _ in range(40):
                for at in range(len(rows) + 1):
                    for x in range(4):
                        best = min((c + far[a, y] for _, c, a, y in turn_repair.arcs(rows, at, x) if (a, y) in far), default=None)
                        if best is not None and best < far.get((at, x), 1 << 30):
                            far[at, x] = best
            assert turn_repair.prices(rows, ends) == far


def odd_documents():
    rng = random.Random(11)
    texts = ["", None, "a", "<|endoftext|> x<|endoftext|>", "  two  spaces ", "x y z", "é" * 50, "word " * 4000, "x" * 20_000, "\n\n\t"]
    return texts + [" ".join(rng.choice(["der", "the", "être", "🙂", "1234", "don't", "…"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]


@pytest.mark.parametrize("shard_bytes", [token_files.SHARD, 600])
def test_token_files_hold_the_library_ids(spark, frame, tmp_path, shard_bytes):
    texts, folder = odd_documents(), f"file://{tmp_path}/tokens"
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(3, "again", "", 0), (3, "again", "", 0), (None, "no id", "", 0)]
    manifest = token_files.write(frame(rows, "doc_id long, text string, start string, nr int"), public_tokenizers.path(BPE), folder, 2, shard_bytes=shard_bytes)
    library = Tokenizer.from_file(public_tokenizers.path(BPE))
    encoded = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    got = token_files.read(spark, folder, with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows) == manifest["documents"] and manifest["dtype"] == "<u2"
    assert [r.id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    want = {i: encoded(t) for i, t, *_ in rows[: len(texts)] if i != 3}
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.token_ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
        if r.id in want:
            assert r.token_ids == want[r.id]
        at += r.n_tokens
    assert sorted(r.token_ids for r in got if r.id == 3) == sorted([encoded(texts[3]), encoded("again"), encoded("again")])
    assert at == manifest["tokens"] and (shard_bytes > 600 or len(manifest["shards"]) > 4)
    # documents and stretches by their place, mapped into memory
    files, flat = token_files.TokenFiles(folder), [i for r in got for i in r.token_ids]
    assert all(files.document(k).tolist() == r.token_ids for k, r in enumerate(got))
    for start, stop in [(0, at), (5, 5), (at - 3, at + 10), (100, 4000), (at, at + 1)]:
        assert files.tokens(start, stop).tolist() == flat[start:stop]
    with pytest.raises(IndexError):
        files.document(len(got))


def test_token_files_without_rows(spark, frame, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_files.write(frame([], "doc_id string, text string"), public_tokenizers.path(BPE), folder, 2)["shards"] == []
    got = token_files.read(spark, folder)
    assert got.count() == 0 and dict(got.dtypes)["id"] == "string"
    assert token_files.TokenFiles(folder).tokens(0, 5).tolist() == []


def test_files_of_attempts_that_failed_are_in_no_manifest(spark, frame, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    (tmp_path / "tokens").mkdir()
    (tmp_path / "tokens" / "000000-0000-dead.bin").write_bytes(b"\x01\x00")
    token_files.write(frame([(1, "one two")], "doc_id long, text string"), public_tokenizers.path(BPE), folder, 2)
    names = [s["name"] for s in json.loads((tmp_path / "tokens" / "manifest.json").read_text())["shards"]]
    assert len(names) == 1 and "dead" not in names[0]
    assert token_files.read(spark, folder).count() == 1


def test_wide_ids():
    assert token_files.width_of(public_tokenizers.path(BPE), 2) == "<u2"
    assert token_files.width_of(public_tokenizers.path(BPE), 70_000) == "<u4"


def test_op13_on_the_given_documents(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    library = Tokenizer.from_file(public_tokenizers.path(BPE))
    got = {r.doc_id: r for r in queries.op13_token_files(spark, SF).collect()}
    at = 0
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_new_queries_name_their_columns(spark):
    names = {
        "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
        "op12_turn_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
        "op13_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    }
    for name, columns in names.items():
        df = queries.QUERIES[name](spark, SF)
        assert set(columns) <= set(df.columns)
        assert all(df.schema[c].dataType.simpleString() == "bigint" for c in columns if c not in ("runs_sha256", "collapsed_sha256", "audit", "repaired_sha256"))
