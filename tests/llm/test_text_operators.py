"""Operators on texts against brute force and the libraries themselves, with the awkward rows: nulls, blanks, long texts,
repeated rows and columns whose names clash."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from digestflow.llm import bpe_codec, byte_bpe, exact_dedup, fingerprints, jaccard_join, language_id, mixing, suffix_dedup, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
DDL = "doc_id long, text string, key string, bucket int, score double, row string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(n))


def awkward():
    rng = random.Random(1)
    base = words(rng, 400)
    texts = [None, "", "   ", "one", "\n\n", base, base, base.replace(" ", "  "), base + " tail", words(rng, 60) + base, words(rng, 3000), "x" * 5000, "é ü ñ 你好 " * 300,
             "a<|endoftext|>b 's don't", " nbsp　wide", "tab\tnew\nline", words(rng, 300), base[:900] + words(rng, 30)]
    rows = [(i, t, "k", 1, 0.5, "r") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base, "k", 1, 0.5, "r"), (None, None, "k", 1, 0.5, "r")]


@pytest.fixture(scope="module")
def docs(frame):
    return frame(awkward(), DDL)


@pytest.fixture(scope="module")
def empty(frame):
    return frame([], DDL)


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ordered(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect()) if not any(r["id"] is None for r in df.select("id").collect()) else sorted(
        (tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def test_bpe(docs, empty, reference):
    got = bpe_codec.encode(docs, PATH, carry=("score",))
    want = []
    for i, t, *_ in awkward():
        ids = reference.encode(t or "", add_special_tokens=False).ids
        back = reference.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert ordered(got, "id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe_codec.encode(empty, PATH).count() == 0
    assert {r.text for r in bpe_codec.decode(got, PATH).collect()} == {t or "" for _, t, *_ in awkward()}


def test_bpe_joins():
    bpe, rng = byte_bpe.load(PATH), random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "the ", "  ", "\n", "'s", "1", "é", "!", "zz", "<|endoftext|>"]) for _ in range(60))
        data = text.encode()
        cuts = sorted({bpe_codec._character(data, rng.randint(0, len(data))) for _ in range(6)} | {0, len(data)})
        spans = list(zip(cuts, cuts[1:]))
        known = {s: bpe.encode(data[s[0] : s[1]].decode()) for s in rng.sample(spans, len(spans) // 2)}
        assert bpe_codec.encode_with(bpe, data, known).tolist() == bpe.encode(text).tolist()


def test_bpe_joins_take_linear_work():
    """Every byte is encoded a few times at most, with white space, without it, and without any sure place."""
    bpe, rng = byte_bpe.load(PATH), random.Random(16)
    for alphabet in ("hello world, this. ", "中文标点，测试文本。", "abcdefghij", "ไทยกขคงา"):
        text = "".join(rng.choice(alphabet) for _ in range(60_000))
        data, start, known, spent = text.encode(), 0, {}, []
        for end in bpe_codec.chunk_cuts(data):
            if end - start >= bpe_codec.SHORTEST:
                known[start, end] = bpe.encode(data[start:end].decode())
            start = end
        assert bpe_codec.encode_with(bpe, data, known, spent).tolist() == bpe.encode(text).tolist()
        assert len(known) > 5 and sum(spent) <= 3 * len(data)


def test_bpe_of_very_long_texts(frame, reference):
    rng = random.Random(17)
    texts = ["".join(rng.choice("中文标点，测试文本。") for _ in range(400_000)), words(rng, 250_000)]
    texts.append(texts[0][1000:] + texts[1][:5000])
    got = {r.id: r.token_ids for r in bpe_codec.encode(frame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    assert all(len(t.encode()) > 1_000_000 and got[i] == reference.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from digestflow.llm._shared import sliced

    texts = ["x" * n for n in (10, 500, 5000, 3, 3, 3, 900, 900)]
    parts = [b.column(0).to_pylist() for b in sliced([pa.RecordBatch.from_pydict({"t": texts})], rows=3, size=1000)]
    assert [t for p in parts for t in p] == texts and all(len(p) == 1 or len(p) <= 3 and sum(map(len, p)) <= 1000 for p in parts)


def test_chunks_are_shared():
    rng = random.Random(4)
    passage = words(rng, 2000).encode()
    one, other = (set() for _ in range(2))
    for chunks, data in ((one, b"front " + passage), (other, words(rng, 300).encode() + passage)):
        start = 0
        for end in bpe_codec.chunk_cuts(data):
            chunks.add(data[start:end])
            start = end
        assert start == len(data)
    assert len(one & other) > len(one) / 2


def test_token_counts(docs, empty, reference):
    got = token_counts.count_tokens(docs, PATH)
    want = [(i, len((t or "").encode()), len(reference.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in awkward()]
    assert ordered(got, "id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    assert token_counts.count_tokens(empty, PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_files(frame, name):
    path, texts = public_tokenizers.path(name), ["Hello there, world", "", None, "é ü  x"]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t or "")) for t in texts]
    else:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        want = [len(t.encode(x or "", add_special_tokens=False).ids) if x else 0 for x in texts]
    got = token_counts.count_tokens(frame(list(enumerate(texts)), "doc_id long, text string"), path)
    assert [r.n_tokens for r in got.orderBy("id").collect()] == want


@pytest.mark.parametrize("key_bits", [64, 3])
def test_exact_dedup(docs, empty, key_bits):
    """Three bits of hash make every text collide with others: chains must hold them apart."""
    got = exact_dedup.duplicate_groups(docs, capacity=4, key_bits=key_bits)
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in awkward():
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t, *_ in awkward():
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert ordered(got, "id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.duplicate_groups(empty).count() == 0
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[3]}


def test_exact_dedup_answers_from_its_index(frame):
    """Buckets split until they fit, a hot text is dealt to pages, and what a bucket's file lacks is missing from the answer."""
    rows = [(i, f"text {i % 120}") for i in range(240)] + [(1000 + i, "hot") for i in range(100)]
    entries, links = exact_dedup.build_index(frame(rows, "doc_id long, text string"), capacity=16)
    held = Counter(r.bucket for r in entries.collect())
    hot = next(r.bucket for r in entries.collect() if r.id == 1000)
    assert len(held) > 12 and all(n <= 16 for b, n in held.items() if b != hot) and held[hot] >= 100
    assert {(r.keep_id, r.group_size) for r in exact_dedup.looked_up(entries, links).collect()} == {(i, 2) for i in range(120)} | {(1000, 100)}
    damaged = links.where(links.bucket != hot)
    assert exact_dedup.looked_up(entries, damaged).count() == len(rows) - held[hot]


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 1])
def test_suffix_dedup(docs, empty, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = suffix_dedup.remove_repeats(docs)
    want = [(i, *b) for (i, *_), b in zip(awkward(), brute_repeats([t for _, t, *_ in awkward()], 200))]
    assert ordered(got, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_anchors_of_long_texts(frame, monkeypatch):
    rng = random.Random(18)
    data = bytes(rng.choice(b"abc ") for _ in range(9000))
    whole = suffix_dedup.anchors(data, 200, 40)
    with monkeypatch.context() as m:
        m.setattr(suffix_dedup, "PART", 1000)
        parts = suffix_dedup.anchors(data, 200, 40)
    # a part may cut an anchor's run of windows in two; the windows and their anchors are the same
    spread = lambda a: sorted((w, at) for _, at, first, last in zip(*map(np.ndarray.tolist, a)) for w in range(first, last + 1))
    assert spread(whole) == spread(parts)
    passage = "".join(rng.choice("defgh ") for _ in range(700))
    long = "".join(rng.choice("abc ") for _ in range(suffix_dedup.PART + 5000))
    texts = [long[:-300] + passage + long[-300:], "x" * 10 + passage + "y" * 10]
    got = {r.id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (700, 1), 1: (700, 1)}


def test_deep_shallow_sort():
    rng = random.Random(5)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 40))]
        strings += [b"a" * 25 + s for s in strings]
        order, lcp = suffix_dedup.deep_shallow_sort(strings)
        found = [strings[i] for i in order]
        assert found == sorted(strings) and sorted(order.tolist()) == list(range(len(strings)))
        for a, b, n in zip(found, found[1:], lcp[1:].tolist()):
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def near_copies():
    rng = random.Random(6)
    rows, texts = [], []
    for _ in range(30):
        texts.append(words(rng, 200).split())
    for t in list(texts)[:12]:
        for _ in range(6):
            copy = list(t)
            for _ in range(rng.randint(1, 8)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            texts.append(copy)
    rows = [" ".join(t) for t in texts] + [" ".join(texts[0]), None, "", "a b", "a  b", "c"]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1024, 3])
def test_jaccard_join(frame, limit, monkeypatch):
    """A limit of 3 makes buckets split, and blocks meet in pairs."""
    for name in ("LIMIT", "SIDE", "BLOCK"):
        monkeypatch.setattr(jaccard_join, name, limit)
    texts = near_copies()
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())((t or "").split()) for t in texts]
    links = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    least = list(range(len(texts)))
    for _ in texts:
        for i, near in enumerate(links):
            least[i] = min([least[i], *(least[j] for j in near)])
    got = jaccard_join.join(frame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, path string"))
    assert {(r.id, r.class_id, r.n_links) for r in got.collect()} == {(i, least[i], len(links[i])) for i in range(len(texts))}


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_jaccard_recall_where_all_buckets_split(frame, monkeypatch, broadcast):
    """Pairs exactly at 0.8, of unequal size (the worst case), reach the recall asked for though every bucket splits to the last level."""
    monkeypatch.setattr(jaccard_join, "LIMIT", 1)
    monkeypatch.setattr(jaccard_join, "WORTH", 9)
    monkeypatch.setattr(jaccard_join, "BROADCAST", broadcast)
    rng = random.Random(14)
    texts = [t for _ in range(300) for w in [words(rng, 104).split()] for t in (" ".join(w), " ".join(w[:84]))]
    got = jaccard_join.join(frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), recall=0.99)
    assert got.where("n_links = 1").count() / len(texts) >= 0.985


def test_near_duplicates_go_by_row(frame):
    """Another row with a near copy's id stays, one of fully equal rows stays, and null ids come last."""
    rng = random.Random(15)
    base, other = words(rng, 100), words(rng, 100)
    rows = [(5, base, "a"), (7, base + " tail", "b"), (7, other, "c"), (9, "short one", "d"), (9, "short one", "e"), (None, base + " end", "f"), (None, None, "g"), (None, None, "h")]
    kept = jaccard_join.drop_near_duplicates(frame(rows, "doc_id long, text string, rec string"))
    assert kept.columns == ["doc_id", "text", "rec"]
    assert sorted(r.rec for r in kept.collect() if r.rec not in "de") == ["a", "c", "g", "h"]
    assert sum(r.rec in "de" for r in kept.collect()) == 1


def test_jaccard_join_of_awkward_rows(docs, empty):
    got = jaccard_join.join(docs).collect()
    assert Counter(r.id for r in got) == Counter(i for i, *_ in awkward())
    base = {r.class_id for r in got if r.id in (5, 6, 7)}
    assert base == {5} and all(r.n_links == 0 for r in got if r.id in (0, 1, 2, 10))
    assert jaccard_join.join(empty).count() == 0


def test_mixing(docs, empty, frame):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(0, 200)), s) for i, s in enumerate(["a"] * 60 + ["b"] * 30 + ["c"] * 10 + [None] * 40 + ["d"])]
    rows += [rows[3], (None, "x y", "a"), (7, "other text", "b"), (200, None, "a")]
    table = frame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(table, weights=(5, 2, 1), block=16)
    got = mix.taken().collect()
    assert Counter(r.id for r in got) == Counter(r[0] for r in rows)
    sizes, takes, target = Counter(), Counter(), {}
    for r in got:
        assert r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        takes[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    assert all(target[s] <= 3 * sizes[s] + 1e-9 and abs(takes[s] - target[s]) <= 16 for s in sizes)
    assert sorted(map(repr, mixing.Mix(table, weights=(5, 2, 1), block=16).taken().collect())) == sorted(map(repr, got))
    mixed = mix.mixed()
    assert mixed.columns == table.columns
    out = Counter()
    for r in mixed.collect():
        out[r.source] += len((r.text or "").split())
    assert out == +takes
    assert mixing.Mix(empty.withColumnRenamed("key", "source")).taken().count() == 0


def test_mixing_takes_blocks_by_permuted_index(frame):
    """taken against a second reckoning: the stream's order, its blocks, quotas, shards and permutations."""
    from pyspark.sql import functions as F

    rng = random.Random(19)
    rows = [(i, words(rng, rng.randint(0, 90)), "ab"[i % 3 // 2]) for i in range(300)]
    table = frame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(table, weights=(5, 2), block=16, seed=3)
    hashes = {r.doc_id: r.h for r in table.select("doc_id", F.xxhash64("doc_id", F.lit(3)).alias("h")).collect()}
    sizes = {i: len(t.split()) for i, t, _ in rows}
    sources = {s: [i for i, _, t in rows if t == s] for s in "ab"}
    totals = [sum(sizes[i] for i in sources[s]) for s in "ab"]
    targets, blocks = mixing.share_out(totals, [5, 2]), [-(-n // 16) for n in totals]
    quotas = [round(t / n * b) for t, n, b in zip(targets, totals, blocks)]
    want = Counter()
    for k, s in enumerate("ab"):
        times = Counter(int(mixing.permuted(np.array([r % blocks[k]]), blocks[k], (3 * 1_000_003 + k) * 64 + r // blocks[k])[0]) for r in range(quotas[k]))
        at = 0
        for i in sorted(sources[s], key=lambda i: (hashes[i] % mix.buckets, hashes[i], i)):
            want[i] += sum(times[w // 16] for w in range(at, at + sizes[i]))
            at += sizes[i]
    assert {r.id: r.taken for r in mix.taken().collect()} == {i: want[i] for i in sizes}


def test_share_out():
    assert mixing.share_out([100, 100], [1, 1]) == [100, 100]
    assert mixing.share_out([10, 1000, 0], [5, 2, 1]) == pytest.approx([30, 980, 0])
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    counts = mixing.draw_shards(np.array([100, 7, 0, 1000]), 13, 1)
    assert counts.sum(0).tolist() == [100, 7, 0, 1000] and (counts >= 0).all()


def test_language_id(frame, empty):
    rng = random.Random(9)
    letters = {"xx": "abcde ", "yy": "vwxyz ", "zz": "abvwé "}
    rows = [(i, "".join(rng.choice(letters[lang]) for _ in range(rng.randint(20, 300))), lang) for i in range(240) for lang in [rng.choice(list(letters))]]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !", None), (1003, "abcde", None), (1003, "abcde", None)]
    table = frame(rows, "doc_id long, text string, lang string")
    got = {r.id: r for r in language_id.identify(table).collect()}
    assert len(got) == 244 and all(0 <= r.score <= 1 for r in got.values())
    held = [(i, lang) for i, t, lang in rows if got[i].held_out and lang and t]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "xx"
    assert language_id.identify(empty.withColumnRenamed("key", "lang")).count() == 0
    assert language_id.keep_known(table).columns == table.columns


def test_code_lengths_against_brute_force():
    rng = random.Random(10)
    texts = {lang: [bytes(rng.choice(alphabet) for _ in range(200)) for _ in range(3)] for lang, alphabet in (("a", b"abc"), ("b", b"bcd"))}
    counts, tables = {}, {}
    for lang, own in texts.items():
        grams = np.concatenate([language_id.grams(np.frombuffer(language_id.PAD + t, np.uint8)) for t in own])
        keys, n = np.unique(grams, return_counts=True)
        counts[lang] = (keys, n.astype(float))
        table = {}
        for t in own:
            padded = language_id.PAD + t
            for i in range(3, len(padded)):
                for order in range(4):
                    table.setdefault(padded[i - order : i], Counter())[padded[i]] += 1
        tables[lang] = table
    model = language_id.Model.fit(counts)

    def bits(table, text):
        total, padded = 0.0, language_id.PAD + text
        for i in range(3, len(padded)):
            for order in (3, 2, 1, 0, -1):
                if order < 0:
                    total += 8
                    break
                seen = table.get(padded[i - order : i])
                if seen:
                    t, d = sum(seen.values()), len(seen)
                    if padded[i] in seen:
                        total -= np.log2(seen[padded[i]] / (t + d))
                        break
                    total -= np.log2(d / (t + d))
        return total

    asked = [b"abcabc", b"xyz", b"", bytes(rng.choice(b"abcdx") for _ in range(500)), bytes(rng.choice(b"abcd") for _ in range(language_id.PART + 1000))]
    want = [[bits(tables[lang], t) for lang in model.languages] for t in asked]
    assert np.allclose(model.code_lengths(asked), want, rtol=1e-4)


def test_fingerprints(frame, empty):
    rng = random.Random(11)
    texts = [words(rng, 300), words(rng, 300), None, "", "one two", "é" * 40 + " x", words(rng, 1000)]
    texts.append(texts[0])
    rows = [(i * 7, t, 1, 2) for i, t in enumerate(texts)]
    got = fingerprints.compare_edited(frame(rows, "doc_id long, text string, range int, part int")).orderBy("id").collect()
    for i, r in enumerate(got):
        own, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(own) // 2
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[0].fingerprint == got[7].fingerprint and got[7].near_next == 1 and got[0].near_next == 0 and got[0].near_edited > 0.2
    assert got[2].near_edited == 1 and got[2].fingerprint == ""
    assert fingerprints.compare_edited(empty).count() == 0
    assert len(fingerprints.compare_edited(frame([(1, "a b", 0, 0), (1, "a b", 0, 0), (None, "c", 0, 0)], "doc_id long, text string, range int, part int")).collect()) == 3


def spark_hash(*values, seed=42):
    import xxhash

    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), seed)
        seed -= (seed >= 2**63) << 64
    return seed


def brute_syncmers(text, k=8, s=2):
    letters = re.findall(r"[^\x20\x09-\x0D\u3040-\u30FF\u3400-\u9FFF]+|[\u3040-\u30FF\u3400-\u9FFF]", text or "")
    h = [spark_hash(w) for w in letters]
    if len(h) < k:
        return {spark_hash(*h): 0} if h else {}
    runs = [spark_hash(*h[i : i + k]) for i in range(len(h) - k + 1)]
    inner = [spark_hash(*h[i : i + s]) for i in range(len(h) - s + 1)]
    chosen = [i for i in range(len(runs)) if min(inner[i], inner[i + k - s]) <= min(inner[i + 1 : i + k - s])]
    out = {}
    for i in chosen or [min(range(len(runs)), key=lambda i: (runs[i], i))]:
        out.setdefault(runs[i], i)
    return out


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    met = [(p, b[x] - p) for x, p in sorted(a.items(), key=lambda e: e[1]) if x in b]
    m = sum(any(0 <= j < len(met) and met[j][1] == met[i][1] for j in (i - 1, i + 1)) for i in range(len(met))) if len(met) > 1 else len(met)
    return m / (len(a) + len(b) - m)


def test_fingerprints_against_brute_force(frame):
    rng = random.Random(20)
    base = words(rng, 120).split()
    texts = [" ".join(base), " ".join(base[60:] + base[:60]), " ".join(base[:50] + ["new"] + base[50:]), "中文没有空格的一段文字" * 4, "a b c", "", words(rng, 9), "the same line\n" * 30, words(rng, 10_000)]
    got = fingerprints.compare_edited(frame(list(enumerate(texts)), "doc_id long, text string")).orderBy("id").collect()
    for i, r in enumerate(got):
        after = texts[(i + 1) % len(texts)]
        half = len(texts[i]) // 2
        own, other, changed = map(brute_syncmers, (texts[i], after, texts[i][: len(texts[i]) - half] + after[:half]))
        assert r.fingerprint == "".join(f"{x % 2**64:016x}{p:08x}" for p, x in sorted((p, x) for x, p in own.items()))
        assert r.near_edited == pytest.approx(brute_likeness(own, changed)) and r.near_next == pytest.approx(brute_likeness(own, other))
    # moved passages count, wherever they went
    assert got[0].near_next > 0.7 and got[1].near_next > 0.5


def test_syncmers_are_context_free(frame, spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    for middle, noise in ((words(rng, 100), words(rng, 13)), ("没有空格的文字里插入一个字也不会移动其余的锚点因为选择只看自身", "别的字")):
        rows = frame([(0, middle), (1, noise + " " + middle + " " + noise)], "doc_id long, text string")
        a, b = ({x.anchor: x.place for x in r[0]} for r in rows.orderBy("doc_id").select(fingerprints.syncmers(F.col("text"))).collect())
        assert a and len({b[x] - p for x, p in a.items()}) == 1


def test_short_texts_have_anchors(frame):
    """Of 8 to 12 words, where often no run is chosen."""
    from pyspark.sql import functions as F

    rng = random.Random(13)
    texts = [words(rng, n) for n in range(1, 17) for _ in range(12)]
    got = frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", fingerprints.syncmers(F.col("text")).alias("x"))
    assert all(got.select(F.size("x") > 0).toPandas().iloc[:, 0])
    pairs = got.join(got.toDF("b", "y"), F.expr("doc_id >= 12 * 7 AND b > doc_id")).agg(F.max(fingerprints.likeness(F.col("x"), F.col("y"))))
    assert pairs.first()[0] == 0
