"""Each operator against a brute-force version on a small fixture with every edge case, and on the test tables where that is quick."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarnvol.llm import bpe_fst, exact, lines, minhash, packing, quality, sharding, substrings, token_index

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, block int, key string, n_chars long"


def _texts():
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdéñ") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, long_one = say(60), say(6000)
    near = say(150).split()
    out = [say(rnd.randint(5, 120)) for _ in range(20)]
    out += [f"{say(20)}\n{passage} {say(9)}", f"{say(3)} {passage}", passage, long_one, long_one + " tail", out[0], out[0].replace(" ", "\n", 3)]
    for _ in range(6):
        copy = list(near)
        copy[rnd.randrange(150)] = "changed" + rnd.choice(vocabulary)
        out.append(" ".join(copy))
    out += ["", None, "   ", "one", "two words", "a b c " * 40, "#x* $y% " * 30, "   lead  and \t trail \n", "<|endoftext|> 中文 \x1c x 😀é́"]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    ids = list(range(3, 3 + 2 * len(texts), 2))
    random.Random(1).shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "k", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, a repeated row, a repeated doc_id with another text."""
    text = " ".join(f"w{i}" for i in range(80))
    return spark.createDataFrame([(None, text, None, None, None, None), (None, None, None, None, None, None), (1, text, "en", 1, "k", 5), (1, text, "en", 1, "k", 5), (1, "other", None, 1, "k", 5), (2, None, None, None, None, None)], SCHEMA)


def test_token_index(spark, docs, rows, monkeypatch):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(file)
    monkeypatch.setattr(token_index, "documents", lambda s, d: docs)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_index.op1_token_index(spark, "").collect()}
    want, at = {}, 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


@pytest.mark.parametrize("direct", [True, False])
def test_token_index_odd_rows_absent_keys_and_both_readers(spark, odd, empty, monkeypatch, direct):
    if not direct:
        monkeypatch.setattr(token_index, "_direct", lambda path: None)
    monkeypatch.setattr(token_index, "documents", lambda s, d: odd)
    got = token_index.op1_token_index(spark, "").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "1", "2", "None", "None"]
    assert sorted(r["start"] for r in got)[0] == 0 and len({r["start"] for r in got}) == 6
    shards = token_index.write_shards(odd)
    index, n = token_index.build_index(token_index.directory(spark, shards))
    keys = spark.createDataFrame([(k,) for k in (1, 2, 5, -9)], "doc_id long")
    assert sorted(r["doc_id"] for r in token_index.look_up(keys, index, n).collect()) == [1, 2]
    monkeypatch.setattr(token_index, "documents", lambda s, d: empty)
    assert token_index.op1_token_index(spark, "").count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(-(1 << 60), 1 << 60, 5000)
    keys = np.unique(keys)
    levels, slots = token_index.build_levels(keys)
    assert sorted(slots) == list(range(len(keys))) and np.array_equal(token_index.find_slots(keys, levels), slots)


def _greedy(sizes, capacity):
    runs, used = 1, 0
    for x in sizes:
        if used + x > capacity:
            runs, used = runs + 1, 0
        used += x
    return runs


def test_minimax_cuts():
    rnd = random.Random(2)
    for _ in range(150):
        sizes = [rnd.choice([rnd.randint(1, 20), rnd.randint(1, 400)]) for _ in range(rnd.randint(1, 200))]
        shards = rnd.randint(1, 9)
        cells = lambda a, b, step: [(i, min(step, b - i), sum(sizes[i : min(i + step, b)])) for i in range(a, b, step)]  # noqa: B023,E731
        capacity, cuts = sharding.minimax_cuts(cells(0, len(sizes), 17), max(sizes), shards, lambda cs: {c: cells(c[0], c[0] + c[1], -(-c[1] // 4)) for c in cs})  # noqa: B023
        best = next(c for c in range(max(sizes), sum(sizes) + 1) if _greedy(sizes, c) <= shards)
        assert capacity == best and len(cuts) <= shards


def test_shards(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in sharding.shard(docs, 7).collect()}
    texts = {}
    for i, t in rows:
        assert got[i]["size"] == len((t or "").encode()) + 16 and got[i]["text_crc32"] == zlib.crc32((t or "").encode()) and got[i]["grown_shard"] is None
        texts.setdefault(t or "", set()).add(got[i]["shard"])
    assert all(len(s) == 1 for s in texts.values())
    per = defaultdict(list)
    for r in got.values():
        per[r["shard"]].append(r["slot"])
    assert set(per) <= set(range(7)) and all(sorted(s) == list(range(len(s))) for s in per.values())
    groups = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 16
    load = Counter()
    for r in got.values():
        load[r["shard"]] += r["size"]
    sizes = list(groups.values())
    assert max(load.values()) == next(c for c in range(max(sizes), sum(sizes) + 1) if _greedy(sizes, c) <= 7)
    assert sharding.shard(odd, 3).count() == 6 and sharding.shard(empty, 3).count() == 0


def brute_words(rows, length):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + length]) for _, w in words for k in range(len(w) - length + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def brute_bytes(rows, length):
    last = 1 << 62
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            first[s] = min(first.get(s, last), last if i is None else i)
    out = []
    for i, t in rows:
        data, own = (t or "").encode(), last if i is None else i
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < own:
                gone[k : k + length] = b"\1" * length
        out.append((i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def _order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("group", [4096, 1])
def test_substrings(docs, rows, odd, empty, monkeypatch, group):
    from tarnvol.llm import windows

    monkeypatch.setattr(windows, "GROUP", group)
    got = [(r[0], r[1], r[2], bytes(r[3]).decode()) for r in substrings.drop_repeated_words(docs).collect()]
    assert _order(got) == _order(brute_words(rows, 35)) and sum(r[2] for r in got) > 100
    some = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert _order((r[0], r[1], r[2], bytes(r[3]).decode()) for r in substrings.drop_repeated_words(odd).collect()) == _order(brute_words(some, 35))
    assert substrings.drop_repeated_words(empty).count() == 0


def test_bytes(docs, rows, odd, empty):
    assert _order(tuple(map(_b, r)) for r in substrings.drop_earlier_bytes(docs).collect()) == _order(brute_bytes(rows, 50))
    some = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert _order(tuple(map(_b, r)) for r in substrings.drop_earlier_bytes(odd).collect()) == _order(brute_bytes(some, 50))
    assert substrings.drop_earlier_bytes(empty).count() == 0


def _b(x):
    return bytes(x) if isinstance(x, bytearray) else x


def test_intervals_are_the_maximal_repeats():
    from tarnvol.llm.windows import deep_intervals, suffix_array

    text = "banana$bandana#cabana"
    symbols = np.frombuffer(text.encode(), np.uint8)
    n = len(text)
    rank, common = suffix_array(symbols, np.full(n, n), n)
    sa = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common(sa[:-1], sa[1:])
    assert [text[i:] for i in sa] == sorted(text[i:] for i in range(n))
    left = np.where(sa > 0, symbols[sa - 1].astype(np.int64), -1)
    got = {(text[sa[a] : sa[a] + d], b - a + 1) for a, b, d, _, maximal in deep_intervals(lcp, 2, left) if maximal}
    want = set()
    for i in range(n):
        for j in range(i + 2, n + 1):
            s = text[i:j]
            at = [k for k in range(n) if text.startswith(s, k)]
            if len(at) > 1 and len({text[k - 1 : k] for k in at}) > 1 and len({text[k + len(s) : k + len(s) + 1] for k in at}) > 1:
                want.add((s, len(at)))
    assert got == want


def test_exact(docs, rows, odd, empty):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r["doc_id"]: tuple(r)[1:] for r in exact.exact_dedup(docs).collect()}
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    assert {r["doc_id"] for r in exact.drop_exact(docs).collect()} == {min(g) for g in groups.values()}
    assert exact.exact_dedup(odd).where("doc_id is null and kept").count() == 0 and exact.exact_dedup(odd).count() == 6
    assert exact.exact_dedup(empty).count() == 0 and exact.drop_exact(docs).columns == docs.columns


def brute_statistics(text):
    t = text or ""
    w = WORD.findall(t)
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    gone = [0] * len(w)
    for k in range(len(w) - 2):
        if triples[w[k], w[k + 1], w[k + 2]] > 1:
            gone[k : k + 3] = [1] * 3
    found = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(found) - len(set(found)), sum(gone)


def test_quality(spark, docs, rows, odd, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows[:9]] + [(None, 0, 0), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    out, rules = quality.quality_rules(docs, labels)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in rows:
        want = brute_statistics(t)
        assert tuple(got[i][c] for c in quality.BASE) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and got[i]["kept"] == (not got[i]["base_failed"])
    assert rules == []
    assert quality.quality_rules(odd, labels)[0].count() == 6 and quality.quality_rules(empty, labels)[0].count() == 0


def test_decision_list_is_learned_and_holds_out(spark):
    rnd = random.Random(3)
    clean = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 999)) for _ in range(80))) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "%%" if k % 2 else w for k, w in enumerate(t.split()))) for i, t in clean[:120]]
    rows = clean + junk
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows if i % 2], "doc_id long, quality int")
    out, rules = quality.quality_rules(docs, labels)
    held = [(r["doc_id"] < 1000, r["kept"]) for r in out.where("doc_id % 2 = 0").collect()]
    assert rules and sum(a == k for a, k in held) / len(held) > 0.98
    assert {r["doc_id"] for r in quality.drop_low_quality(docs, labels).collect()} == {r["doc_id"] for r in out.where("kept").collect()}


def test_bpe(docs, rows, odd, empty):
    import tiktoken

    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_fst.load_ranks(file), special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe_fst.encode_decode(docs).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe_fst.encode_decode(odd).count() == 6 and bpe_fst.encode_decode(empty).count() == 0


def test_transducer_against_merging_on_toy_vocabularies():
    rnd = random.Random(4)
    for _ in range(30):
        ranks = {bytes([b]): b for b in b"abc"}
        while len(ranks) < 25:
            a, b = rnd.choice(list(ranks)), rnd.choice(list(ranks))
            if a + b not in ranks and bpe_fst.merge_by_rank(a + b, ranks) == [a, b]:
                ranks[a + b] = 300 + len(ranks)
        machine = bpe_fst.BpeTransducer(ranks)
        for _ in range(200):
            s = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 14)))
            want = [ranks[s]] if s in ranks else [ranks[p] for p in bpe_fst.merge_by_rank(s, ranks)]
            assert machine.encode_piece(s) == want


def test_streaming_decoder_in_any_portions():
    data = "aé中😀".encode() + b"\xff\xe2\x82" + "z😀".encode() + b"\xf0\x9f"
    tokens = {i: bytes([i]) for i in range(256)}
    for size in (1, 2, 3, 5, 50):
        d = bpe_fst.StreamingDecoder(tokens)
        assert "".join(d.feed(data[k : k + size]) for k in range(0, len(data), size)) + d.finish() == data.decode("utf-8", "replace")


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rnd = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) for _ in range(2))
        k = rnd.randint(0, 3)
        assert lines.within(a, b, k) == (_edits(a, b) <= k)


def test_lines(spark, odd, empty):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(5, 14))) for _ in range(40)]

    def changed(x):
        x = list(x)
        for _ in range(rnd.randint(0, 3)):
            at, how = rnd.randint(0, len(x)), rnd.random()
            x[at : at + (how < 0.6)] = [] if how < 0.3 else [rnd.choice("abcé")]
        return "".join(x)

    rows = [(i, "\n".join(changed(rnd.choice(base)) for _ in range(rnd.randint(0, 6)))) for i in range(80)] + [(200, None)]
    places = [(d, k, x) for d, t in rows for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    kinds = sorted({x for *_, x in places})
    links, parent = Counter(), {x: x for x in kinds}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if min(len(a), len(b)) >= 6 and _edits(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    first, group = {}, {}
    for d, k, x in places:
        first[x] = min(first.get(x, (999, 0)), (d, k))
        group[root(x)] = min(group.get(root(x), (999, 0)), (d, k))
    want = {(d, k): (*first[x], links[x], *group[root(x)], (d, k) == group[root(x)]) for d, k, x in places}
    out = lines.near_lines(spark.createDataFrame(rows, "doc_id long, text string"), 2, 6)
    got = {(r["doc_id"], r["line"]): (r["class_doc_id"], r["class_line"], r["n_links"], r["group_doc_id"], r["group_line"], r["kept"]) for r in out.collect()}
    assert got == want
    assert lines.near_lines(odd).count() == 4 and lines.near_lines(empty).count() == 0


def brute_near(rows, words, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near(docs, rows, words, percent):
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_components(docs, words, percent).collect()}
    want = brute_near(rows, words, percent)
    assert got == want and len({v[1] for v in want.values()}) < len(want)


def test_near_in_chunks_and_bucket_by_bucket(docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 2)
    monkeypatch.setattr(minhash, "MARGIN", -1)  # nothing is linked in round 1
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_components(docs, 5, 80).collect()}
    assert got == brute_near(rows, 5, 80)


def _twins():
    """Two strings whose difference every polynomial hash modulo a power of two takes for nothing."""
    p = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    return p, p.translate(str.maketrans("ab", "ba"))


def test_texts_that_cancel_in_linear_hashes(spark):
    p, q = _twins()
    docs = spark.createDataFrame([(1, p), (2, q)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_components(docs).collect()} == {(1, 1), (2, 2)}
    assert [(r["copies"], r["kept"], r["n_links"]) for r in lines.near_lines(docs).collect()] == [(1, True, 0)] * 2
    around = " ".join(f"q{i}" for i in range(34))
    for at in (0, 17, 34):
        for x, y in (("hcgcfedbg", "beccbfeij"), (p, q)):
            rows = [(i, " ".join([*around.split()[:at], w, *around.split()[at:]])) for i, w in ((1, x), (2, y))]
            got = substrings.drop_repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert [r["n_removed"] for r in got] == [0, 0]
    rows = [(1, p), (2, q), (3, p + q)]
    got = substrings.drop_earlier_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert _order(tuple(map(_b, r)) for r in got) == _order(brute_bytes(rows, 50))


def test_hashes_of_runs_differ_where_runs_do():
    from tarnvol.llm.windows import hash_bytes, hash_units

    rnd = np.random.default_rng(0)
    data = rnd.integers(0, 3, 4000, dtype=np.uint8)
    at, size = rnd.integers(0, 3000, 5000), rnd.choice([0, 1, 7, 8, 9, 16, 40, 511, 512, 513, 900], 5000)
    runs = [data[a : a + s].tobytes() for a, s in zip(at, size, strict=True)]
    for fold, x in ((hash_bytes, data), (hash_units, data.astype(np.uint64))):
        for seed in (0, 1):
            got = fold(x, at, size, seed).tolist()
            assert len(set(zip(runs, got, strict=True))) == len(set(runs)) == len(set(got))


def test_hot_and_missing_ids(spark, monkeypatch):
    """Half of the rows equal, half of the ids missing."""
    rnd = random.Random(11)
    say = lambda n: " ".join(f"w{rnd.randint(0, 300)}" for _ in range(n))
    same = say(90)
    rows = [(None if i % 2 else i, same if i % 4 < 2 else say(60) + "\n" + say(9)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    last = 1 << 62
    firsts = {}
    for i, t in rows:
        firsts[t] = min(firsts.get(t, last), last if i is None else i)
    got = exact.exact_dedup(docs).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"])) for r in got) == sorted(str((i, None if firsts[t] == last else firsts[t], sum(u == t for _, u in rows))) for i, t in rows)
    left = exact.drop_exact(docs).collect()
    assert sorted(map(str, left)) == sorted(str(r) for r in docs.collect() if (r["doc_id"] is None and firsts[r["text"]] == last) or r["doc_id"] == firsts[r["text"]])
    near = minhash.near_components(docs).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in near) == sorted(str((i, None if firsts[t] == last else firsts[t])) for i, t in rows)
    told = lines.near_lines(docs).collect()
    assert len(told) == sum(t.count("\n") + 1 for _, t in rows) and max(r["copies"] for r in told) == 120
    put = sharding.shard(docs, 5).collect()
    per = defaultdict(list)
    for r in put:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in per.values()) and len(put) == 240
    got = substrings.drop_repeated_words(docs).collect()
    assert _order((r[0], r[1], r[2], bytes(r[3]).decode()) for r in got) == _order(brute_words(rows, 35))
    got = substrings.drop_earlier_bytes(docs).collect()
    assert _order(tuple(map(_b, r)) for r in got) == _order(brute_bytes(rows, 50))
    monkeypatch.setattr(token_index, "documents", lambda s, d: docs)
    monkeypatch.setattr(token_index, "SHARD_BYTES", 2000)
    write = token_index.write_shards
    monkeypatch.setattr(token_index, "write_shards", lambda d: write(d, shard_bytes=2000))
    got = sorted((r["start"], r["n_tokens"]) for r in token_index.op1_token_index(spark, "").collect())
    assert len(got) == 240 and got[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))


def test_near_odd_rows(odd, empty):
    got = minhash.near_components(odd).collect()
    assert len(got) == 6 and {r["component_id"] for r in got if r["n_shingles"] == 78} == {1}
    assert minhash.near_components(empty).count() == 0
    assert minhash.drop_near(odd, 3, 85).count() == 6


def _best_fit(lengths, capacity):
    left = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(left) if r >= x]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= x
        else:
            left.append(capacity - x)
    return len(left)


def test_packing_of_classes_equals_one_by_one():
    rnd = random.Random(8)
    for _ in range(100):
        capacity = rnd.choice([5, 10, 37, 100])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 150))]
        bins, seen = defaultdict(list), Counter()
        for size, rank, members, first, each, offset in packing.pack_classes(Counter(lengths), capacity):
            for k in range(members):
                bins[first + k // each].append((offset + size * (k % each), size))
                seen[size, rank + k] += 1
        assert set(seen.values()) <= {1} and len(seen) == len(lengths) and len(bins) == _best_fit(lengths, capacity)
        for items in bins.values():
            at = 0
            for offset, size in sorted(items):
                assert offset == at
                at += size
            assert at <= capacity


def test_packing(docs, rows, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(packing.cut(docs)).collect()
    want = {}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[i, k] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert len({r["sequence_id"] for r in got}) == _best_fit([v[1] for v in want.values()], 2048)
    assert packing.pack(packing.cut(odd)).count() == 6 and packing.pack(packing.cut(empty)).count() == 0
