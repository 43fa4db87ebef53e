"""Operators for training data against brute force, exact round trips and held-out labels, on planted and awkward rows."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import ann, fingerprints, licenses, lmscore, mixing, packing, quality, queries, sharding, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(4)
WORDS = ["the", "of", "shore", "Zweck", "ére", "tion", "anea", "kg", "über", "mast", "reed", "tin", "plan", "ash", "Oak", "fern"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@functools.cache
def awkward():
    """Nulls, empty and blank texts, copies, near copies, one very long text, repeated rows."""
    base = [prose(80) for _ in range(12)]
    texts = [*base, base[0], base[0], base[1] + " end", None, "", " \t\n", "one", "two words", prose(30000), "A" * 5000, "the the the the", "x\x1fy z"]
    rows = [(n * 3 + 1, t, "en", f"src{n % 3}" if n % 5 else None, len(t or "")) for n, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The table with columns that are named as things inside the operators."""
    for c in ("fp", "node", "block", "vslot", "_row", "blocks", "mix_epoch", "quality_score", "bucket", "shard", "guest", "ids"):
        df = df.withColumn(c, F.lit("x"))
    return df


# --- SimHash


def slow_simhash(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(fps):
    """{key: smallest key reachable} over keys with fingerprints, by comparing all pairs."""
    keys, parent = list(fps), {k: k for k in fps}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def named_classes(rows):
    """(doc_id, fp, smallest doc_id reachable or None) of rows (doc_id, fp), links going through rows of any id."""
    root = slow_classes({n: fp for n, (_, fp) in enumerate(rows)})
    names = {}
    for n, (d, _) in enumerate(rows):
        names[root[n]] = min((x for x in (names.get(root[n]), d) if x is not None), default=None)
    return Counter((d, fp, names[root[n]]) for n, (d, fp) in enumerate(rows))


def test_simhash_on_awkward_rows(docs):
    got = simhash.near_duplicates(clashing(docs)).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == named_classes([(d, slow_simhash(t)) for d, t, *_ in awkward()])


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    rows = [(1, 0), (None, 7), (9, 63), (None, 1 << 40 | 0xFFF0000000), (20, 0xFF << 50), (20, 0x1FF << 50), (30, 0x7FF << 50)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size: docs)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long").repartition(3)).collect()
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in got) == named_classes(rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 9) or r["fp"] == 7} == {1}


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_links_span_planted_families(spark, block):
    """Families around centres, chains, and noise; with small blocks most cells are split."""
    rng, fps = random.Random(9), []
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    for _ in range(30):
        c = rng.getrandbits(64)
        fps += [c, *(flip(c, rng.randint(1, 5)) for _ in range(rng.randint(1, 12)))]
    x = rng.getrandbits(64)
    for _ in range(40):
        fps.append(x := flip(x, 3))
    fps += [rng.getrandbits(64) for _ in range(300)]
    fps = dict(enumerate(dict.fromkeys(fps)))
    rows = [(simhash._signed(f), n) for n, f in fps.items()]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, node long").repartition(5), block)
    from tallyspark.llm.common import components

    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {n: got.get(n, n) for n in fps} == slow_classes(fps)
    assert all((fps[r["a"]] ^ fps[r["b"]]).bit_count() <= 3 for r in edges.collect())


def test_manhattan_is_a_lower_bound():
    a, b = np.random.default_rng(1).integers(0, 2**63, (2, 500), dtype=np.uint64)
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) <= np.bitwise_count(a ^ b)).all()
    counts = lambda x: np.array([[(int(v) >> k & 3).bit_count() for k in range(0, 64, 2)] for v in x])
    assert (np.abs(counts(a) - counts(b)).sum(axis=1) == np.bitwise_count(simhash.embed(a) ^ simhash.embed(b))).all()


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def likeness(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def check_near_copies(got, texts, least):
    """got: {id: class}. No class without links of 0.8 or more that hold it together; nearly all such links within classes."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids, parent = sorted(texts), {i: i for i in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    found = total = 0
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (texts[a] or "") == (texts[b] or "") or likeness(sets[a], sets[b]) >= 0.8:
                total += 1
                found += got[a] == got[b]
                if got[a] == got[b]:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: root(i) for i in ids} == got
    assert found >= least * total


def test_near_copies_like_brute_force(spark, docs, none):
    rng, rows = random.Random(7), [(d, t) for d, t, *_ in awkward() if d is not None and d != 10]
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    at = 10_000
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        for edits in (0, 0, 1, 2, 4, 30):
            w = list(base)
            for k in rng.sample(range(len(w)), edits):
                w[k] = rng.choice(vocabulary)
            rows.append((at := at + 1, " ".join(w)))
    texts = dict(rows)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    rows = simhash.near_copies(df).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    check_near_copies(got, texts, 0.93)
    assert {r["doc_id"] for r in rows if r["kept"]} == set(got.values())
    awk = simhash.near_copies(docs).collect()
    assert len(awk) == len(awkward()) and simhash.near_copies(none).count() == 0
    assert {r["component_id"] for r in awk if r["doc_id"] is None} == {None}


# --- packing


def test_near_copies_do_not_hang_on_a_refused_link(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(5, 9))) for _ in range(900)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(10)) + " of" for _ in range(12)]
    base = "\n".join(lines)
    rows = [(1, base.upper()), (2, base), (3, base[:-2] + "at")]
    for k in range(4):  # one family of equal fingerprints: orders of the same lines, each with a near copy
        mixed = "\n".join(rng.sample(lines, len(lines)))
        rows += [(10 + k, mixed), (30 - k, mixed[:-2] + "at")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[1] == 1 and got[3] == got[2] == 2
    check_near_copies(got, dict(rows), 1.0)


@pytest.mark.parametrize("block", [3, 256])
def test_family_links_like_brute_force(spark, block):
    rng, rows = random.Random(12), []
    for family in range(4):
        base = [rng.randrange(10**12) for _ in range(60)]
        for n in range(40 if family else 1):
            own = set(rng.sample(base, rng.randint(45, 60))) | {rng.randrange(10**12) for _ in range(rng.choice([0, 0, 3, 20]))}
            rows.append((family, 1000 * family + n, 1000 * family + rng.choice([0, 0, n, n]), sorted(own)))
    rows += [(9, 9000, 9000, []), (9, 9001, 9001, []), (9, 9002, 9002, [5])]
    parent = {r[2]: r[2] for r in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for n, a in enumerate(rows):
        for b in rows[:n]:
            same = len({*a[3]} & {*b[3]})
            if a[0] == b[0] and (a[3] or b[3]) and same >= 0.8 * (len(a[3]) + len(b[3]) - same):
                x, y = root(a[2]), root(b[2])
                parent[max(x, y)] = min(x, y)
    want = {r[2]: root(r[2]) for r in rows}
    edges = simhash.family_links(spark.createDataFrame(rows, "family long, node long, root long, s array<bigint>").repartition(3), 0.8, block).collect()
    parent = {r[2]: r[2] for r in rows}
    for e in edges:
        x, y = root(e["a"]), root(e["b"])
        parent[max(x, y)] = min(x, y)
    assert {r[2]: root(r[2]) for r in rows} == want and len(edges) < len(rows) * (1 if block > 40 else 14)


def test_shared_counts():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(90), rng.randint(0, 60))), dtype=np.int64) for _ in range(70)]
    assert (simhash._shared(sets) == [[len({*a.tolist()} & {*b.tolist()}) for b in sets] for a in sets]).all()


def check_pieces(rows, texts, capacity=2048):
    tk = packing._encoder(queries.tokenizer_path()).tokenizer
    ids = {n: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for n, t in texts.items()}
    per, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for n, x in ids.items():
        at = 0
        for r in sorted(per[n], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(x)
            at += r["length"]
        assert at == len(x)
    pad = 0
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad / sum(len(x) for x in ids.values())


def test_packing_covers_each_id_once(docs):
    texts = {d: t for d, t, *_ in awkward() if d is not None}
    rows = [r for r in packing.pack(clashing(docs).where("doc_id is not null").dropDuplicates(["doc_id"]), queries.tokenizer_path()).collect()]
    assert check_pieces(rows, texts) < 0.02


def test_packing_repeats_and_empty(spark, docs, none):
    path = queries.tokenizer_path()
    assert packing.pack(none, path).count() == 0
    twice = docs.where("doc_id = 1").unionByName(docs.where("doc_id = 1"))
    r = packing.pack(twice, path).agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).first()
    assert r["n"] == 2 * r["t"]


def test_packed_sequences_hold_their_ids(docs):
    path = queries.tokenizer_path()
    s = packing.sequences(packing.pack(docs, path, keep_ids=True)).collect()
    tk = packing._encoder(path).tokenizer
    want = Counter(i for _, t, *_ in awkward() for i in [*tk.encode(t or "", add_special_tokens=False).ids, 1])
    assert Counter(i for r in s for i in np.frombuffer(r["ids"], dtype="<u4").tolist()) == want and all(4 * r["length"] == len(r["ids"]) for r in s)


def test_lengths_and_tail():
    for n in range(1, 6000, 7):
        got = packing.lengths(n)
        assert sum(got) == n and all(0 < x <= 2048 for x in got)
    for total in range(0, 9000, 13):
        cuts = [*packing.tail_cuts(total), total]
        assert all((b - a) & (b - a - 1) == 0 for a, b in zip(cuts, cuts[1:], strict=False))


def test_encoder_is_the_tokenizer():
    e = packing.Encoder(queries.tokenizer_path())
    odd = ["don't i'll ΣΣ OİΣ café café 12ab3 <|endoftext|> a<|startoftext|>b 你好 ... 'tis x y z 한글 (abc) ǅab. ﬁn a'b. ß ẞ ŉa", "", " ", "\n\n", "A\tB\x0bC\x1cD\x85E", "it's. x'. 'y' a.'b c.\"d ***e f*** G*** ÉCOLE!! naïve, %%% a%%%", "İstanbul, DŽ. ẞ!", prose(500)]
    odd += [t or "" for _, t, *_ in awkward()]
    want = [np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in odd]
    assert e.ids(odd) == want and e.ids(odd) == want


# --- nearest neighbours


def exact(rows, k=20):
    usual = Counter(len(v) for _, v in rows if v is not None and len(v)).most_common(1)[0][0]
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == usual and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    ids, x = np.array([i for i, _ in fine]), np.stack([v for _, v in fine])
    out = {}
    for i, v in fine:
        if i % 20 == 0:
            s = (x * v).sum(axis=1)
            order = [n for n in np.lexsort((ids, -s)) if ids[n] != i][:k]
            out[i] = [(int(ids[n]), float(s[n])) for n in order]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_search_of_all_lists_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 12))
    x[50:90] = x[50]  # one vector many times
    rows = [(n, [float(v) for v in a]) for n, a in enumerate(x)]
    rows += [(400, None), (420, [0.0] * 12), (440, [1.0, None] + [0.0] * 10), (460, [float("nan")] * 12), (480, [float("inf")] * 12), (500, [1.0, 2.0]), (520, []), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).repartition(4)
    got, want = found(ann.search(df, F.col("vec_id") % 20 == 0, share=1.0)), exact(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.98 * sum(len(w) for w in want.values())
    assert all(len(got[q]) == 20 for q in want)
    assert [i for i, _ in got[60]] == [i for i in range(50, 90) if i != 60][:20]  # ties to smaller ids
    for q, g in got.items():
        assert g == sorted(g, key=lambda r: (-r[1], r[0])) and all(abs(s - float((x[q] * x[i]).sum())) < 1e-12 for i, s in g)


def test_search_small_and_empty(spark):
    few = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(0, 60, 20)], "vec_id long, embedding array<float>")
    assert {q: [i for i, _ in g] for q, g in found(ann.search(few, F.col("vec_id") % 20 == 0)).items()} == {0: [20, 40], 20: [40, 0], 40: [20, 0]}
    assert ann.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_fills_queries_among_copies_of_unit_length(spark):
    x = np.random.default_rng(6).standard_normal((1500, 64))
    x[::3] = x[0]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    rows = [(n, [float(v) for v in a]) for n, a in enumerate(x)]
    got = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), F.col("vec_id") % 20 == 0))
    assert all(len(got.get(q, ())) == 20 for q in range(0, 1500, 20))
    for q in range(0, 1500, 60):
        assert [i for i, _ in got[q]] == [i for i in range(0, 90, 3) if i != q][:20]


def test_search_rescans_queries_whose_limit_is_too_close(spark, monkeypatch):
    class Close(ann.Index):  # local, so that workers get it as it is here
        def limits(self, ids, vectors, to, k):
            return np.zeros(len(ids))

    monkeypatch.setattr(ann, "Index", Close)
    x = np.random.default_rng(7).standard_normal((200, 12))
    rows = [(n, [float(v) for v in a]) for n, a in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, want = found(ann.search(df, F.col("vec_id") % 20 == 0, share=1.0)), exact(rows)
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_repeated_query_rows_are_one_query(spark):
    x = np.random.default_rng(9).standard_normal((200, 12))
    rows = [(n, [float(v) for v in a]) for n, a in enumerate(x)] + [(20, [float(v) for v in x[20]]), (40, [float(v) for v in x[41]]), (7, [float(v) for v in x[7]])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 20 == 0, share=1.0).collect()
    per = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        per[r["query_id"]].append((r["vec_id"], r["score"]))
    asks = {q: min(v for i, v in rows if i == q) for q in range(0, 200, 20)}
    for q, v in asks.items():
        want = sorted(((-float((np.array(u) * np.array(v)).sum()), i) for i, u in rows if i != q))[:20]
        assert [i for i, _ in per[q]] == [i for _, i in want]


def test_lists_beyond_the_limit_are_left_out(spark, monkeypatch):
    """Tight clusters: the same neighbours with far fewer pairs of query and list, though every list may be probed."""
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((40, 16)) * 5
    x = np.repeat(centres, 60, axis=0) + rng.standard_normal((2400, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(n, [float(v) for v in a]) for n, a in enumerate(x)]
    seen, keep = {}, ann.written

    def written(df, name):
        seen[name] = keep(df, name)
        return seen[name]

    monkeypatch.setattr(ann, "written", written)
    got, want = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 20 == 0, share=1.0)), exact(rows)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.99 * 20 * len(want)
    assert seen["queries"].count() < 0.6 * 120 * seen["lists"].select("list").distinct().count()


def test_recall_on_the_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(queries.op3_ann(spark, sf)), exact(rows)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(len(w) for w in want.values())


# --- fingerprints


def test_edited_fingerprints(docs):
    rows = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(clashing(docs).where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    order = sorted(((d, t or "") for d, t, *_ in {r[0]: r for r in awkward() if r[0] is not None}.values()), reverse=True)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t)] for i in range(max(1, len(w) - 4)) if w}
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = rows[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a = shingles(t)
        assert len(r["sketch"]) == min(len(a), fingerprints.K)
    by_text = defaultdict(set)
    for d, t in order:
        by_text[t].add(tuple(rows[d]["sketch"]))
    assert all(len(v) == 1 for v in by_text.values())


@pytest.mark.parametrize("most", [1024, 2])
def test_next_across_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 7)
    monkeypatch.setattr(fingerprints.ranges, "__defaults__", (most,))
    rows = [(n * n, f"text {n} " + "w " * (n % 5), None, None, None) for n in range(100)]
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(spark.createDataFrame(rows, DOCS).repartition(6)).where("guest = 0").collect()}
    assert got == {n * n: rows[n - 1][1] if n else rows[99][1] for n in range(100)}


def slow_sketch(text, k):
    """The k smallest chained hashes of five-word shingles, as Spark's functions make them."""
    w = [spark_hash(x) for x in re.findall(r"[^ \t\n\x0B\f\r]+", text)]
    if len(w) >= 5:
        out = {spark_hash(*map(np.int64, w[n : n + 5])) for n in range(len(w) - 4)}
    else:
        h = 42
        for x in w:
            h = spark_hash(np.int64(h), np.int64(x))
        out = {h} if w else set()
    return sorted(out)[:k]


def slow_resemblance(a, b, k):
    u = sorted({*a, *b})[:k]
    return 1.0 if not a and not b else len({*a} & {*b} & {*u}) / len(u)


def test_likeness_like_brute_force(spark):
    rng, texts = random.Random(14), {}
    for n in range(40):
        texts[n] = prose(rng.choice([0, 1, 3, 5, 40, 400, 900]), rng) if n % 3 or not n else texts[n - 1] + " " + prose(rng.randrange(60), rng)
    rows = {r["doc_id"]: r for r in queries.digest_of_sketches(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    k = fingerprints.K
    for n, t in texts.items():
        nxt = texts[n - 1 if n else 39]
        half = len(t) // 2
        a, e, b = (slow_sketch(x, k) for x in (t, t[: len(t) - half] + nxt[:half], nxt))
        told = "".join(f"{x % (1 << 64):016x}" for x in a)
        assert rows[n]["fingerprint"] == told
        assert abs(rows[n]["near_edited"] - slow_resemblance(a, e, k)) < 1e-12 and abs(rows[n]["near_next"] - slow_resemblance(a, b, k)) < 1e-12


def test_estimates_and_merging(spark):
    words = [f"w{n}" for n in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a"), 512).alias("x"), fingerprints.sketch(F.col("b"), 512).alias("y"), fingerprints.sketch(F.concat_ws(" ", "a", "b"), 512).alias("z"))
    x, y = F.col("x"), F.col("y")
    r = df.select(fingerprints.resemblance(x, y, 512).alias("j"), fingerprints.containment(x, y, 512).alias("c"), fingerprints.distinct_count(x, 512).alias("n")).first()
    assert abs(r["j"] - 1 / 3) < 0.08 and abs(r["c"] - 0.5) < 0.12 and abs(r["n"] / 3996 - 1) < 0.15
    parts = spark.createDataFrame([("g", a), ("g", b), ("h", "one two"), ("e", "")], "g string, t string").select("g", fingerprints.sketch(F.col("t"), 64).alias("sketch"))
    merged = {r["g"]: r["sketch"] for r in fingerprints.merge_groups(parts, ["g"], k=64).collect()}
    want = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.merge(fingerprints.sketch(F.col("a"), 64), fingerprints.sketch(F.col("b"), 64), 64)).first()[0]
    assert merged["g"] == want and merged["e"] == [] and len(merged["h"]) == 1


def test_fingerprints_empty(none):
    assert fingerprints.edited_fingerprints(none).count() == 0 and fingerprints.fingerprints(none).count() == 0


# --- quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = got.select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)


def test_quality_on_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, None, 0), (None, 1, 0), (10, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.score(clashing(docs), model).collect()
    assert len(rows) == len(awkward()) and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert quality.train(docs, labels.where("quality = 1")).constant is not None
    assert quality.score(none, quality.train(none, labels)).count() == 0


def test_forward_backward_like_enumeration():
    rng = np.random.default_rng(3)
    counts, score, move = [1, 4, 3], rng.standard_normal(8), rng.standard_normal((2, 2))
    good, joint = quality.Chains(counts).marginals(score, move, pairs=True)
    at, want, pairs = 0, [], np.zeros((2, 2))
    for n in counts:
        total, p, j = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in range(1 << n):
            y = [path >> k & 1 for k in range(n)]
            w = np.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            p += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                j[a, b] += w
        want += (p / total).tolist()
        pairs += j / total
        at += n
    assert np.allclose(good, want) and np.allclose(joint, pairs)


def test_scores_like_plain_forward_backward(spark, docs):
    labels = spark.createDataFrame([(d, int(d % 2), 0) for d, *_ in awkward() if d], "doc_id long, quality int, toxic int")
    m = quality.train(docs, labels)
    for _, t, *_ in awkward():
        x, w = quality.features(t or "")
        emit = x.astype(float) @ m.weights
        alpha = [np.array([0.0, emit[0]])]
        for e in emit[1:]:
            alpha.append(np.array([np.logaddexp(alpha[-1][0] + m.move[0, y], alpha[-1][1] + m.move[1, y]) + e * y for y in (0, 1)]))
        beta = [np.zeros(2)]
        for e in emit[:0:-1]:
            beta.append(np.array([np.logaddexp(m.move[y, 0] + beta[-1][0], m.move[y, 1] + e + beta[-1][1]) for y in (0, 1)]))
        good = [np.exp(a + b - np.logaddexp(*(a + b)))[1] for a, b in zip(alpha, beta[::-1], strict=True)]
        assert abs(m.score([t or ""])[0] - np.average(good, weights=w)) < 1e-6


def test_quality_sample_is_bounded_in_lines(spark, monkeypatch):
    rows = [(n, "good line here\n" * (n % 40) + "x", None, None, None) for n in range(1, 200)] + [(3, "another text", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(1, 200)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, counts, labels: seen.append((len(x), len(counts))))
    quality.train(df, labels, sample=100, sample_lines=300)
    assert 0 < seen[0][0] <= 300 and 0 < seen[0][1] <= 100


# --- sharding


def test_shards_are_even_and_gapless(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_slots(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    load, places = Counter(), defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert set(load) == set(range(40)) and all(sorted(p) == list(range(len(p))) for p in places.values()) and len(rows) == len(texts)
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 40


@pytest.mark.parametrize("key", ["case when id % 2 = 0 then 7 else id end", "cast(null as long)", "case when id % 3 = 0 then null else id end"])
def test_shards_are_even_with_hot_keys(spark, monkeypatch, key):
    df = spark.range(4000).selectExpr(f"{key} as doc_id", "repeat('ab', cast(id % 97 as int)) as text")
    for rank_rows in (100_000, 3):  # slots ranked whole, and in parts
        monkeypatch.setattr(sharding, "RANK_ROWS", rank_rows)
        rows = sharding.placed(*(lambda r: (r, sharding.rebalance(sharding.even_map(spark), sharding.slot_sizes(r), 40)))(spread(df)), rank_rows).collect()
        load, places = Counter(), defaultdict(list)
        for r in rows:
            load[r["shard"]] += r["size"]
            places[r["shard"]].append(r["slot"])
        assert len(rows) == 4000 and all(sorted(p) == list(range(len(p))) for p in places.values())
        assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) <= 0.03 * sum(load.values()) / 40


def spread(df):
    from tallyspark.llm.common import written

    first = written(sharding.records(df), "records")
    return written(sharding.spread_hot(first, sharding.slot_sizes(first)), "records")


def test_shard_stores_a_version_edits_it_and_reads_it_back(spark, docs, tmp_path):
    path = f"file://{tmp_path}/map"
    rows = sharding.shard(docs, 4, 64, path).collect()
    one, two = (dict(sharding.load_map(spark, path, v).select("vslot", "shard").collect()) for v in (1, 2))
    assert one == {s: s % 4 for s in range(64)} and set(two) == set(one) and two != one
    assert all(two[r["vslot"]] == r["shard"] for r in rows)
    load = Counter()
    for d, t, *_ in awkward():
        load[d] += len((t or "").encode()) + 16
    assert sum(r["size"] for r in rows) == sum(load.values())


def test_map_versions_and_rebalancing(spark, docs, none, tmp_path):
    recs = sharding.records(spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text")), 512)
    sizes = sharding.slot_sizes(recs, 512).cache()
    one = sharding.slot_map(sizes, 8)
    path = f"file://{tmp_path}/map"
    sharding.store_map(one, path)
    two = sharding.rebalance(sharding.load_map(spark, path), sizes, 10)
    sharding.store_map(two, path)
    assert sharding.load_map(spark, path).first()["version"] == 2 and sharding.load_map(spark, path, 1).count() == 512
    a, b = ({r["vslot"]: r["shard"] for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2))
    size = {r["vslot"]: r["bytes"] for r in sizes.collect()}
    load = Counter()
    for s, k in b.items():
        load[k] += size[s]
    assert set(load) == set(range(10)) and max(load.values()) < 1.1 * sum(size.values()) / 10
    assert sum(size[s] for s in a if a[s] != b[s]) < 0.35 * sum(size.values())
    fewer = {r["vslot"]: r["shard"] for r in sharding.rebalance(one, sizes, 5).collect()}
    assert set(fewer.values()) == set(range(5)) and len(fewer) == 512
    assert sharding.shard(clashing(docs), 4, 64).count() == len(awkward()) and sharding.shard(none, 4, 64).count() == 0


# --- WARC


@functools.cache
def pages():
    evil = "x" * 900 + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nfoo" + "y" * 500
    big = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30000
    rows = [(n, f"http://e/{n}", prose(40 * n)) for n in range(40)] + [(100 + n, "u", evil) for n in range(3)]
    return [*rows, (200, None, None), (201, "u\r\nWARC-Type: x", "WARC/1.1\r\n" * 3), (202, "v", big), (203, "v", "é" * 600), (204, "v", "é" * 600), (210, "http://e/" + "q" * 100_000, "z" * 90), (211, "http://e/WARC/1.1", "long head before"), (212, "http://e/a\u2028b c\x85d", "odd"), (205, "v", "é" * 499), (206, "v", "é" * 499), (None, "w", "z" * 2000), (207, "", "")]


@pytest.mark.parametrize("split", ["128m", "64k"])
def test_warc_round_trip(spark, split):
    """Also with files cut into many blocks, inside the large payload of magic lines."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("record", F.lit(1)).coalesce(2)
        got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(pages())
    for page, _, html in pages():
        data = (html or "").encode()
        r = got[page]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == data
    assert {p: r["refers_to"] for p, r in got.items() if r["record_type"] == "revisit"} == {100: 102, 101: 102, 203: 204}


def test_warc_repeated_ids_and_urls(spark):
    rows = [(1, "a", "x" * 1500), (1, "a", "x" * 1500), (1, "b", "other"), (2, "c", "y" * 1500), (3, "http://e/" + "q" * 70_000, "y" * 1500), (4, "u WARC/1.1", "w"), (5, "l\u2028\x85m", "v")]
    rows += [(None, "n", "o" * 2000), (8, "n", "o" * 2000), (7, "n", "o" * 2000), (None, "p", "p" * 2000), (None, "p", "p" * 2000), (None, "q", "small")]
    got = Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect())
    want = [(1, "a", "response", None, 1500)] * 2 + [(1, "b", "response", None, 5), (2, "c", "revisit", 3, 1500), (3, rows[4][1], "response", None, 1500), (4, "u%20WARC/1.%31", "response", None, 1), (5, "l%E2%80%A8%C2%85m", "response", None, 1)]
    want += [(None, "n", "revisit", 8, 2000), (8, "n", "response", None, 2000), (7, "n", "revisit", 8, 2000), *[(None, "p", "response", None, 2000)] * 2, (None, "q", "response", None, 5)]
    assert got == Counter(want)


def foreign(n, url, payload):
    data = payload.encode()
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(data)}\r\n\r\n".encode() + data + b"\r\n\r\n"


@pytest.mark.parametrize("split", ["64k", "3000"])
def test_warc_of_others_with_magic_in_headers(spark, tmp_path, monkeypatch, split):
    """Magic lines among the headers, also where a block ends in the midst of them; both ways to join pieces and blocks."""
    rng, pages = random.Random(3), []
    for n in range(60):
        url = rng.choice(["http://e/", "http://e/" + "q" * 2500, "WARC/1.1", "x" * 1400 + "WARC/1.1"])
        pages.append((n, url, rng.choice(["", "WARC/1.1\r\n" * 40, "\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "z" * rng.randrange(4000)])))
    (tmp_path / "a.warc").write_bytes(b"".join(foreign(*p) for p in pages[:45]))
    (tmp_path / "b.warc").write_bytes(b"".join(foreign(*p) for p in pages[45:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for blocks in (100_000, 0)[split == "64k" :]:
            monkeypatch.setattr(warc, "BROADCAST_BLOCKS", blocks)
            got = sorted((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in warc.read(spark, f"file://{tmp_path}").collect())
            assert got == pages
        (tmp_path / "c.warc").write_bytes(foreign(99, "u", "cut off")[:-9])
        with pytest.raises(ValueError, match="c.warc"):
            warc.read(spark, f"file://{tmp_path}")
        assert warc.read(spark, f"file://{tmp_path}", strict=False).count() == len(pages)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_same_as_sql(spark, sf):
    from tests.compare import connect, same

    same(queries.op7_warc(spark, sf), queries.ORACLES["op7_warc"], connect(sf))


# --- language model


def small_model(spark, words, others=255):
    df = spark.createDataFrame([(n, " ".join(words[n * 50 : n * 50 + 50])) for n in range(len(words) // 50)], "doc_id long, text string")
    counted = lmscore.word_counts(df)
    return df, counted, lmscore.train(df, counted)


def test_probabilities_of_words_sum_to_one(spark):
    """Over all words of the corpus, those that share tokens too, each between the same neighbours."""
    rng = random.Random(5)
    words = [f"w{n}é" for n in range(6000)] + [f"w{rng.randrange(3000, 6000)}é" for _ in range(4000)]
    _, counted, m = small_model(spark, words)
    n = {r["word"]: r["n"] for r in counted.collect()}
    near = m.tokens("w5900é w1é w2é w5901é")[0]
    every = sorted(n)
    padded, at = np.zeros(5 * len(every), dtype=np.int64), np.arange(len(every)) * 5 + 2
    for k, step in enumerate(lmscore.WINDOW):
        padded[at + step] = near[k]
    padded[at] = [m.tokens(w)[0][0] for w in every]
    logs = m.log_likelihood(padded, at)
    p = [np.exp(x) * (1 if w.encode() in m.ids else n[w]) for x, w in zip(logs, every, strict=True)]
    assert abs(sum(p) - 1) < 1e-3


def slow_log_likelihood(m, tokens, k):
    h = np.zeros(lmscore.HIDDEN)
    for j, step in enumerate(lmscore.WINDOW):
        h += m.near[j][tokens[k + step] if 0 <= k + step < len(tokens) else lmscore.PAD]
    h = np.tanh(h)
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    c, w = divmod(int(m.place[tokens[k]]), lmscore.WIDE)
    return soft(h @ m.out.astype(float) + m.bias)[c] + soft(m.word[c].astype(float) @ h + m.word_bias[c])[w] - m.shared[tokens[k]]


def test_scores_like_brute_force(spark, docs):
    counted = lmscore.word_counts(docs)
    m = lmscore.train(docs, counted)
    n = {r["word"].encode(): r["n"] for r in counted.collect()}
    more = spark.createDataFrame([(900, "the of unseen words über reed"), (901, "x\x1fy z ΟΔΟΣ ΟΔΟΣ.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lmscore.score(clashing(docs).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(more), m, counted).collect()}
    texts = {d: t or "" for d, t, *_ in awkward() if d is not None} | dict(more.collect())
    assert set(got) == set(texts)
    for d, t in texts.items():
        tokens, words = m.tokens(t)[0], t.lower().encode().split()
        assert got[d]["n_tokens"] == len(words)
        if len(words) > 1000:
            continue
        want = sum(slow_log_likelihood(m, tokens, k) + (0 if w in m.ids else np.log(n.get(w, 1))) for k, w in enumerate(words))
        assert abs(got[d]["sum_logprob"] - want) < 1e-3 * max(1, abs(want))


def test_step_follows_the_gradient():
    """The change of a parameter has the sign and share of the numeric gradient."""
    ids = {f"w{n}".encode(): n + 1 for n in range(lmscore.WORDS)}
    counts = np.r_[0, np.arange(1 + lmscore.WORDS + lmscore.OTHERS - 1, 0, -1.0)]
    m = lmscore.Model(ids, counts, np.r_[False, np.ones(len(counts) - 1, dtype=bool)])
    padded, _ = lmscore._padded([np.array([5, 900, 7, 900, 4000, 5, 7])])
    at = np.flatnonzero(padded)
    loss = lambda: -m.log_likelihood(padded, at).sum()
    seen = {}
    for name, index in (("near", (1, 900)), ("word", divmod(int(m.place[900]), lmscore.WIDE)), ("out", (slice(None), 0)), ("word_bias", divmod(int(m.place[5]), lmscore.WIDE))):
        part, flat = getattr(m, name), []
        target = np.atleast_1d(part[index]).shape
        for k in np.ndindex(*target):
            spot = index if np.ndim(part[index]) == 0 else (*index, *k) if name != "out" else (k[0], 0)
            kept = part[spot]
            part[spot] = kept + 5e-2
            up = loss()
            part[spot] = kept - 5e-2
            flat.append((up - loss()) / 1e-1)
            part[spot] = kept
        seen[name] = (index, np.array(flat), part[index].copy())
    m.start()
    m.step(padded, at)
    for name, (index, grad, before) in seen.items():
        change = np.atleast_1d(before - getattr(m, name)[index])
        assert (np.sign(change) == np.sign(grad))[np.abs(grad) > 0.05].all(), name
        if name in ("near", "word"):
            assert np.corrcoef(change, grad)[0, 1] > 0.99, name


def plain_step(m, padded, at, rate):
    """One step over whole arrays in double precision: changes of the parameters from sums of squares of 1e-6."""
    kind, within = np.divmod(m.place[padded[at]], lmscore.WIDE)
    near, out, word = m.near.astype(float), m.out.astype(float), m.word.astype(float)
    hidden = np.tanh(sum(near[k][padded[at + step]] for k, step in enumerate(lmscore.WINDOW)))
    rows = np.arange(len(at))

    def error(scores, chosen):
        odds = np.exp(np.minimum(scores, 60))
        odds /= odds.sum(axis=1, keepdims=True)
        odds[rows, chosen] -= 1
        return odds

    outer, inner = error(hidden @ out + m.bias, kind), error(np.einsum("nh,nwh->nw", hidden, word[kind]) + m.word_bias[kind], within)
    back = (outer @ out.T + np.einsum("nw,nwh->nh", inner, word[kind])) * (1 - hidden**2)
    grads = {"out": hidden.T @ outer, "bias": outer.sum(axis=0)}
    grads |= {name: np.zeros(getattr(m, name).shape) for name in ("near", "word", "word_bias")}
    np.add.at(grads["word"], kind, np.einsum("nw,nh->nwh", inner, hidden))
    np.add.at(grads["word_bias"], kind, inner)
    for k, step in enumerate(lmscore.WINDOW):
        np.add.at(grads["near"][k], padded[at + step], back)
    square = lambda name, g: (g**2).mean(axis=-1, keepdims=True) if name in ("near", "word") else g**2
    return {name: rate * g / np.sqrt(1e-6 + square(name, g)) for name, g in grads.items()}


@pytest.mark.parametrize("high", [False, True])
def test_step_and_likelihood_in_tiles_are_those_of_whole_arrays(monkeypatch, high):
    """Several tiles, classes within and across them, classes without a place; scores that are looked at against the limit and that aren't."""
    monkeypatch.setattr(lmscore, "TILE", 100)
    rng = np.random.default_rng(3)
    counts = np.r_[0, np.arange(lmscore.WORDS + lmscore.OTHERS, 0, -1.0)]
    m = lmscore.Model({}, counts, np.r_[False, np.ones(len(counts) - 1, dtype=bool)])
    m.bias[:3] += 0.5
    vectors, _ = m._vectors()
    if high:
        monkeypatch.setattr(lmscore, "MOST", np.float32(0.99 * (np.abs(vectors[:, :, :-1]).sum(axis=2) + vectors[:, :, -1]).max()))
    assert m._vectors()[1] == high
    padded, _ = lmscore._padded([1 + (rng.random(n) ** 4 * 2000).astype(np.int64) for n in (1, 0, 333, 2, 500)])
    at = rng.permutation(np.flatnonzero(padded))
    want = np.array([slow_log_likelihood(m, padded, k) for k in at])
    assert np.abs(m.log_likelihood(padded, at) - want).max() < 1e-3
    before = {name: getattr(m, name).copy() for name in m.PARTS}
    change = plain_step(m, padded, at, 0.15)
    m.start()
    m.step(padded, at, 0.15)
    for name in m.PARTS:
        got = before[name] - getattr(m, name)
        assert np.abs(got - change[name]).max() < 2e-2 * 0.15, name
        assert (got[change[name] == 0] == 0).all(), name


def test_texts_are_read_twice_only(spark):
    """Once to count words, once to tokenise them: training and scoring share the tokens."""
    read = spark.sparkContext.accumulator(0)

    def told(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([(n, f"a b c w{n} w{n % 7}") for n in range(200)], "doc_id long, text string")
    rows = lmscore.pseudo_likelihood(docs.select("doc_id", F.udf(told, "string")("text").alias("text"))).collect()
    assert len(rows) == 200 and all(r["n_tokens"] == 5 for r in rows)
    assert read.value == 400


def test_many_stretches_of_a_document_table(spark):
    """Rows, tokens and rare words stay together when a batch is worked off in many stretches."""
    text = lambda n: " ".join([f"r{n}"] * (9000 * (n % 5))) if n % 3 else None
    docs = spark.createDataFrame([(n, text(n)) for n in range(40)], "doc_id long, text string").coalesce(1)
    counted = lmscore.word_counts(docs)
    m = lmscore.Model(*lmscore.lexicon(counted, words=5))
    m.size = 1 + lmscore.WORDS + lmscore.OTHERS  # tokens of hashed words need two bytes
    rows = {r["doc_id"]: r for r in lmscore.tokenised(docs, m).collect()}
    assert len(rows) == 40 and sum(len(r["rare"]) for r in rows.values()) > 2 * lmscore.STRETCH
    for n in range(40):
        tokens, hashes = m.tokens(text(n) or "")
        assert np.array_equal(np.frombuffer(rows[n]["tokens"], dtype=np.uint16), tokens) and np.array_equal(rows[n]["rare"], hashes), n


def test_training_lowers_the_loss_and_order_counts(spark):
    rng = random.Random(1)
    cycle = ["a", "b", "c", "d", "e", "f"]
    texts = [" ".join(cycle[(s + k) % 6] for k in range(60)) for s in range(6) for _ in range(60)]
    df = spark.createDataFrame([(n, t, None, None, None) for n, t in enumerate(texts)], DOCS).repartition(2)
    counted = lmscore.word_counts(df)
    m, fresh = lmscore.train(df, counted), lmscore.Model(*lmscore.lexicon(counted))
    # words of one class and of equal counts are told apart by their neighbours
    assert len({int(m.place[m.ids[w.encode()]]) // lmscore.WIDE for w in cycle}) == 1
    shuffled = texts[0].split()
    rng.shuffle(shuffled)
    test = spark.createDataFrame([(0, texts[0]), (1, " ".join(shuffled)), (2, None), (3, " ")], "doc_id long, text string")
    good, start = ({r["doc_id"]: r for r in lmscore.score(test, x, counted).collect()} for x in (m, fresh))
    assert good[0]["mean_logprob"] > start[0]["mean_logprob"] + 0.3 and good[0]["mean_logprob"] > good[1]["mean_logprob"] + 0.3
    assert good[2]["mean_logprob"] is None and good[3]["sum_logprob"] == 0 and good[0]["n_tokens"] == 60


def test_arrays_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "FAN", 3)
    rows = [(bytearray(np.full(5, float(n)).tobytes()), n) for n in range(1, 24)]
    got = lmscore._summed(spark.createDataFrame(rows, "v binary, n long").repartition(7), 5).collect()
    assert len(got) == 1 and got[0]["n"] == 276 and np.frombuffer(got[0]["v"]).tolist() == [276.0] * 5


def test_documents_that_occur_twice_score_higher(spark):
    """Texts of rare words, some of them twice in the corpus: their words' counts tell."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) if k % 2 else f"r{rng.getrandbits(40):x}" for k in range(80)) for _ in range(300)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts + texts[:30])], "doc_id long, text string").repartition(3)
    mean = {r["doc_id"]: r["mean_logprob"] for r in lmscore.pseudo_likelihood(df).collect()}
    assert min(mean[n] for n in range(30)) > max(mean[n] for n in range(30, 300))


def test_lm_awkward_and_empty(docs, none):
    rows = lmscore.pseudo_likelihood(clashing(docs)).collect()
    assert len(rows) == len(awkward()) and all(r["sum_logprob"] <= 1e-6 for r in rows)
    assert lmscore.pseudo_likelihood(none).count() == 0


# --- mixing


def mixed_docs(spark):
    rows = [(n, "w " * (1 + n % 9), "en", "big" if n % 3 else ("mid" if n % 2 else f"small{n % 4}"), 0) for n in range(3000)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_mix_meets_limit_and_budgets(spark):
    got = mixing.mix(mixed_docs(spark), limit=3.0, block_rows=50).select("doc_id", "source", "mix_tokens", "mix_passes", "mix_weight", "mix_epoch", "mix_block").toPandas()
    per = got.groupby("source").agg(tokens=("mix_tokens", "sum"), passes=("mix_passes", "first"), weight=("mix_weight", "first"))
    assert abs(per.passes.max() - 3) < 1e-6 and abs(per.passes.min() - 1) < 1e-9 and abs(per.weight.sum() - 1) < 1e-9
    once = mixed_docs(spark).select("source", (F.size(F.split(F.trim("text"), " "))).alias("t")).groupBy("source").sum("t").toPandas().set_index("source")["sum(t)"]
    for s, r in per.iterrows():
        assert 0 <= r.passes * once[s] - r.tokens < 10 + 1e-6  # less than one document short
    assert got.doc_id.nunique() == 3000
    assert not got.duplicated(["doc_id", "mix_epoch"]).any()


def test_mix_meets_entropy(spark):
    counts = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    for target in (0.5, 0.9, 1.05):
        w = [r["weight"] for r in mixing.weights(counts, None, target).collect()]
        assert abs(-sum(x * np.log(x) for x in w) - target) < 1e-6
    assert {r["passes"] for r in mixing.weights(counts, None, 5.0).collect()} != {1.0}


def test_mix_passes_sources_without_tokens_once(spark):
    rows = [(n, "a b c", "en", "full", 0) for n in range(40)] + [(100 + n, t, "en", s, 0) for n, (t, s) in enumerate([("", "bare"), (None, "bare"), (" ", "bare"), ("", None), ("\n", "bare")])]
    rows += [(200, "one", "en", "rare", 0), (201, "", "en", "rare", 0), (202, None, "en", "full", 0)]
    got = Counter(r["doc_id"] for r in mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3), limit=3.0).collect())
    assert all(got[n] == 1 for n in [*range(100, 105), 202]) and got[200] == 3 and all(got[n] == 1 for n in range(40))
    only = spark.createDataFrame([(n, "", "en", "bare", 0) for n in range(5)], DOCS)
    assert mixing.mix(only).count() == 5


def spark_hash(*values):
    """Spark's chained 64-bit hash of longs, ints and strings."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.item().to_bytes(v.nbytes, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def slow_mix(rows, limit, block_rows, seed=mixing.SEED):
    """{(doc_id, epoch): block} of rows (doc_id, text, source), no source being null."""
    i, ln = np.int32, np.int64
    tokens = {d: len(re.findall(r"[^ \t\n\x0B\f\r]+", t)) for d, t, _ in rows}
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((spark_hash(ln(d), t), d))
    share = {s: sum(tokens[d] for _, d in x) for s, x in by.items()}
    total = sum(share.values())
    share = {s: n / total for s, n in share.items()}
    low, high = 0.0, 1.0
    passes = lambda a: {s: (p / max(share.values())) ** (a - 1) for s, p in share.items()}
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if max(passes(mid).values()) <= limit else (mid, high)
    out = {}
    for s, docs in by.items():
        r = round(passes(0.0 if max(passes(0.0).values()) <= limit else high)[s], 9)
        blocks, last = -(-len(docs) // block_rows), int(r)
        budget = round((r - last) * sum(tokens[d] for _, d in docs))
        of = lambda h: spark_hash(ln(h), i(seed)) % blocks  # noqa: B023, E731
        for e in range(last):
            out |= {(d, e): (of(h) + spark_hash(i(e), i(seed))) % blocks for h, d in docs}
        held = {b: [x for x in docs if of(x[0]) == b] for b in range(blocks)}
        order = sorted((b for b in held if held[b]), key=lambda b: (spark_hash(i(b), i(last), i(seed)), b))
        for place, b in enumerate(order):
            if budget <= 0:
                break
            left = budget
            for h, d in sorted(held[b], key=lambda x: (spark_hash(ln(x[0]), i(seed), i(last)), x[0])):
                left -= tokens[d]
                if left < 0:
                    break
                out[d, last] = place
            budget -= sum(tokens[d] for _, d in held[b])
    return out


def test_mix_like_brute_force(spark):
    rng = random.Random(4)
    rows = [(n, " ".join(["w"] * rng.randrange(1, 30)), rng.choice(["a"] * 20 + ["b"] * 5 + ["c"])) for n in range(700)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), limit=2.7, block_rows=16).collect()
    assert {(r["doc_id"], r["mix_epoch"]): r["mix_block"] for r in got} == slow_mix(rows, 2.7, 16) and len(got) == len({(r["doc_id"], r["mix_epoch"]) for r in got})


def test_mix_awkward_and_empty(docs, none):
    rows = mixing.mix(clashing(docs)).collect()
    assert {r["doc_id"] for r in rows} == {d for d, *_ in awkward()} and all(r["fp"] == "x" for r in rows)
    assert sum(1 for r in rows if r["text"] is None) >= 1
    assert mixing.mix(none).count() == 0


# --- licenses


def slow_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
    return len(w), hits


def test_license_base_like_brute_force(spark, docs):
    more = ["CC-BY and cc by cc BY", "all rights reserved all rights reserved", "general public licenses", "ccby", "x all rights\nReserved.", "GNU General Public License v2"]
    df = clashing(docs).select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + n, t) for n, t in enumerate(more)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = licenses.scan(df).collect()
    for r in rows:
        n, hits = slow_base(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (n, len(hits))
        assert (r["first_word"], r["last_word"]) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert len(rows) == len(awkward()) + len(more)


def test_fuzzy_notices_report_spans():
    s = licenses.Scanner()
    rng = random.Random(3)
    for notice, label in licenses.NOTICES.items():
        for edits in range(licenses.errors_allowed(notice) + 1):
            chars = list(notice)
            for at in rng.sample(range(2, len(chars) - 2), edits):
                chars[at] = rng.choice("qxz") if chars[at] != " " else chars[at]
            got = s.scan("before it " + "".join(chars) + " after it")
            span = next(x for x in got["spans"] if x["label"] == label)
            assert span["edits"] <= edits and 1 <= span["first"] <= 3
    assert s.scan(prose(3000))["spans"] == []


def test_notices_back_to_back_have_a_span_each():
    s, notice = licenses.Scanner(), "released under the mit license"
    for gap in (" ", " and ", " " + prose(9) + " "):
        assert [x["label"] for x in s.scan(gap.join([notice] * 3))["spans"]] == ["mit-notice"] * 3
    got = s.scan("relxased undor the mit license " + notice)
    assert [x["edits"] for x in got["spans"]] == [2, 0] and got["score"] > 0.9


def least_edits(notice, text):
    """Fewest edits that turn the notice into some stretch of the text."""
    row = [0] * (len(text) + 1)
    for k, a in enumerate(notice, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_fuzzy_search_like_brute_force():
    s, rng = licenses.Scanner(), random.Random(6)
    for notice, label in list(licenses.NOTICES.items())[::3]:
        for edits in range(licenses.errors_allowed(notice) + 3):
            chars = list(notice)
            for _ in range(edits):
                k = rng.randrange(len(chars))
                chars[k : k + 1] = rng.choice([[], [rng.choice("qxz")], [chars[k], rng.choice("qxz")]])
            joined = " ".join(licenses.words(prose(12) + " " + "".join(chars) + " " + prose(12)))
            got = [x for x in s.scan(joined)["spans"] if x["label"] == label]
            least = least_edits(notice, f" {joined} ")
            assert bool(got) == (least <= licenses.errors_allowed(notice))
            if got:
                assert min(x["edits"] for x in got) == least


def test_query_returns_spans(spark, sf):
    rows = queries.op10_licenses(spark, sf).collect()
    assert any(r["spans"] for r in rows) and all(r["spans"] or r["labels"] == r["base_labels"] for r in rows)


def test_licenses_empty(none):
    assert licenses.scan(none).count() == 0


# --- pipeline


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "mixture", "packing"]
    good = stages["quality"](spark, docs, sf).cache()
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    assert all(d in kept for d, q in labels.items() if q == 1) and sum(d in kept for d, q in labels.items() if q == 0) <= 2
    one = stages["near_duplicates"](spark, good, sf).cache()
    left = [r["doc_id"] for r in one.collect()]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(good).collect()}
    check_near_copies(got, {d: texts[d] for d in kept}, 0.9)
    assert sorted(left) == sorted(set(got.values()))
    mixed = stages["mixture"](spark, one, sf).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == set(left)
    rows = stages["packing"](spark, one, sf).collect()
    assert check_pieces(rows, {d: texts[d] for d in left}) < 0.03


def test_one_of_each_goes_by_row(spark, none):
    rng = random.Random(2)
    a, b, c = (" ".join(f"{rng.choice(WORDS)}{rng.randrange(300)}" for _ in range(120)) for _ in range(3))
    rows = [(1, a), (1, a), (2, a + " end"), (5, b), (5, a), (None, b), (None, c), (None, c), (8, None), (9, ""), (10, "x" * 50_000)]
    df = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows], DOCS).withColumn("kept", F.lit("x")).withColumn("copy", F.lit("y")).repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, "").collect())
    assert got == Counter([(1, a), (5, b), (None, c), (8, None), (10, "x" * 50_000)])


@pytest.mark.parametrize("stage", ["near_duplicates", "mixture", "packing"])
def test_stages_on_awkward_rows(spark, docs, none, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    assert f(spark, none, "").count() == 0
    got = f(spark, clashing(docs), "").collect()
    texts = {d: t or "" for d, t, *_ in awkward()}
    if stage == "near_duplicates":
        assert len(got) == len({(r["doc_id"], r["text"]) for r in got}) and {r["text"] or "" for r in got} <= set(texts.values()) and len(got) >= 18
    else:
        assert {r["doc_id"] for r in got} == set(texts)


def test_quality_stage_on_awkward_rows(spark, docs, none, sf):
    f = dict(corpus_pipeline.STAGES)["quality"]
    assert f(spark, none, sf).count() == 0 and f(spark, clashing(docs), sf).columns == corpus_pipeline.COLUMNS


def test_pipeline_runs(spark, sf):
    assert queries.QUERIES["pipeline"](spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None
