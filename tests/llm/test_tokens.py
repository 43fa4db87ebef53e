"""Fill-in-middle, SentencePiece rounds and alignment against the libraries and slow versions."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import alignment, fim, pieces, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECE)
MODEL = pieces.encoder(PIECE)
R = random.Random(3)
ODD = [
    "", " ", "   ", "a", "  a", "a  ", " a   b", "x" * 1000, "a" * 999, "ab" * 500, "\n\n a\n  b", "▁▁ x ▁", "日本語テキスト 漢字", "🙂🙂 é ﬁ \x00 \x7f", "<s> </s> <unk> <0x41> <|endoftext|>",
    " " * 100 + "é", " " * 33, " " * 15, " " * 31 + "the", "\t\t  \t", "ACGT" * 300, "\x01 \x01a \x01\x01", "it's we'll 'S 12ab", "line\r\nend\r\n", "a<P>b", "<", "<P", "tail <",
]
ODD += ["".join(R.choice(al) for _ in range(R.randint(1, 120))) for al in ("ab ", "abc", "ACGT", "the \n", " ▁é", "aàáâ日本 \n", "0123456789 ,.", "etaoin shrdlu", "AaBb01+/", "<PSM> ") for _ in range(40)]
ODD += ["".join(chr(R.choice([R.randrange(32, 127), R.randrange(0x80, 0x3000), R.randrange(0x3000, 0xD800), R.randrange(0xE000, 0x110000), 32])) for _ in range(R.randint(1, 100))) for _ in range(60)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, texts):
    rows = [(n, t, "en", None, None) for n, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None), rows[3], (5, "another text of id 5", None, None, None), (7000, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("ids", "form", "n", "output", "pairs", "restored", "n_a"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- SentencePiece


def numbers(parts):
    return np.frombuffer(b"".join(parts), "<u4").tolist()


def test_ids_and_texts_are_the_library_s(sf, spark):
    texts = [*ODD, *(r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect())]
    for text, parts in zip(texts, pieces.encoded(texts, MODEL), strict=True):
        want = LIBRARY.encode(text)
        assert numbers(parts) == want, text[:80]
        assert "".join(MODEL.decode(parts)) == LIBRARY.decode(want), text[:80]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("  abtheAin\n▁é日,.'0\x01"), max_size=60))
def test_any_text_is_encoded_as_by_the_library(text):
    assert numbers(next(pieces.encoded([text], MODEL))) == LIBRARY.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 262), st.integers(0, 31999)), max_size=20), st.integers(1, 5))
def test_any_ids_are_decoded_as_by_the_library(ids, size):
    parts = [np.array(ids[k : k + size], "<u4").tobytes() for k in range(0, len(ids), size)]
    assert "".join(MODEL.decode(parts)) == LIBRARY.decode(ids)


def test_long_texts_go_in_stretches(monkeypatch):
    texts = [" ".join(R.choice(["the", "", "ab", "über", "x\ny", "of"]) for _ in range(3000)), "z" * 5000, " " * 5000, "▁".join(["a", "b", ""] * 900)]
    monkeypatch.setattr(pieces, "STRETCH", 700)
    for text in texts:
        assert "".join(pieces.stretches(text, 700)) == text
        assert numbers(pieces.Encoder.encode_long(MODEL, text)) == LIBRARY.encode(text)
    assert len(list(pieces.stretches(texts[0], 700))) > 5


def test_forgotten_words_are_learnt_again(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    model = pieces.Encoder(PIECE)
    for _ in range(2):
        for text in ODD:
            assert numbers([model.encode([text])[0]]) == LIBRARY.encode(text)
    assert len(model.known) <= 200


def slow_merges(word, merger):
    """One merge at a time: the best pair, the leftmost of equals."""
    parts = list(word)
    while True:
        found = [(merger.rank[merger.symbol[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in merger.symbol and len(a + b) > 1]
        if not found:
            return parts
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_rounds_are_merges_one_at_a_time_whatever_the_ranks():
    for _ in range(60):
        names = {"".join(R.choice("abc") for _ in range(R.randint(2, 5))) for _ in range(25)} | set("abc")
        merger = pieces.Merger({p: -float(R.randint(0, 12)) for p in sorted(names)})  # ties, and longer pieces that come first
        names = list(merger.symbol)
        words = ["".join(R.choice("abc") for _ in range(R.randint(0, 40))) for _ in range(30)]
        merged, starts = merger.symbols(words)
        for word, at in zip(words, starts, strict=True):
            got = [names[x] for x in merged[at : at + len(word)] if x >= 0]
            assert got == slow_merges(word, merger)


def test_round_trip_rows(odd, none):
    rows = odd.collect()
    want = sorted((repr(r["doc_id"]), len(ids := LIBRARY.encode(r["text"] or "", add_eos=True)), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))) for r in rows)
    got = pieces.round_trip(odd, PIECE)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == want
    assert pieces.round_trip(none, PIECE).count() == 0


def test_encode_and_decode_of_tables(odd):
    ids = pieces.encode(odd, PIECE)
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode(ids, PIECE).collect())
    assert back == Counter((r["doc_id"], (r["text"] or "").replace("▁", " ")) for r in odd.collect())


# --- fill in the middle


def slow_units(text, kind):
    if kind == "code_points":
        return list(text)
    ends = "\n" if kind == "lines" else " \t\n\r\x0b\x0c"
    return re.findall(f"[^{ends}]*[{ends}]|[^{ends}]+", text)


@pytest.mark.parametrize("kind", fim.KINDS)
def test_places_of_units(kind):
    scanner = fim.Scanner(kind)
    for text in [*ODD, "a b\n c", "\n", "\n\n", "x\n", " x", "a  b "]:
        units, found = slow_units(text, kind), scanner.events(text)
        assert found.total == len(units)
        assert [found.place(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
        assert [m for _, m in found.sentinels] == re.findall("<[PSM]>", text)


def slow_fim(doc, text):
    n, h = len(text), [int(hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("kind", fim.KINDS)
def test_outputs_are_restored(odd, none, kind):
    made = fim.restored(fim.fill_in_middle(odd, kind), kind)
    got = made.collect()
    rows = odd.collect()
    assert Counter((r["doc_id"], r["restored"]) for r in got) == Counter((r["doc_id"], r["text"] or "") for r in rows)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    if kind == "code_points":
        want = Counter((r["doc_id"], *slow_fim(r["doc_id"], r["text"] or "")) for r in rows)
        assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) for r in got) == want
        assert all(r["middle_line"] == 1 + r["restored"][: r["prefix_units"]].count("\n") for r in got if r["form"] != "plain")
    assert fim.restored(fim.fill_in_middle(none, kind), kind).count() == 0


def test_an_output_of_another_form_is_refused():
    scanner = fim.Scanner()
    for output in ("<P>a<S>b", "x<P>a<S>b<M>c", "<S>a<P>b<M>c"):
        with pytest.raises(ValueError):
            fim.restore(output, "psm", scanner)


def test_fill_in_middle_against_sql(spark, sf):
    from tests.compare import connect, same

    same(queries.op11_fill_in_middle(spark, sf), queries.ORACLES["op11_fill_in_middle"], connect(sf))


# --- alignment


def slow_rank(places, at):
    return sum(p < at for p in places)


def test_bitsets():
    for n in (1, 63, 64, 65, 500):
        x, y = (sorted(R.sample(range(n), R.randint(1, n))) for _ in range(2))
        a, b = alignment.Bits.of(np.array(x), n), alignment.Bits.of(np.array(y), n)
        assert a.select().tolist() == x and (a & b).select().tolist() == sorted(set(x) & set(y))
        assert a.rank(np.arange(n)).tolist() == [slow_rank(x, k) for k in range(n)]


def slow_alignment(rows):
    """(n_a, n_b, cuts, links, digest) of each text by plain loops over both libraries' tokens, and the counts of links."""
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    of_a = {n: bytes(byte[c] for c in t) for t, n in json.load(open(BYTE, encoding="utf-8"))["model"]["vocab"].items()}
    of_b = lambda n: bytes([int(LIBRARY.id_to_piece(n)[3:5], 16)]) if LIBRARY.is_byte(n) else LIBRARY.id_to_piece(n).replace("▁", " ").encode()
    out, counts = [], Counter()
    for text in rows:
        want = (" " + (text or "")).encode()
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, LIBRARY.encode(text)) if text else ([], [])
        if not text or b"".join(map(of_a.get, a)) != want or b"".join(map(of_b, b)) != want:
            out.append((0, 0, [], ""))
            continue
        ends = []
        for ids, of in ((a, of_a.get), (b, of_b)):
            at, found = 0, {}
            for k, n in enumerate(ids):
                at += len(of(n))
                found[at] = k
            ends.append(found)
        links, groups, p, q = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0][cut], ends[1][cut]
            links.append((a[x], b[y]))
            groups.append(",".join(map(str, a[p : x + 1])) + "|" + ",".join(map(str, b[q : y + 1])))
            p, q = x + 1, y + 1
        out.append((len(a), len(b), links, sha(";".join(groups))))
        counts.update(links)
    return out, counts


@pytest.mark.parametrize("stretch", [1 << 20, 60])
def test_alignment_against_plain_loops(spark, odd, sf, monkeypatch, stretch):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 10000).alias("doc_id"), "text").limit(60))
    rows = docs.collect()
    found, counts = slow_alignment([r["text"] for r in rows])
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    if stretch == 60:  # stretches of texts: the operator's own parts, in this process
        pair = alignment._pair(BYTE, PIECE)
        monkeypatch.setattr(alignment, "STRETCH", stretch)
        monkeypatch.setattr(alignment.stretches, "__defaults__", (stretch,))
        assert any(len(list(alignment.stretches(r["text"] or ""))) > 2 for r in rows)
        for (n_a, n_b, links, digest), got in zip(found, alignment.aligned([r["text"] or "" for r in rows], pair), strict=True):
            assert got[:4] == (n_a, n_b, len(links), digest)
            assert dict(zip(got[4].tolist(), got[5].tolist(), strict=True)) == Counter((a << 32) | b for a, b in links)
        return
    want = Counter((r["doc_id"], n_a, n_b, len(links), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest) for r, (n_a, n_b, links, digest) in zip(rows, found, strict=True))
    got = alignment.align_documents(docs, BYTE, PIECE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert len(counts) <= alignment.most_pairs(alignment._pair(BYTE, PIECE))


def test_alignment_of_nothing(spark, none):
    assert alignment.align_documents(none, BYTE, PIECE).count() == 0
    empty = spark.createDataFrame([(1, ""), (2, None), (3, "a▁b")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align_documents(empty, BYTE, PIECE).collect())) == [(n, 0, 0, 0, 0, 0, 0, "") for n in (1, 2, 3)]


# --- quality: texts of many lines


def test_long_texts_score_as_whole_ones(spark, monkeypatch):
    from tallyspark.llm import quality

    rng = np.random.default_rng(1)
    model = quality.Model(rng.standard_normal(quality.WIDTH), rng.standard_normal((2, 2)))
    texts = ["\n".join(R.choice(["", "a b c", "The end.", "||| 12 34", "x" * 50, "é ű", " "]) for _ in range(R.randint(1, 60))) for _ in range(60)] + ["", "\n", "\n\n", "one"]
    for text in texts:
        whole = float(model.score([text])[0])
        assert all(abs(whole - model.score_long(text, most)) < 1e-12 for most in (1, 7, 40, 5000))
    monkeypatch.setattr(quality, "LINES_AT_ONCE", 20)  # in this process only: the same function that tasks run
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    assert all(abs(got[n] - float(model.score([t])[0])) < 1e-12 for n, t in enumerate(texts))


def test_memory_of_a_text_of_line_ends():
    import subprocess
    import sys

    code = "import resource, numpy as np; from tallyspark.llm import quality as q; m = q.Model(np.ones(q.WIDTH) / 50, np.eye(2)); m.score_long('\\n' * 3_000_000); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    used = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True).stdout
    assert int(used) < 400_000  # kilobytes, with all libraries


def test_recall_with_lists_left_out(spark):
    """More lists than are probed at the least: the share in force is what holds. Vectors in all directions, and in clusters."""
    from tallyspark.llm import ann

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 32))
    for points in (rng.standard_normal((9000, 32)), centres[rng.integers(0, 60, 9000)] + 0.3 * rng.standard_normal((9000, 32))):
        points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
        df = spark.createDataFrame([(n, p.tolist()) for n, p in enumerate(points)], "vec_id long, embedding array<float>").repartition(4)
        rows = ann.search(df, F.col("vec_id") % 20 == 0).select("query_id", "vec_id").collect()
        found = defaultdict(set)
        for r in rows:
            found[r["query_id"]].add(r["vec_id"])
        exact = points[::20].astype(np.float64) @ points.T.astype(np.float64)
        exact[np.arange(450), np.arange(450) * 20] = -np.inf
        best = np.argsort(-exact, axis=1)[:, :20]
        hits = sum(len(found[20 * n] & set(b.tolist())) for n, b in enumerate(best))
        assert round(np.sqrt(9000) / 2) > ann.PROBES and hits >= 0.9 * best.size, hits / best.size
