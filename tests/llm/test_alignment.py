import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from actlake.llm import alignment, byte_bpe, divergence  # noqa: E402
from actlake.llm.queries import OP12_SQL  # noqa: E402

RANKS, BYTES, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = [*"abstmdrevl'''   \n\t  09²!?-.ééあ日́ 　\U00010d4a\U0001f600ǅªº½\0▁", "'s", "'re", "'ll", " '", "<|endoftext|>", "<0x41>", "</s>", "the ", "ation"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(1500)]
    return [*made, None, "", "a" * 3000, " " * 300, "'s" * 50, "word " * 20_000, "x", " x"]


def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BYTES)
    model.encode_special_tokens = True
    return model


def test_ids_equal_the_libraries(texts):
    one, other = library(), byte_library()
    for text, (ids, at) in zip(texts, byte_bpe._each(byte_bpe.from_ranks(RANKS), pa.array(texts)), strict=True):
        wanted = one.encode_ordinary(text or "")
        assert ids.tolist() == wanted
        assert at.tolist() == np.cumsum([0, *(len(one.decode_single_token_bytes(i)) for i in wanted)])[:-1].tolist()
    for text, (ids, _) in zip(texts, byte_bpe._each(byte_bpe.from_json(BYTES), pa.array(texts)), strict=True):
        assert ids.tolist() == other.encode(text or "", add_special_tokens=False).ids


def test_the_scan_equals_a_walk_through_the_states():
    machine, rng = byte_bpe.automaton(), np.random.default_rng(2)
    symbols = rng.integers(0, 16, 5000).astype(np.uint8)
    state, wanted = byte_bpe.ENDED, []
    for x in symbols.tolist():
        opens = byte_bpe._OPENS[x % 8]
        state = opens if x >= byte_bpe.FIRST else byte_bpe._GOES_ON.get((state, x), opens)
        wanted.append(state)
    for block in (2, 3, 64, 10_000):
        assert byte_bpe.states(symbols, block).tolist() == wanted
    assert len(machine.products) < 1 << 16


def test_both_ways_of_merging_and_a_small_table_give_the_same(texts):
    encoder = byte_bpe.from_ranks(RANKS)
    words = [t.encode() for t in texts if t and len(t) < 80]
    ids, counts = byte_bpe.merge_short(encoder.byte_ids[np.frombuffer(b"".join(words), np.uint8)], np.array([len(w) for w in words]), encoder.merges)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, w in enumerate(words):
        assert ids[at[k] : at[k + 1]].tolist() == byte_bpe.merge_one(encoder.byte_ids[np.frombuffer(w, np.uint8)].tolist(), encoder.merges)
    small = byte_bpe.Encoder(encoder.ids, encoder.merges, encoder.classes, True, table_bytes=1)
    for (x, _), (y, _) in zip(byte_bpe._each(small, pa.array(texts)), byte_bpe._each(encoder, pa.array(texts)), strict=True):
        assert x.tolist() == y.tolist()


def test_digests_round_trip_and_odd_rows(odd, docs, texts):
    one = library()
    for r in byte_bpe.digests(docs(list(enumerate(texts))), RANKS).collect():
        ids = one.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    encoded = byte_bpe.encode(docs(list(enumerate(texts))), RANKS)
    assert {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decode(encoded, RANKS).collect()} == {k: t or "" for k, t in enumerate(texts)}
    found = byte_bpe.digests(odd, RANKS).collect()
    assert len(found) == odd.count() and [r.n_tokens for r in found if r.doc_id in (1, 2)] == [0, 0]
    assert byte_bpe.digests(docs([]), RANKS).count() == 0


def plain_alignment(rows):
    """Tokens, groups and links by comparing every A token with every B token."""
    import sentencepiece

    model_a, model_b = byte_library(), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alphabet, found, counts = byte_bpe.byte_alphabet(), [], Counter()
    for doc_id, text in rows:
        a, b = [], []
        if text:
            ids_a, ids_b = model_a.encode(" " + text, add_special_tokens=False).ids, model_b.encode(text)
            bytes_a = [bytes(alphabet[c] for c in model_a.id_to_token(i)) for i in ids_a]
            bytes_b = [
                bytes([int(model_b.id_to_piece(i)[3:5], 16)]) if model_b.is_byte(i) else model_b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b
            ]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                for out, ids, parts in ((a, ids_a, bytes_a), (b, ids_b, bytes_b)):
                    at = 0
                    for i, part in zip(ids, parts, strict=True):
                        out.append((i, at, at + len(part)))
                        at += len(part)
        both = {x[2] for x in a} & {x[2] for x in b}
        groups, first = [], 0
        for end in sorted(both):
            side = lambda tokens: ",".join(str(i) for i, s, _ in tokens if first <= s < end)  # noqa: B023, E731
            groups.append(f"{side(a)}|{side(b)}")
            first = end
        links, low = [], 0
        for i, s, e in a:
            while low < len(b) and b[low][2] <= s:
                low += 1
            k = low
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        counts.update(set(links))
        found.append((doc_id, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return {
        (d, na, nb, len(g), len(x), sum(counts[p] == best[p[0]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, na, nb, g, x in found
    }


def test_alignment_equals_a_plain_one(odd, docs, texts, monkeypatch):
    rows = [*enumerate(texts), *((5000 + k, t) for k, t in enumerate(texts[:40]))]
    wanted = plain_alignment(rows)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = alignment.align(docs(rows), BYTES, PIECES).select(names).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(rows)
    # the other way of the join, windows of a few events and steps of a few rows
    monkeypatch.setattr(alignment, "WINDOW_BYTES", 64)
    monkeypatch.setattr(alignment, "STEP_BYTES", 100)
    few = alignment.align(docs(rows), BYTES, PIECES, broadcast_pairs=10).select(names)
    assert {tuple(r) for r in few.collect()} == wanted
    assert {r.n_a for r in alignment.align(odd, BYTES, PIECES).where("doc_id in (1, 2)").collect()} == {0}
    assert alignment.align(odd, BYTES, PIECES).count() == odd.count() and alignment.align(docs([]), BYTES, PIECES).count() == 0
    total = alignment.links(docs(rows[:300]), BYTES, PIECES).groupBy("doc_id").sum("times").collect()
    assert {(r[0], r[1]) for r in total} == {(w[0], w[4]) for w in wanted if w[0] < 300 and w[4]}


def test_the_sweep_goes_on_over_rows_and_steps(texts):
    """The state at the end of a step is what the next one needs, wherever the steps end."""
    strings = alignment._strings(BYTES, PIECES)
    text = "théorie of the ation, 12 'll " * 50 + "x" * 500
    a, b = byte_library().encode(" " + text).ids, [int(i) for i in next(alignment._ids_b(pa.array([text]), PIECES))[0]]
    whole = alignment._Document(1, 1)
    sides = tuple(np.array(x, np.uint16) for x in (a, b))
    alignment._sweep([whole], sides, tuple(np.zeros(len(x), np.int64) for x in sides), strings)
    rng = random.Random(3)
    stops = [s.ends(x) for s, x in zip(strings, sides, strict=True)]
    for _ in range(20):
        cuts = sorted(rng.sample(range(1, len(text)), 5))
        parts = [np.split(x, np.searchsorted(e, cuts, "right")) for x, e in zip(sides, stops, strict=True)]
        d = alignment._Document(1, 1)
        for new in zip(*parts, strict=True):
            ids = tuple(np.concatenate([d.open[k], new[k]]).astype(np.uint16) for k in (0, 1))
            d.open = [x[:0] for x in ids]
            alignment._sweep([d], ids, tuple(np.zeros(len(x), np.int64) for x in ids), strings)
        row, pairs, times = d.result()
        wanted = whole.result()
        assert row == wanted[0] and pairs.tolist() == wanted[1].tolist() and times.tolist() == wanted[2].tolist()


def test_the_audit_equals_its_sql_and_plain_counts(spark, odd, docs):
    rng = random.Random(4)
    words = ["été", "Été", "alpha", "beta", "b2b", "x'y", "日本", "zéro", "Alpha"]
    rows = [(k, " ".join(rng.choices(words, range(1, 10), k=rng.randrange(12))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None, "é"]), 0) for k in range(400)]
    rows += [(900, None, "de", "only", 0), (901, "", "de", "other", 0), (902, "word " * 5000, "en", "s1", 0), *[rows[0]] * 35]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rank int")
    found = divergence.audit(table)
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(["doc_id", "text", "lang", "source"], r, strict=False)) for r in rows]))
    names = ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in found.select(names).collect()} == set(con.execute(f"SELECT {', '.join(names)} FROM ({OP12_SQL})").fetchall())
    # one share worked out by hand
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    terms = [(r[3], re.findall(divergence.TERM, r[1].translate(lower))) for r in rows if r[2] == "en"]
    v = {t for t, n in Counter(t for _, found in terms for t in set(found)).items() if n >= 30}
    in_group = Counter(t for source, found in terms for t in found if source == "s2" and t in v)
    p = {t: 1 + 1_000_000_000 * (in_group[t] + 5) // (sum(in_group.values()) + 5 * len(v)) for t in v}
    _, each = divergence.shares(table)
    assert {r.term: r.p for r in each.where("lang = 'en' and source = 's2'").collect()} == p
    assert divergence.audit(odd).count() == 0 and divergence.audit(docs([])).count() == 0
