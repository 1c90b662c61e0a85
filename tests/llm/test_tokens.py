import bisect
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from actlake.llm import packing, pieces, token_counts  # noqa: E402

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, " ", "  ", "\n", "a\n b\n\nc ", " lead", "trail  ", "▁x▁", "é𝒳\0b\t\tq", "日本語 テスト 12 3a", "</s> <s> <unk>", "a" * 3000, "x\r\n y  z   w",
    "don't DON'T a'sb !'s it's' 'sx", "École J̌ İstanbul ΣΑΣ", "<|endoftext|> <|x|>", "ABC!def??9.8", "ß SS ſ ﬁ ²½", "q　r s", "the the THE, the.",
]


def test_pieces_equal_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text, (n, ids, said) in zip(TEXTS, pieces.encode_column(pa.array(TEXTS), PIECES), strict=True):
        wanted = [*model.encode(text or ""), 2]
        assert (n, ids.decode(), said.decode()) == (len(wanted), " ".join(map(str, wanted)), model.decode(wanted))


def test_pieces_of_odd_rows(odd, docs):
    found = pieces.digests(odd, PIECES).collect()
    assert len(found) == odd.count() and {r.n_tokens for r in found if r.doc_id in (1, 2)} == {1}
    whole = pieces.encode(odd.where("doc_id = 6"), PIECES).first()
    assert whole.decoded == "uma só" and whole.ids[-1] == 2
    assert pieces.digests(docs([]), PIECES).count() == 0


def test_a_small_table_changes_nothing():
    table = pieces._table(PIECES)
    wanted, rows = list(pieces.encode_column(pa.array(TEXTS), PIECES)), table.rows
    try:
        table.rows, table.known = 3, {}
        assert list(pieces.encode_column(pa.array(TEXTS * 2), PIECES)) == wanted * 2
    finally:
        table.rows = rows


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    for text, ids in zip(TEXTS, packing.token_ids(pa.array(TEXTS), WORDS), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == model.encode(text or "", add_special_tokens=False).ids


def test_sequences_hold_every_piece_once(odd, docs):
    ids = dict(zip(range(len(TEXTS)), packing.token_ids(pa.array(TEXTS), WORDS), strict=True))
    found = packing.pack_documents(docs(list(enumerate(TEXTS))), WORDS, size=16, shard_rows=10).collect()
    for i, raw in ids.items():
        raw += np.array([1], np.uint32).tobytes()
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(raw) // 4, 16)) and sum(r.length for r in own) == len(raw) // 4
        assert all(r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) for r in own)
    for s in {r.sequence_id for r in found}:
        end = 0
        for r in sorted((r for r in found if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 16
    assert packing.pack_documents(odd, WORDS).where("doc_id = 6").count() == 2 and packing.pack_documents(docs([]), WORDS).count() == 0


def test_large_ids_beside_a_null_one(docs):
    big = [(1 << 60) + 1, (1 << 60) + 3, None, None, 5]
    found = packing.pack_documents(docs([(i, f"text {k}") for k, i in enumerate(big)]), WORDS).collect()
    assert sorted(r.doc_id or 0 for r in found) == sorted(i or 0 for i in big) and len({r.sequence_id for r in found}) == 1


def plain_places(lengths, size):
    """The rule over all open sequences: longest first, to where the sum of squared counts by gap is smallest, then the smallest gap."""
    gaps, places = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        best = None
        for k, gap in enumerate(gaps):
            if gap >= lengths[i]:
                after = [*gaps[:k], gap - lengths[i], *gaps[k + 1 :]]
                cost = sum(after.count(g) ** 2 for g in set(after) if g)
                if best is None or (cost, gap) < best[:2]:
                    best = (cost, gap, k)
        if best is None:
            gaps.append(size)
            best = (0, size, len(gaps) - 1)
        places[i] = best[1]
        gaps[best[2]] -= lengths[i]
    return gaps, places


def test_places_equal_a_plain_rule():
    for seed in range(5):
        lengths = np.random.default_rng(seed).integers(1, 33, 60)
        gaps, places = plain_places(lengths.tolist(), 32)
        where, offset = packing.sum_of_squares(lengths, 32)
        filled = np.bincount(where, lengths).astype(int)
        assert sorted(32 - filled) == sorted(gaps) and [32 - o for o in offset.tolist()] == [places[i] for i in range(60)]


def test_packing_is_about_as_tight_as_it_can_be():
    lengths = np.random.default_rng(0).integers(1, 4097, 3000)
    gaps, opened = [], 0
    for n in sorted(lengths.tolist(), reverse=True):  # best fit decreasing
        i = bisect.bisect_left(gaps, n)
        gap = gaps.pop(i) if i < len(gaps) else 4096
        opened += gap == 4096
        if gap > n:
            bisect.insort(gaps, gap - n)
    where, _ = packing.sum_of_squares(lengths)
    assert where.max() + 1 <= 1.005 * opened


def test_counts_equal_a_plain_recurrence(odd, docs):
    vocabulary = token_counts._table(PIECES).work.__self__
    words = ["▁the", "▁theantan", "▁é𝒳", "▁" + "ab" * 15, "▁▁x", "\n", "テスト", "▁a", "▁ab", "▁abc"]
    counts, scores = vocabulary.trie(words)
    assert [(int(c), float(s)) for c, s in zip(counts, scores, strict=True)] == [vocabulary.one(w) for w in words]
    found = token_counts.count_tokens(docs(list(enumerate(TEXTS))), PIECES).collect()
    for r in found:
        assert r.n_tokens == (vocabulary.one("▁" + (TEXTS[r.doc_id] or "").replace(" ", "▁"))[0] if TEXTS[r.doc_id] else 0)
    assert token_counts.count_tokens(odd, PIECES).count() == odd.count() and token_counts.count_tokens(docs([]), PIECES).count() == 0


def test_counts_equal_the_librarys_lattice():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    vocabulary = token_counts._table(PIECES).work.__self__
    for word in ("the", "theantan", "ther", "reonation", "stthible"):
        best = model.nbest_encode_as_pieces(word, 3)[0]
        assert vocabulary.one("▁" + word)[0] == len(best)
