"""Operators 4, 6 and 8 against the libraries themselves."""

import base64
import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import bpe, packing, queries, token_counts
from marlstone.llm import spans as S

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ALPHABET = ["a", "B", "é", "中", "1", "²", " ", "  ", "\n", "\t", "　", "'", "'s", "'ll", "'re", "!", "😀", "'t", " '", "́", "\x85", "\xa0", "\x1c", "d"]


def noise(n, size=25, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


def library(name):
    return Tokenizer.from_file(P.path(name))


def own_tiktoken():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("find, pattern", [(S.byte_level_pretokens, P.PATTERN), (S.lone_pretokens, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")])
def test_pretokens_are_the_pattern_s_matches(find, pattern):
    texts = [t.replace("\x1c", "") for t in noise(4000)] + ["", None]
    whole = regex.compile(pattern)
    for piece in S.slices(pa.array(texts), 2000):
        starts, ends = find(piece)
        raw, docs = piece.data.tobytes(), piece.doc_of(starts)
        got = defaultdict(list)
        for d, a, b in zip(docs.tolist(), starts.tolist(), ends.tolist(), strict=True):
            got[d].append(raw[a:b].decode())
        for i in range(piece.n):
            assert got[i] == whole.findall(texts[piece.first + i] or "")


def test_span_table_finds_what_it_holds():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    table = S.SpanTable(len(keys))
    table.add(keys, np.arange(len(keys), dtype=np.int32))
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def thue_morse(first, second, size=1024):
    """A word and its complement, which polynomial hashes modulo a power of two confuse."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join((first, second)[b] for b in bits), "".join((second, first)[b] for b in bits)


def test_hashes_tell_patterned_words_apart():
    words = [w for size in (64, 1024, 2048, 4096) for w in thue_morse("a", "b", size)] + ["a", "a\0", "a" * 8, "a" * 9, "a" * 16, "b" * 8 + "a" * 8, "a" * 8 + "b" * 8]
    (piece,) = S.slices(pa.array(words))
    hashes, checks = piece.checked_hashes(piece.offsets[:-1], piece.offsets[1:])
    assert len(set(hashes.tolist())) == len(set(checks.tolist())) == len(words)
    (again,) = S.slices(pa.array(["x" + "".join(words)]))  # the same spans elsewhere
    assert (again.hashes(piece.offsets[:-1] + 1, piece.offsets[1:] + 1) == hashes).all()


def test_equal_hashes_are_told_apart_by_their_checks(monkeypatch):
    honest = S.Slice.checked_hashes
    monkeypatch.setattr(S.Slice, "checked_hashes", lambda self, a, b: (honest(self, a, b)[0] & np.uint64(7 << 20), honest(self, a, b)[1]))
    encoder, expected = bpe.SpanEncoder(bpe.rank_file_model(P.path("byte_bpe_50k.tiktoken")), limit=300), own_tiktoken()
    texts = noise(100)
    for piece in S.slices(pa.array(texts), 1000):
        ids, sizes = encoder.encode(piece, *S.byte_level_pretokens(piece))
        for i, own in enumerate(np.split(ids, np.cumsum(sizes)[:-1])):
            assert own.tolist() == expected.encode_ordinary(texts[piece.first + i])


def test_patterned_words_keep_their_ids(spark):
    texts = [f"{x} {y}" for x, y in (thue_morse("a", "b"), thue_morse("ab", "ba", 512))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model, own = bpe.rank_file_model(P.path("byte_bpe_50k.tiktoken")), own_tiktoken()
    for r in bpe.decode(bpe.encode(docs, model), model).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded).decode() == texts[r.doc_id]
    check_packing(queries.packed_documents(docs).collect(), dict(enumerate(texts)))
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, file.read()).collect()}
    expected = library("word_bpe_49k.json")
    assert counts == {i: len(expected.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_two_models_of_one_size_in_one_worker(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat")], "doc_id long, text string").coalesce(1)
    model = bpe.rank_file_model(P.path("byte_bpe_50k.tiktoken"))
    # The same merges in number, none of which ever applies.
    i = np.arange(len(model.pair_keys), dtype=np.uint64)
    other = bpe.BpeModel("other", (i % np.uint64(200) + np.uint64(50000)) << np.uint64(32) | i // np.uint64(200), model.pair_ranks, model.merged, model.first, model.last, model.token_bytes)
    counts = [bpe.encode(docs, m).first().n_tokens for m in (model, other, model)]
    assert counts == [6, 22, 6]
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        text = file.read()
    whole = bpe.merges_file_model(text, token_counts.WORD_END)
    counters = [token_counts.worker_counter(m, token_counts.prove_whole_tokens(m)) for m in (whole, other)]
    assert counters[0] is not counters[1] and token_counts.worker_counter(other, []) is counters[1]


def brute_merges(model, word):
    ranks = dict(zip(model.pair_keys.tolist(), model.pair_ranks.tolist(), strict=True))
    row = [int(model.first[b]) for b in word[:-1]] + [int(model.last[word[-1]])]
    while len(row) > 1:
        rank, at = min((ranks.get(a << 32 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(row, row[1:], strict=False)))
        if rank == 1 << 40:
            break
        row[at : at + 2] = [int(model.merged[rank])]
    return row


def test_long_rows_merge_as_leftmost_least_does(monkeypatch):
    model = bpe.rank_file_model(P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    words = [bytes(rng.choice(b"aabteh") for _ in range(rng.randint(2, 90))) for _ in range(60)]
    # A model whose merge of 'bc' makes a pair of lower rank than its own.
    byte = np.arange(256, dtype=np.int32)
    odd = bpe.BpeModel("odd", np.array([97 << 32 | 256, 98 << 32 | 99, 256 << 32 | 97], np.uint64), np.arange(3, dtype=np.int32), np.array([257, 256, 258], np.int32), byte, byte, (b"",) * 259)
    mixed = [bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 60))) for _ in range(60)]
    for widest in (bpe.WIDEST, 2):
        monkeypatch.setattr(bpe, "WIDEST", widest)
        for m, some in ((model, words), (odd, mixed)):
            ids, sizes = bpe.MatrixBpe(m).merge(np.frombuffer(b"".join(some), np.uint8), np.array([len(w) for w in some]))
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [brute_merges(m, w) for w in some]


def test_encoder_matches_tiktoken_with_a_tiny_table():
    encoder, expected = bpe.SpanEncoder(bpe.rank_file_model(P.path("byte_bpe_50k.tiktoken")), limit=300), own_tiktoken()
    texts = noise(2000) + ["a" * 3000, "ab" * 2000 + "!" * 333, "中文" * 300, None]
    for piece in S.slices(pa.array(texts), 4000):
        ids, sizes = encoder.encode(piece, *S.byte_level_pretokens(piece))
        for i, own in enumerate(np.split(ids, np.cumsum(sizes)[:-1])):
            assert own.tolist() == expected.encode_ordinary(texts[piece.first + i] or "")


def test_op8(spark, odd_docs, no_docs, sf_dir):
    model, expected = bpe.rank_file_model(P.path("byte_bpe_50k.tiktoken")), own_tiktoken()
    out = bpe.decode(bpe.encode(odd_docs, model), model).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(out) == 8
    for r in out:
        ids = expected.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and bytes(r.decoded).decode() == texts[r.doc_id]
    assert bpe.encode(no_docs, model).count() == 0
    rows = queries.op8_byte_bpe(spark, sf_dir).collect()
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows:
        ids = np.array(expected.encode_ordinary(documents[r.doc_id]), "<u4").tobytes()
        assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(documents[r.doc_id].encode()).hexdigest())


def test_whole_tokens_encode_alone(spark):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        text = file.read()
    whole = token_counts.prove_whole_tokens(bpe.merges_file_model(text, token_counts.WORD_END))
    plain = [t.decode() for t in whole if t.isascii() and t.isalpha() and t.islower()]
    got = library("word_bpe_49k.json").encode_batch(plain[:3000], add_special_tokens=False)
    assert len(plain) > 10000 and all(len(e.ids) == 1 for e in got)


def test_op4(spark, odd_docs, no_docs, sf_dir):
    expected, rows = library("word_bpe_49k.json"), []
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        text = file.read()
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate([*noise(300), "ΑΣ ΟΔΟΣ Σ", "İstanbul", "Café", "<|startoftext|>'s x"])], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = token_counts.count_tokens(docs, text).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n = len(expected.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 2048), texts[r.doc_id]
    assert token_counts.count_tokens(no_docs, text).count() == 0
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_token_counts(spark, sf_dir).collect():
        assert r.n_tokens == len(expected.encode(documents[r.doc_id], add_special_tokens=False).ids)


def check_packing(out, texts, capacity=1024):
    expected = library("byte_bpe_50k.json")
    ids = {d: [*expected.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    for r in out:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        assert r.length == capacity or r.piece == 0
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for rows in places.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(len(rows))] and sum(n for _, n in rows) <= capacity
    return ids, places


def test_op6(spark, odd_docs, no_docs, sf_dir):
    out = queries.packed_documents(odd_docs).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    ids, _ = check_packing(out, texts)
    assert sum(r.length for r in out) == sum(map(len, ids.values())) + len(ids[6])
    assert queries.packed_documents(no_docs).count() == 0
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op6_packing(spark, sf_dir).collect()
    ids, places = check_packing(out, documents)
    assert sum(r.length for r in out) == sum(map(len, ids.values()))
    bound = packing.lower_bound(np.bincount([r.length for r in out], minlength=1025), 1024)
    assert bound <= len(places) <= bound + 4


def test_exchange_reduces_bins(spark):
    cut = spark.range(4000).select("id", (1 + F.pmod(F.xxhash64("id"), F.lit(700))).alias("length"))
    lengths = [r.length for r in cut.collect()]
    bound = packing.lower_bound(np.bincount(lengths, minlength=1025), 1024)
    alone = packing.pack(cut, part_pieces=7, max_exchanges=0).select("sequence_id").distinct().count()
    exchanged = packing.pack(cut, part_pieces=7).select("sequence_id").distinct().count()
    assert bound <= exchanged < alone


def test_lower_bound_is_exact_for_large_items():
    counts = np.zeros(11, np.int64)
    counts[6], counts[5] = 4, 3
    assert packing.lower_bound(counts, 10) == 6 and packing.best_fit_decreasing(np.array([6] * 4 + [5] * 3), 10)[2] == 6


def test_op6_exchange_on_documents(spark, sf_dir):
    cut = queries.op6_packing(spark, sf_dir).select("doc_id", "piece", "length")
    bound = packing.lower_bound(np.bincount([r.length for r in cut.collect()], minlength=1025), 1024)
    placed = [packing.pack(cut, part_pieces=60, max_exchanges=most).collect() for most in (0, None)]
    alone, exchanged = (len({r.sequence_id for r in rows}) for rows in placed)
    assert bound <= exchanged <= alone
    for rows in placed:
        assert len(rows) == cut.count()
        ends = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 1024
