import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docloom.llm.common import shared_path, tokenizer_path
from docloom.llm.packing import pack_documents, pack_pieces, token_pieces
from docloom.llm.sum_of_squares import pack
from docloom.llm.token_counts import TokenCounter, count_tokens
from docloom.llm.token_files import id_width, part_bounds, read_token_files, spread_slices, train_dictionary, write_token_files
from docloom.llm.word_encoder import WordEncoder

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
LETTERS = "aAbBzZ.,'’<|>\x01\x1c\x85\xa0  ́̌J1é É İ̇ßµ\n\t\x0b中😀-_s١²ﬁ"
TEXTS = ["", " ", "Hello, World!", "don't DON'T it's", "<|endoftext|>", "a<|endoftext|><|startoftext|>b", "<|STARTOFTEXT|>", "of,the.end", "ǰ J̌ é", "x" * 3000, "the cat " * 4000, "  \n\n x", "'s 't a's. b',"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    return TEXTS + ["".join(r.choice(LETTERS) for _ in range(r.randrange(40))) for _ in range(4000)]


def library(name):
    return Tokenizer.from_file(tokenizer_path(name))


def test_word_encoder_is_the_library(texts):
    lib = library(WORDS)
    for keep in (10, 400_000):
        encoder = WordEncoder(WORDS, keep)
        for i in range(0, len(texts), 50):
            ids, bounds = encoder.encode(pa.array([None, *texts[i : i + 50]]).slice(1))
            for text, a, b in zip(texts[i : i + 50], bounds, bounds[1:]):
                assert ids[a:b].tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_encoder_on_words_of_all_lengths():
    r = random.Random(4)
    lib, encoder = library(WORDS), WordEncoder(WORDS)
    made = ["".join(r.choice("eeeaationrsl" + "éüñßÀÉx") for _ in range(r.randrange(1, 90))) + r.choice(["", "", ".", "...", "),", "!?"]) for _ in range(6000)]
    made += ["a" * n for n in range(1, 80)] + ["ab" * n for n in range(1, 40)] + ["the", "The", "THE", "the.", ".", "***", "the's", "l'a"]
    ids, bounds = encoder.encode(pa.array(made), 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*e.ids, 1] for e in lib.encode_batch(made, add_special_tokens=False)]
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == [0] and encoder.encode(pa.array([None, ""]), 1)[0].tolist() == [1, 1]


def test_another_tokenizer_goes_to_the_library(texts):
    """One whose format the short way doesn't know: whole texts, white space and all."""
    lib, encoder = library(BYTES), WordEncoder(BYTES)
    assert encoder.merger is None
    ids, bounds = encoder.encode(pa.array(texts[:200]))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in lib.encode_batch(texts[:200], add_special_tokens=False)]


def test_token_counter_is_the_library(texts):
    lib = library(BYTES)
    for keep in (10, 250_000):
        counter = TokenCounter(BYTES, keep)
        for i in range(0, len(texts), 50):
            for text, n in zip(texts[i : i + 50], counter.batch(texts[i : i + 50])):
                assert n == len(lib.encode(text, add_special_tokens=False).ids), repr(text)


def test_every_shortcut_is_one_token():
    lib, counter = library(BYTES), TokenCounter(BYTES)
    assert len(counter.single) > 40_000
    some = sorted(counter.single)[::97]
    assert all(len(e.ids) == 1 for e in lib.encode_batch(some, add_special_tokens=False))


def test_count_tokens(spark):
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (None, "é😀"), (3, "word " * 2000)]
    out = sorted(map(tuple, count_tokens(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int"), BYTES).collect()), key=repr)
    lib = library(BYTES)
    want = [(d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows]
    assert out == sorted(want, key=repr)
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTES).collect() == []


def check_packed(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def first_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(capacity - n)
        else:
            room[at] -= n
    return len(room)


def test_pack_is_valid_and_tight():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 400, 3000)
    bins, offsets, made = pack(lengths, 1000)
    for b in range(made):
        own = sorted(zip(offsets[bins == b], lengths[bins == b]))
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 1000
    assert made <= -(-lengths.sum() // 1000) + 1
    assert pack(np.array([], dtype=np.int64), 10)[2] == 0 and pack(np.array([10, 10]), 10)[2] == 2


def test_pack_follows_the_sum_of_squares():
    """Each choice is checked against the sum itself."""
    lengths = np.random.default_rng(5).integers(1, 30, 200)
    bins, _, _ = pack(lengths, 64)
    gaps = {}
    for i in np.argsort(-lengths, kind="stable"):
        size = lengths[i]

        def after(b):
            trial = dict(gaps)
            trial[b] = trial.get(b, 64) - size
            left = [g for g in trial.values() if g]
            return sum(left.count(g) ** 2 for g in set(left))

        open_ones = [b for b, g in gaps.items() if g >= size]
        if open_ones:
            best = min(after(b) for b in open_ones)
            assert bins[i] in open_ones and after(bins[i]) == best
            assert gaps[bins[i]] == min(gaps[b] for b in open_ones if after(b) == best)
        else:
            assert bins[i] not in gaps
        gaps[bins[i]] = gaps.get(bins[i], 64) - size


def test_pack_documents(spark):
    lib = library(WORDS)
    rows = [(i, "alpha beta gamma delta " * (i * 7 % 90)) for i in range(60)] + [(100, None), (101, ""), (100, None), (None, "x"), (102, "one two three " * 1000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, piece string")
    out = pack_documents(df, WORDS, capacity=256, group_pieces=40).collect()
    want = []
    for d, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(d, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(want, key=repr)
    # Pieces of few and large sizes leave gaps in any packing: each group is held against first fit, longest first.
    groups = -(-len(want) // 40)
    assert check_packed(out, 256) <= first_fit([w[3] for w in want], 256) + 2 * groups
    assert pack_pieces(token_pieces(spark.createDataFrame([], "doc_id long, text string"), WORDS)).collect() == []


def test_pieces_carry_ids(spark):
    row = token_pieces(spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string"), WORDS, with_ids=True).first()
    assert row.ids == [*library(WORDS).encode("alpha beta", add_special_tokens=False).ids, 1]


def test_token_files_round_trip(spark):
    lib = library(WORDS)
    rows = [(i * 3 % 101, f"document {i} says " + "the same thing again " * (i % 30)) for i in range(101)] + [(500, None), (501, ""), (7, "again"), (None, "no id"), (600, "very long text " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(5)
    path = write_token_files(df, shared_path(spark, "t"), WORDS, docs_per_partition=20)
    encoded = [(d, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")) for d, t in rows]
    encoded.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    starts = np.cumsum([0, *(len(i) for _, i in encoded)]).tolist()
    want = [(d, s, len(i), zlib.crc32(i.tobytes())) for (d, i), s in zip(encoded, starts)]
    assert sorted(map(tuple, read_token_files(spark, path).collect()), key=lambda r: r[1]) == want
    some = read_token_files(spark, path, with_ids=True, doc_ids=[30, 600]).collect()
    assert {r.doc_id: r.ids for r in some} == {d: i.tolist() for d, i in encoded if d in (30, 600)}


def test_token_files_of_few_or_no_documents(spark):
    for rows in ([], [(1, "just one")]):
        path = write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), shared_path(spark, "t"), WORDS)
        assert [r.doc_id for r in read_token_files(spark, path).collect()] == [d for d, _ in rows]
    assert train_dictionary([]) == b"" and train_dictionary([b"ab"]) == b"ab"


def test_another_dictionary_is_refused(spark):
    path = write_token_files(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), shared_path(spark, "t"), WORDS)
    other = write_token_files(spark.createDataFrame([(1, "x y z w " * 50)], "doc_id long, text string"), shared_path(spark, "t"), WORDS)
    mixed = shared_path(spark, "t")
    spark.read.parquet(f"{path}/blocks").write.parquet(f"{mixed}/blocks")
    spark.read.parquet(f"{other}/dictionary").write.parquet(f"{mixed}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        read_token_files(spark, mixed).collect()


def wide_tokenizer(folder):
    """A word tokenizer of 70,000 words, so that ids outgrow 16 bits."""
    from tokenizers import models, pre_tokenizers

    made = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(folder / "wide.json")
    made.save(path)
    return path


def test_ids_beyond_16_bits_are_stored_whole(spark, tmp_path):
    path = wide_tokenizer(tmp_path)
    assert id_width(path, 1) == 4 and id_width(WORDS, 1) == 2 and id_width(WORDS, 1 << 16) == 4
    df = spark.createDataFrame([(1, "w69999 w5 w65536"), (2, None)], "doc_id int, text string")
    store = write_token_files(df, shared_path(spark, "t"), path)
    assert {r.doc_id: r.ids for r in read_token_files(spark, store, with_ids=True).collect()} == {1: [69999, 5, 65536, 1], 2: [1]}
    with pytest.raises(TypeError):
        write_token_files(spark.createDataFrame([("a", "b")], "doc_id string, text string"), shared_path(spark, "t"), WORDS)


def test_sample_slices_lie_all_over():
    data = bytes(range(256)) * 400
    some = spread_slices(data, 800, 8)
    assert len(some) == 800 and some[:100] == data[:100] and some[-100:] == data[-100:] and spread_slices(b"abc") == b"abc"


def test_parts_are_even_with_a_hot_doc_id(spark):
    rows = [(i,) for i in range(3000)] + [(1500,)] * 1500 + [(None,)]
    bounds = part_bounds(spark.createDataFrame(rows, "doc_id long"), len(rows), 9)
    sizes = np.bincount(np.searchsorted(bounds, [d for (d,) in rows if d is not None]), minlength=len(bounds) + 1)
    assert sizes.max() < 2600 and sorted(sizes)[-2] < 1000
    assert len(part_bounds(spark.createDataFrame([], "doc_id long"), 0, 9)) == 0
