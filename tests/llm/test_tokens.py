"""Token operators against the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from forgelens.llm import tokens
from forgelens.llm.packing import binary_pieces, pack_power_of_two, slices
from forgelens.llm.store import BATCH_ROWS, shared_path, small_batches
from forgelens.llm.token_counts import token_counts
from forgelens.llm.token_files import read_token_files, with_ids_crc32, write_token_files
from forgelens.llm.tokens import _IRREGULAR, BatchEncoder, irregular, split_safely

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
SCHEMA = "doc_id bigint, text string, n_tokens string, length string, part string, ids string"
TEXTS = [
    None, "", " ", "\n", "a", "Hello, world.\nNext line's end", "a  b   c\t\td \n\n e", "  lead", "trail  ",
    "x.,y..z , w . v", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>,<|endoftext|>.", "can't we'll 'S ''s",
    "1,000.50 3.14.15", "éà ñ ΑΣ Σ. ΟΔΟΣ, x", "é ́a ́", "日本語 テスト。 です", "\x01a \x01,",
    "a b  c　 d", "\x1c \x1d a", "word " * 5000, "z" * 20000, "😀 😀,😀.", "a_b,c_d. _,", "½, Ⅳ. x²,", "<|ENDOFTEXT|> A", "HELLO There, İx. <|Endoftext|>",
]


def random_texts(n):
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "Σ", "σ", "1", "²", "_", " ", " ", " ", "\n", "\t", ",", ".", "'", "s", "<|endoftext|>", "|",
                "́", " ", "\x1f", "\x01", "日", "ǅ", "ͅ", "İ", "ß", "ﬁ", "!", "‍"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("path", FILES)
def test_encoder_equals_library_on_whole_texts(path):
    texts = TEXTS + random_texts(20000)
    library = Tokenizer.from_file(path)
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    ours = BatchEncoder(path, max_pieces=2000)
    assert ours.counts(texts).tolist() == [len(e) for e in expected]
    ids, counts = ours.encode(texts)
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == expected


def test_regular_texts_are_cut_where_it_is_safe():
    texts = [t or "" for t in TEXTS] + random_texts(20000)
    odd = irregular([t.encode() for t in texts])
    assert not odd[4] and not odd[5] and odd[6]
    assert all(o or not _IRREGULAR.search(t) or "\x01" in t for t, o in zip(texts, odd))


def test_pieces_rebuild_the_text():
    for text in TEXTS + random_texts(2000):
        assert "".join(split_safely(text or "")) .replace("\x01", "") == (text or "").replace("\x01", "")


@pytest.fixture(scope="module")
def rows(spark):
    texts = TEXTS + TEXTS[5:7]
    made = [(i if i != 3 else None, t, "x", "y", "z", "q") for i, t in enumerate(texts)]
    return spark.createDataFrame(made + made[5:6], SCHEMA).repartition(3), made + made[5:6]


def test_token_counts(rows):
    frame, made = rows
    library = Tokenizer.from_file(FILES[0])
    expected = [
        (i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 512)
        for i, t, *_ in made
    ]
    got = token_counts(frame, FILES[0], 512)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_binary_pieces():
    assert binary_pieces(1024 * 2 + 5, 1024) == [1024, 1024, 4, 1]
    assert binary_pieces(1, 1024) == [1]
    assert binary_pieces(1023, 1024) == [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]


def test_packing_covers_every_id_once(rows):
    frame, made = rows
    library = Tokenizer.from_file(FILES[0])
    got = pack_power_of_two(frame, FILES[0], 1024, 0).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    by_length = sorted((r.sequence_id, r.length) for r in got)
    assert [n for _, n in by_length] == sorted(n for _, n in by_length)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 for r in got)
    for i, text, *_ in made:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r.start, bytes(r.ids), r.doc_tokens) for r in got if r.doc_id == i)
        copies = sum(m[0] == i for m in made)
        assert sum(len(b) for _, b, _ in own) == 4 * len(ids) * copies
        for start, blob, total in own:
            assert total == len(ids)
            assert np.frombuffer(blob, "<u4").tolist() == ids[start : start + len(blob) // 4]


def test_token_files_round_trip(spark, rows):
    frame, made = rows
    path = shared_path(spark, "test-token-files")
    write_token_files(frame, path, FILES[1], 2)
    got = read_token_files(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(FILES[1])
    ordered = sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    before = 0
    assert len(got) == len(ordered)
    for row, (i, text, *_) in zip(got, ordered):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (i, before, len(ids), ids)
        before += len(ids)
    sums = {r.start: r.ids_crc32 for r in with_ids_crc32(read_token_files(spark, path)).collect()}
    assert sums == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    # metadata alone reads no ids
    plan = read_token_files(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts(empty, FILES[0], 512).count() == 0
    assert pack_power_of_two(empty, FILES[0]).count() == 0
    path = shared_path(spark, "test-empty")
    write_token_files(empty, path, FILES[1], 2)
    assert read_token_files(spark, path).count() == 0


def test_kept_pieces_are_bounded_in_bytes():
    """Text without spaces is one long piece each: it is not kept, and ids are within the bound."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(9)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300)) for _ in range(60)]
    texts += [f"word{rng.randrange(10**9)} and word{rng.randrange(10**9)}" for _ in range(3000)]
    encoder = tokens.BatchEncoder(path, max_bytes=1 << 16)
    library = Tokenizer.from_file(path)
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        counts = encoder.counts(some)
        assert counts.tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
        assert max(map(len, encoder.numbers), default=0) <= tokens.LONG_PIECE
        assert encoder.held < (1 << 16) + 400_000
    ids, counts = encoder.encode(texts[:40] * 2)
    assert ids.tolist() == [i for e in library.encode_batch(texts[:40] * 2, add_special_tokens=False) for i in e.ids]


def test_batches_go_by_bytes():
    texts = ["a" * 50, "語" * 50, None, "", "é" * 200, "b" * 50, "c" * 40]
    assert [len(s) for s in tokens.by_size(texts, 200)] == [4, 1, 2]


def test_texts_of_pieces_met_once_are_not_kept():
    """Names that never come back take no room in the encoder beyond their ids; pieces that do stay known."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    texts = [f"name{rng.randrange(10**9)} and many  name{rng.randrange(10**9)}" for _ in range(6000)]
    encoder, library = tokens.BatchEncoder(path), Tokenizer.from_file(path)
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500] + ["and many"]
        ids, _ = encoder.encode(some)
        assert ids.tolist() == [i for e in library.encode_batch(some, add_special_tokens=False) for i in e.ids]
    assert encoder.numbers.given > 12000 and len(encoder.numbers) < 200


@pytest.mark.parametrize("path", FILES)
def test_a_piece_is_encoded_once(path):
    """Pieces of any length that come back in a later batch, in texts of either kind, are known by then."""
    rng = random.Random(4)
    texts = [f"name{rng.randrange(10**9)} and many{'  ' * (i % 2)} name{rng.randrange(10**9)}" for i in range(3000)]
    texts += ["long" + str(rng.randrange(10**9)) * 40 + " end" for _ in range(20)]
    encoder, library = tokens.BatchEncoder(path), Tokenizer.from_file(path)
    expected = [i for e in library.encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert encoder.encode(texts)[0].tolist() == expected
    known = encoder.known
    assert known > 6000
    assert encoder.encode(texts)[0].tolist() == expected
    assert encoder.encode(texts[::-1])[1].tolist() == encoder.counts(texts)[::-1].tolist()
    assert encoder.known == known


def test_pieces_that_begin_at_one_slot_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens.BatchEncoder, "_slot", lambda self, one: np.full(len(one), len(self.slots) - 2))
    encoder, library = tokens.BatchEncoder(FILES[0]), Tokenizer.from_file(FILES[0])
    for texts in (TEXTS, random_texts(200), TEXTS + random_texts(250)):
        ids, _ = encoder.encode(texts)
        assert ids.tolist() == [i for t in texts for i in library.encode(t or "", add_special_tokens=False).ids]


def test_packing_gets_small_batches(spark, rows):
    """Whole texts reach Python 500 rows at a time under any setting, which is as before afterwards."""
    before = spark.conf.get(BATCH_ROWS)
    try:
        for given, held in (("10000", "500"), ("-1", "500"), ("50", "50")):
            spark.conf.set(BATCH_ROWS, given)
            with small_batches(spark):
                assert spark.conf.get(BATCH_ROWS) == held
            assert pack_power_of_two(rows[0], FILES[0]).count() > 0
            assert spark.conf.get(BATCH_ROWS) == given
    finally:
        spark.conf.set(BATCH_ROWS, before)


def test_slices_cover_every_row():
    texts = pa.array(["a" * 50, "語" * 50, None, "", "é" * 200, "b" * 50, "c" * 40])
    got = list(slices(texts.slice(1), 200))
    assert [t for _, some in got for t in some] == texts.to_pylist()[1:]
    assert [at for at, _ in got] == [0, 3, 4] and all(some for _, some in got)
