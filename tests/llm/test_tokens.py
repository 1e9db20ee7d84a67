"""Token files and packing: ids equal the library's, files round-trip, sequences hold every piece once."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from boxtide.llm.common import new_folder
from boxtide.llm.encoder import encoded
from boxtide.llm.packing import configurations, op6_packing, pack, slots, solve
from boxtide.llm.token_files import op2_token_files, read_token_files, sequence, write_token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a  ", "a \n b", "I'll they've 'S", "<|endoftext|> x", "<|startoftext|>", "ÀÉ ß µ ²½ 123 4", "\x1c\x85\xa0x", "日本語 text", "İstanbul ΣΑΣ", "e\u0301", "\U0001f600 ok", "tab\t\tx\r\n", "x" * 3000, "##" * 50]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def texts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()


def test_batches_equal_single_texts(spark, sf):
    every = [None, *ODD, *[r.text for r in texts(spark, sf)]]
    for path in (BYTE, WORD):
        whole = Tokenizer.from_file(path)
        got = list(encoded(pa.array(every), path, 5000))
        assert len(got) == len(every)
        for own, text in zip(got, every, strict=True):
            assert own.tolist() == whole.encode(text or "", add_special_tokens=False).ids, text[:40]


def test_op2_round_trip(spark, sf):
    got = {r.doc_id: r for r in op2_token_files(spark, sf).collect()}
    whole, start = Tokenizer.from_file(BYTE), 0
    for d in texts(spark, sf):
        ids = whole.encode(d.text, add_special_tokens=False).ids + [2]
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_odd_rows(spark):
    rows = [(3, "b"), (None, "z"), (1, None), (2, ""), (3, "a"), (3, "a"), (4, "w " * 30000)]
    docs = spark.createDataFrame([(*r, 7, "x", 8) for r in rows], "doc_id long, text string, key int, tokens string, part int")
    manifest = write_token_files(docs, new_folder(spark, "t"), BYTE, 2, length=16)
    out = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 3, 3, 4]
    assert [r.n_tokens for r in out[1:3]] == [1, 1] and out[1].ids_crc32 == crc([2])
    files = sorted(manifest.collect(), key=lambda r: r.part)
    ids, mask = sequence(files[0].tokens, 0)
    assert len(ids) == 16 and ids.dtype == np.uint16 and mask.sum() == min(16, files[0].n_tokens)
    assert sum(r.n_tokens for r in files) == out[-1].start + out[-1].n_tokens
    empty = write_token_files(spark.createDataFrame([], "doc_id long, text string"), new_folder(spark, "t"), BYTE, 2)
    assert read_token_files(empty).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_op6_pieces(spark, sf):
    rows = op6_packing(spark, sf).collect()
    got, total = {(r.doc_id, r.piece): r for r in rows}, 0
    whole = Tokenizer.from_file(WORD)
    for d in texts(spark, sf):
        ids = whole.encode(d.text, add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            r = got.pop((d.doc_id, k))
            assert (r.start, r.length, r.ids_crc32) == (at, len(ids[at : at + 2048]), crc(ids[at : at + 2048]))
    assert not got
    assert check_packing(rows, 2048) <= 1.01 * max(total / 2048, sum(r.length > 1024 for r in rows)) + 2


def test_packing_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (1, None), (2, ""), (3, "one two three " * 40), (4, "x y"), (4, "x y")]
    clash = spark.createDataFrame([(*r, 7, "x", 8) for r in rows], "doc_id long, text string, key int, piece string, _part int")
    out = pack(clash, WORD, capacity=32).collect()
    check_packing(out, 32)
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in out if r.doc_id != 3) == [(0, 0, 3), (1, 0, 1), (1, 0, 1), (2, 0, 1), (4, 0, 3), (4, 0, 3)]
    assert sum(r.length for r in out if r.doc_id == 3) == 121
    assert pack(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


def test_configurations_cover_exactly():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 3000):
        counts = np.bincount(rng.integers(1, 2049, n), minlength=2049)
        held = np.zeros(2049, int)
        configs = configurations(counts, 2048)
        for lengths, times in configs:
            assert sum(lengths) <= 2048 and times > 0
            np.add.at(held, lengths, times)
        assert (held == counts).all()
        keys, _, _ = slots(configs)
        assert len(set(keys.tolist())) == len(keys)


def test_the_program_is_covered_and_bounded():
    rng = np.random.default_rng(1)
    for counts in (np.bincount(rng.integers(1, 2049, 20_000), minlength=2049), np.bincount(rng.integers(600, 1100, 5000), minlength=2049), np.bincount([1500] * 7 + [548] * 3, minlength=2049)):
        program, held = solve(counts, 2048), np.zeros(2049)
        for config, x in program.uses.items():
            assert x > 0 and sum(size * n for size, n in config) <= 2048
            for size, n in config:
                held[size] += n * x
        assert (held >= counts - 1e-6).all()
        used = sum(times for _, times in configurations(counts, 2048))
        assert program.bound <= program.value + 1e-6 and np.ceil(program.bound - 1e-6) <= used <= 1.01 * program.value + 1
    assert solve(np.bincount([1500] * 7 + [548] * 3, minlength=2049), 2048).value == 7
