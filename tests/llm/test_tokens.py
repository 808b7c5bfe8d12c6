"""Token records and packing against the library on whole texts."""

import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import packing, queries, token_records, vocab

TEXTS = ["a  b\t c\n\n d", " x \n", "  y　z ", "it's  don't\n\n\n  q", "<|endoftext|> a", "Σας ΟΔΟΣ. Á e ́x\r\n z\x1c b\x85c", "", None, "   ", "\n", "漢字 かな 1234  56", "same text", "same text", "word " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("aB 1\n\t.'sé́ ") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = [(i * 3 - 20, t, "x", 7, -1) for i, t in enumerate(texts)] + [(None, "no id", "x", 7, -1), (1, "same text", "x", 7, -1), (1, "same text", "x", 7, -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, piece int, length long").repartition(5)


def whole(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_hold_every_document_in_order(spark, docs):
    out = token_records.ids_crc32(token_records.write_and_read(docs, queries.vocabulary_path(queries.WORD_BPE), vocab.WORDS, 1)).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start, wanted = 0, []
    for r in rows:
        ids = [*whole(queries.WORD_BPE, r.text), 1]
        wanted.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out), key=lambda r: r[1]) == wanted


def test_an_id_that_most_rows_share_goes_to_several_files(spark):
    rng = random.Random(5)
    rows = [(7, "".join(rng.choice("abcdef ") for _ in range(40))) for _ in range(400)] + [(i, "x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    read = token_records.write_and_read(df, queries.vocabulary_path(queries.WORD_BPE), vocab.WORDS, 1)
    start = 0
    for r, (i, t) in zip(sorted(read.collect(), key=lambda r: r.start), sorted(rows), strict=True):
        ids = [*whole(queries.WORD_BPE, t), 1]
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u2").tolist()) == (i, start, ids)
        start += len(ids)
    assert len({r.p for r in read.where("doc_id = 7").select(F.spark_partition_id().alias("p")).collect()}) > 1


def test_many_counts_are_joined_by_merging(spark, docs, monkeypatch):
    before = sorted(map(str, packing.pack(docs, queries.vocabulary_path(queries.BYTE_BPE), vocab.SPACED, 0, keep_ids=False).collect()))
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", 0)
    merged = packing.pack(docs, queries.vocabulary_path(queries.BYTE_BPE), vocab.SPACED, 0, keep_ids=False)
    assert sorted(map(str, merged.collect())) == before


def test_records_of_an_empty_table(spark, docs):
    assert token_records.write_and_read(docs.limit(0), queries.vocabulary_path(queries.WORD_BPE), vocab.WORDS, 1).count() == 0


def test_damaged_frames_are_refused():
    import io

    data = bytearray(token_records.frame(b"abcdef"))
    assert token_records.read_frame(io.BytesIO(data)) == b"abcdef"
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(token_records.BadRecord):
            token_records.read_frame(io.BytesIO(broken))
    with pytest.raises(token_records.BadRecord):
        token_records.read_frame(io.BytesIO(data[:-1]))


def test_shuffled_reads_use_the_index(spark, docs, tmp_path):
    path = f"file://{tmp_path}/records"
    manifest = token_records.write(docs, path, queries.vocabulary_path(queries.WORD_BPE), vocab.WORDS, 1)
    for row in manifest.collect():
        index = np.frombuffer(open(f"{tmp_path}/records/{row.file}.index", "rb").read(), token_records.INDEX_ENTRY)
        order = np.random.default_rng(0).permutation(len(index))
        sizes = [len(x) // 2 for x in token_records.fetch(path, row.file, index["offset"][order].tolist())]
        assert sizes == index["n_ids"][order].tolist()


def test_packing_places_every_token_once(spark, docs):
    out = packing.pack(docs, queries.vocabulary_path(queries.BYTE_BPE), vocab.SPACED, 0).collect()
    wanted = []
    for r in docs.collect():
        ids = [*whole(queries.BYTE_BPE, r.text), 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        wanted += [(r.doc_id if r.doc_id is not None else -99, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id if r.doc_id is not None else -99, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(wanted)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == best_fit([r.length for r in out])


def best_fit(lengths, capacity=2048):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_over_counts(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, capacity + 1), rng.randint(1, 9))}
    spans = {}
    for length, a, b, first, offset, each in packing.plan(histogram, capacity):
        for q in range(b - a):
            spans.setdefault(first + q // each, []).append((offset + q % each * length, length))
    assert sum(map(len, spans.values())) == sum(histogram.values())
    for found in spans.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(spans) == list(range(len(spans)))
    assert len(spans) == best_fit([n for n, c in histogram.items() for _ in range(c)], capacity)


def test_packing_of_an_empty_table(spark, docs):
    assert packing.pack(docs.limit(0), queries.vocabulary_path(queries.BYTE_BPE), vocab.SPACED, 0).count() == 0


def test_assembled_sequences_hold_the_pieces(spark, docs):
    packed = packing.pack(docs, queries.vocabulary_path(queries.BYTE_BPE), vocab.SPACED, 0).cache()
    ids = {r.sequence_id: np.frombuffer(r.ids, "<u2") for r in packing.assemble(packed).collect()}
    for r in packed.collect():
        assert crc(ids[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32


SPACED = re.compile(r"[ \n]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,!?;:*$%&#| \n]|\Z)|[ \n]*[^ \n]+|[ \n]+")


@pytest.mark.parametrize("seed", range(4))
def test_pieces_cut_in_arrays_are_those_of_the_pattern(seed):
    rng = random.Random(seed)
    texts = ["", "é", "ab", "a,", ",a", " ", "\n \n", "a×b. ÷, ÿ. Ā. é́. 漢, ab漢."] + ["".join(rng.choice("aBé×÷ñĀ漢😀1 \n\x00.,|'-") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    data = b"".join(t.encode() + vocab.BEHIND for t in texts)
    cuts = vocab.spaced_cuts(data).tolist()
    wanted = [p for t in texts for p in [*SPACED.findall(t), vocab.BEHIND.decode()]]
    assert [data[a:b].decode() for a, b in zip(cuts, cuts[1:])] == wanted


def test_ids_with_any_table_and_group_are_the_librarys(monkeypatch):
    rng = random.Random(9)
    texts = TEXTS + ["x" * 100 + " y", "un mot, deux", "\x1c", " "] + ["".join(rng.choice("aBé漢1  \n.,'-\t" if i % 9 == 0 else "aBé漢1  \n.,'-") for _ in range(rng.randint(0, 60))) for i in range(300)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path(queries.BYTE_BPE))
    library.encode_special_tokens = True
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for pieces, group, size, run in ((500_000, 1000, 8 << 20, 1 << 14), (7, 3, 8 << 20, 5), (40, 50, 100, 64), (1, 1, 1, 1)):
        for name, value in (("MEMO_PIECES", pieces), ("SPACED_GROUP", group), ("SPACED_BYTES", size), ("RUN_CHARS", run)):
            monkeypatch.setattr(vocab, name, value, raising=False)
        encoder = vocab.Encoder(queries.vocabulary_path(queries.BYTE_BPE), vocab.SPACED)
        for _ in range(2):
            assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == wanted
        assert len(encoder.units) == len(encoder.ids) <= pieces
    assert encoder.encode([]) == [] and encoder.encode([None, ""]) == [b"", b""]


def test_remembered_pieces_are_no_objects():
    encoder = vocab.Encoder(queries.vocabulary_path(queries.BYTE_BPE), vocab.SPACED)
    texts = [" ".join(f"w{i}x{k}" for k in range(100)) for i in range(300)]
    encoder.encode(texts[:1])
    before = sys.getallocatedblocks()
    encoder.encode(texts)
    assert sys.getallocatedblocks() - before < 3_000  # 30,000 distinct pieces
