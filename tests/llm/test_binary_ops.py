"""Media, tokens, packing and the pipeline: exact round trips and brute force."""

import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import media, packing, token_scan
from lacuna.llm.tokens import _OTHER, default_path, token_ids

from .test_text_ops import SCHEMA, fixture_rows

RNG = np.random.default_rng(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("shape", [(5, 7), (1, 1), (4, 6, 3), (3, 5, 3)])
def test_images_round_trip(shape):
    image = RNG.integers(0, 256, shape, dtype=np.uint8)
    assert np.array_equal(media.decode(media.encode_netpbm(image)), image)
    assert np.array_equal(media.decode(media.encode_bmp(image)), image)


def test_netpbm_text_forms_and_errors():
    assert media.decode(b"P2 # c\n2 2\n255\n0 1\n254 255\n").tolist() == [[0, 1], [254, 255]]
    assert media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 1, 0]]
    assert media.decode(b"P4\n9 1\n\xff\x80").tolist() == [[0] * 9]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    for bad in (b"", b"P9", b"P5\n2 2\n255\nx", b"BM", b"P5 a"):
        with pytest.raises((media.MediaError, ValueError)):
            media.decode(bad)


def test_malformed_images_are_reasons_not_crashes(spark):
    beyond = bytearray(media.encode_bmp(np.full((2, 3), 200, np.uint8)))
    beyond[46:50] = (100).to_bytes(4, "little")  # a palette of 100 colours
    short = media.encode_bmp(np.zeros((4, 4), np.uint8))[:60]
    bad = [b"P2\n1 1\n255\n300\n", b"P2\n1 1\n255\n-1\n", b"P5\n0 4\n255\n", b"P5\n4 0\n255\n", bytes(beyond), short, b"P5\n99999999999 99999999999\n255\n\0", None, b""]
    bad += [bytes(RNG.integers(0, 256, 80, dtype=np.uint8)) for _ in range(20)] + [b"BM" + bytes(RNG.integers(0, 256, 90, dtype=np.uint8)) for _ in range(50)]
    got = media.media_features(spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "id int, media binary")).collect()
    assert len(got) == len(bad) and all(r.error for r in got[:9]) and all((r.error is None) == (r.width is not None) for r in got)


def test_resizing_a_large_image_keeps_few_rows():
    image = RNG.integers(0, 256, (40_000, 64, 3), dtype=np.uint8)
    grey = media.luma(image)
    assert np.allclose(media.area_resize(image, 8, 8), grey.reshape(8, 5000, 8, 8).mean(axis=(1, 3)))


def test_area_resize_equals_supersampling():
    grey = RNG.uniform(0, 255, (6, 10))
    up = np.kron(grey, np.ones((8, 9)))  # 48 x 90 divides by 8 x 9
    want = up.reshape(8, 6, 9, 10).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(grey, 8, 9), want)
    tile = np.load(io.BytesIO(media.npy_tile(grey)))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8


def test_media_columns(spark, docs):
    got = media.media_features(media.store_media(docs)).collect()
    assert len(got) == docs.count()
    text = {r[0]: r[1] for r in fixture_rows()}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    odd = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert all(r.payload_bytes is None and r.error for r in media.media_features(odd).collect())


def test_fast_tokens_equal_the_library():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(default_path())
    plain = Tokenizer.from_file(default_path())
    plain.encode_special_tokens = True
    texts = ["", "a", "<|endoftext|>", "x<|endoftext|>y", "don't  stop\n\n\tnow 123's é ñ ß", "日本語 text", "\x85\xa0 a b", "a" * 3000, "1 " * 500]
    rnd = random.Random(0)
    safe = [chr(c) for c in [*range(0, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)] if not 0xD800 <= c < 0xE000]
    texts += ["".join(rnd.choice(safe + list("  ab'stre1 ")) for _ in range(60)) for _ in range(400)]
    texts += [f"{a}{b}x {a}1{b}" for a in safe for b in " a'"]
    for t in texts:
        assert token_ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids
        assert token_ids(t, plain=True).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert _OTHER.search("日") and not _OTHER.search("".join(safe))


def check_packing(rows, texts, length=1024):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for v in seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= length
    for d, text in texts.items():
        ids = np.append(token_ids(text or ""), np.uint32(2)).astype("<u4")
        copies = sum(r.piece == 0 for r in by[d])
        for r in by[d]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) and (r.piece == 0 or r.length == length)
        assert sum(r.length for r in by[d]) == copies * len(ids) and (len(ids) > length or all(r.piece == 0 for r in by[d]))
    return seq


def test_packing_is_whole_and_tight(spark, docs):
    rows = packing.pack(docs).collect()
    texts = {r[0]: r[1] for r in fixture_rows()}
    seq = check_packing(rows, texts)
    assert len(seq) <= -(-sum(r.length for r in rows) // 1024) + 1
    many = packing.pack(docs, length=64, shard=5).collect()  # several shards and a second level
    check_packing(many, texts, 64)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_genetic_operators_keep_every_item_once():
    rng = random.Random(1)
    sizes = [rng.randint(1, 700) for _ in range(300)]
    pop = packing.seeds(sizes, 1024, 4, rng)
    start = max(packing.fitness(p, sizes, 1024) for p in pop)
    for p in [*pop, packing.crossover(pop[0], pop[1], sizes, 1024, rng), packing.mutate(pop[2], sizes, 1024, rng)]:
        assert sorted(i for b in p for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 1024 for b in p)
    assert packing.fitness(packing.evolve(sizes, 1024, pop, 10, rng)[0], sizes, 1024) >= start
    codes = packing._encode(pop[0], 300)
    assert packing._decode(codes) == [sorted(b) for b in pop[0]]


def test_token_scan_stitches_blocks(spark, docs, tmp_path):
    texts = [(str(r[0]), len(token_ids(r[1] or "", plain=True))) for r in fixture_rows()]
    for block in (64, token_scan.BLOCK):
        got = token_scan.token_counts(docs, block=block).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted(texts)
    ids = np.array([5, 6, 50256, 50256, 7, 8, 9], dtype="<u2")
    (tmp_path / "tokens-1.bin").write_bytes(ids.tobytes())
    blocks = token_scan.scan_blocks(token_scan.token_files(spark, f"file://{tmp_path}"), block=4)
    assert sorted((r.ordinal, r.n_tokens) for r in token_scan.document_lengths(blocks).collect()) == [(0, 2), (1, 0), (2, 3)]
    assert token_scan.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_wider_than_the_files_are_refused(spark, docs, tmp_path):
    with pytest.raises(Exception, match="doesn't fit <u1"):
        token_scan.write_token_files(docs, f"file://{tmp_path}", separator=255, dtype="<u1").count()
    wide = token_scan.write_token_files(docs, f"file://{tmp_path}/wide", dtype="<u4")
    assert wide.count() == docs.count()


def test_pipeline_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    before = docs
    for name in list(stages)[:-1]:
        after = stages[name](spark, before, "").cache()
        assert after.columns == docs.columns
        before = after
    ids = {r.doc_id for r in stages["quality_rules"](spark, docs, "").collect()}
    assert set(range(12)) <= ids and not ids & {30, 31, 32, 33}
    rows = stages["packing"](spark, before, "").collect()
    check_packing(rows, {r.doc_id: r.text for r in before.collect()})
    empty = spark.createDataFrame([], SCHEMA)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, "").count() == 0
