import zlib

import numpy as np
import public_tokenizers

from postlake.llm import sstable
from postlake.llm.common import fresh_path

PATH = sstable.public_tokenizers.path(sstable.VOCABULARY)
SCHEMA = "doc_id long, text string, ids string, start int"


def direct(text):
    return [*sstable.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids, sstable.END]


TEXTS = ["", "The cat's  HAT\n\n123", "é́ Ünï\tx\x0by\x85z\xa0w q\x1cv", "<|endoftext|>a <|endoftext|> b", "don't  we'll", "日本語 テキスト", "İstanbul Σίσυφος", "á ́b", "x" * 4000]


def test_parts_give_the_ids_of_the_whole_text():
    got = sstable.encode_texts(TEXTS, PATH)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [direct(t) for t in TEXTS]


def test_all_code_points_beside_marks():
    """Every code point of the first two planes, and some of the others, before and after a mark gives the ids of the library over the whole text."""
    every = [chr(c) for c in [*range(0x20000), *range(0x20000, 0x110000, 64)] if not 0xD800 <= c < 0xE000]
    for mark in ",.;:!?":
        step = every if mark == "," else every[:0x3000]
        for first in range(0, len(step), 256):
            text = " ".join(f"a{c}{mark}b x{mark}{c}" for c in step[first : first + 256])
            assert np.frombuffer(sstable.encode_texts([text], PATH)[0], "<u4").tolist() == direct(text)


def test_files_hold_all_and_are_searched(spark):
    rows = [(i * 7 - 300, TEXTS[i % len(TEXTS)], "x", 1) for i in range(300)] + [(None, "null key", None, None), (7, None, "", 0)] + [(14, "hot", "", 0)] * 200 + [(15, "one two " * 9000, "", 0)] * 4
    manifest = sstable.write(spark.createDataFrame(rows, SCHEMA).repartition(3), fresh_path(spark, "sst-test"), shards=4)
    got = sstable.read(spark, manifest).collect()
    assert sorted((str(g.key), np.frombuffer(g.ids, "<u4").tolist()) for g in got) == sorted((str(r[0]), direct(r[1])) for r in rows)
    got.sort(key=lambda g: g.start)
    keys = [-(2**70) if g.key is None else g.key for g in got]
    assert keys == sorted(keys)
    at = 0
    for g in got:
        assert (g.start, g.n_tokens) == (at, len(g.ids) // 4)
        at += g.n_tokens
    assert len(manifest) > 1 and max(len(sstable.Shard(m.path).index) for m in manifest) > 1
    for key in [None, 7, 14, -300, 43, 44, 10**12]:
        assert sorted(sstable.lookup(manifest, key)) == sorted(direct(r[1]) for r in rows if r[0] == key)
    misses = sum(sstable.Shard(m.path).may_hold(k) for m in manifest for k in range(10**6, 10**6 + 100))
    assert misses < 0.05 * 100 * len(manifest)


def test_empty(spark):
    manifest = sstable.write(spark.createDataFrame([], SCHEMA), fresh_path(spark, "sst-empty"))
    assert sstable.read(spark, manifest).count() == 0 and sstable.lookup(manifest, 1) == []


def test_query(spark):
    got = sorted(sstable.op4_sstable_ids(spark, "/root/testdata/sf0.001").collect())
    at = 0
    for g, d in zip(got, sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()), strict=True):
        ids = np.array(direct(d.text), "<u4")
        assert tuple(g) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_capitals_and_marks_give_the_ids_of_the_whole_text():
    """Words are lowered and cut before they are kept; a capital must not compose, nor turn into a special token, where the library sees none."""
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    words = ["Straße", "ÀÉ", "a×b", "H̱", "<|ENDOFTEXT|>", "A<|endoftext|>B", "x\x0bY\x0cZ", "W̊ q", "it's", "IT'S", "a_b", "̸", "İX"]
    texts = [f"{a}{m}{b}" for a in words for m in marks for b in ["T", "̸", "é", "'s", m, ""]]
    assert [np.frombuffer(g, "<u4").tolist() for g in sstable.encode_texts(texts, PATH)] == [direct(t) for t in texts]


def test_variants_of_a_word_are_encoded_once():
    sstable.kept_parts(PATH).clear()
    sstable.encode_texts(["Éléphantqz éléphantqz, Wordqz wordqz#", "wordqz&&& WORDQZ"], PATH)
    assert len({k for k in sstable.kept_parts(PATH) if b"wordqz" in k.lower()}) == 3 and b"Wordqz" not in sstable.kept_parts(PATH)


def test_parts_joined_are_encoded_as_alone():
    path = public_tokenizers.path(sstable.VOCABULARY)
    parts = [x.encode() for x in ["the", "don't", "s", "'s", "|>", "<", "<|", "<|endoftext|>", "a<|endoftext|>b", "<|startoftext|", "e\u0301", "\u0301x", "\u00a0", "x\u2003y", "\U0001f600", "|endoftext|>", "Cafe9", "9", "!?", "endoftext"]] * 25
    found = list(sstable.encode_parts(parts, path))
    alone = lambda p: np.array(sstable.tokenizer(path).encode(p.decode(), add_special_tokens=False).ids, "<u4").tobytes()
    assert sorted(p for p, _ in found) == sorted(parts) and all(ids == alone(p) for p, ids in found)
    assert list(sstable.encode_parts([], path)) == []
