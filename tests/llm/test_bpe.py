import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlake.llm import bpe

PATH = bpe.public_tokenizers.path(bpe.RANKS)
SCHEMA = "doc_id long, text string, ids string, k string, piece int"


def direct(text):
    return bpe.encoding(PATH).encode_ordinary(text or "")


TEXTS = [None, "", " ", "a", "the cat's  \n\n sat", "don't we'll they've", "x" * 300, " " * 90 + "y" + "\n" * 70 + "z", "été 12345 über — ¿qué? " * 9, "?!'s'tre 'll" * 20, "日本語のテキスト" * 12, "a  b\t\tc\r\n\r\nd " * 15, "\x1c\x1d a  b   c " * 9]


@pytest.mark.parametrize(("chunk", "overlap"), [(24, 8), (40, 30), (1000, 10)])
def test_chunks_give_the_ids_of_the_whole_text(spark, chunk, overlap):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None), (None, TEXTS[8], "", "", 0), (20, TEXTS[8], "", "", 0)]
    got = bpe.decode(bpe.encode(spark.createDataFrame(rows, SCHEMA), chunk=chunk, overlap=overlap)).collect()
    want = sorted((str(r[0]), direct(r[1]), (r[1] or "").encode()) for r in rows)
    assert sorted((str(g.doc_id), bpe.unpack(g.ids), bytes(g.decoded)) for g in got) == want
    assert all(g.n_tokens == len(bpe.unpack(g.ids)) for g in got)


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t'strelvmd?!,12aé日 \x1c")), max_size=120), st.integers(1, 24), st.integers(1, 16))
def test_stitched_pieces_split_as_the_text_does(text, chunk, overlap):
    """scan, stitched and the slices of encode_long, without Spark."""
    chunk = max(chunk, overlap)
    import pandas as pd

    cuts = bpe.chunk_bounds(len(text), chunk, overlap)
    rows = []
    for c, (a, b) in enumerate(cuts):
        last, body = c == len(cuts) - 1, text[a:b]
        found = bpe.boundaries(body, a, last)
        sure = [a + p for p in range(max(1, chunk), len(body)) if bpe.is_space(body[p]) and not bpe.is_space(body[p - 1])]
        rows.append({"k": "k", "c": c, "left": [x for x in found if x <= a + overlap], "right": [] if last else [x for x in found if x >= a + chunk], "sure": [] if last else sure})
    pieces = {}
    if rows:
        for r in bpe.stitched(pd.DataFrame(rows)).itertuples():
            a, b = cuts[r.c]
            lo, hi = (r.begin - a if r.begin >= 0 else 0), (r.cut - a if r.cut >= 0 else (b - a if r.c == len(cuts) - 1 else chunk))
            pieces[r.piece] = pieces.get(r.piece, "") + text[a:b][lo:max(lo, hi)]
    assert "".join(pieces.values()) == text
    assert [i for p in sorted(pieces) for i in bpe.unpack(bpe.encode_piece(pieces[p], PATH))] == direct(text)


def test_long_runs(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_RUN", 10)
    for text in TEXTS:
        assert bpe.unpack(bpe.encode_piece(text or "", PATH)) == direct(text)


def test_query(spark):
    got = bpe.op1_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        ids = b"".join(i.to_bytes(4, "little") for i in direct(docs[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
