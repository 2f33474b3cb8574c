import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm.packing import Encoder, cut, pack, pack_documents, sum_of_squares
from sluice.llm.queries import tokenizer_path

ODD = ["", " ", "\n", "a", "a  b", " a", "a ", "a\n\nb", "a \nb", "a\n b", "it's 12,5 % <|endoftext|>x", "é è ñ x", "\0a b", "Straße 日本語 🙂🙂 the,\n-- \tx", "x" * 3000]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


def test_ids_equal_the_tokenizers_on_whole_texts(encoder):
    assert encoder(ODD) == encoder.whole(ODD)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n\t'.,1!ß日  "), max_size=60))
def test_ids_of_any_text(encoder, text):
    assert encoder([text]) == encoder.whole([text])


def test_only_long_documents_are_cut():
    assert cut(1, 4) == [0] and cut(4, 4) == [0] and cut(5, 4) == [0, 1] and cut(8, 4) == [0, 4] and cut(9, 4) == [0, 1, 5]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=80), st.booleans())
def test_sum_of_squares_fits_and_chooses_the_least_sum(lengths, opening):
    where, offsets, gaps = sum_of_squares(np.array(lengths, dtype=np.int64), 16, opening)
    bins: list[int] = []
    for s, b, o in zip(lengths, where, offsets):
        options = {}
        for g in {x for x in bins if x >= s} | {16}:
            after = sorted(bins) + ([16] if g == 16 else [])
            after.remove(g)
            after.append(g - s)
            options[g] = sum(after.count(h) ** 2 for h in range(1, 17))
        if not opening and len(options) > 1:
            del options[16]
        g = 16 - o
        assert options[g] == min(options.values()) and g == min(x for x in options if options[x] == options[g])
        if g == 16:
            assert b == len(bins)
            bins.append(16 - s)
        else:
            assert bins[b] == g
            bins[b] -= s
    assert bins == gaps.tolist()


@pytest.mark.parametrize("lengths,most", [([600] * 2000, 2000), ([512] * 1000, 500), ([700, 324] * 500, 500), ([341] * 999, 333)])
def test_groups_stay_bounded_where_nothing_fits(spark, lengths, most):
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    out = pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), group=50).toPandas()
    assert len(out) == len(lengths) and out.groupby("sequence_id").length.sum().max() <= 1024
    assert out.groupby(out.sequence_id // 2**32).size().max() < 120  # a group of 50 on average
    assert out.sequence_id.nunique() <= most + 2 * len(lengths) // 50


def test_few_sequences(spark):
    draw = np.random.default_rng(3)
    lengths = np.minimum(1023, draw.lognormal(5.6, 1, 4000).astype(int) + 2)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    out = pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), group=1500).toPandas()
    assert out.sequence_id.nunique() <= -(-lengths.sum() // 1024) + 6


def rebuilt(spark, texts, **more):
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "piece": "clash", "length": 1})
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")
    return pack_documents(frame, tokenizer_path(), **more).toPandas()


@pytest.mark.parametrize("group", [16_000, 5])
def test_pieces_are_whole_and_gapless(spark, encoder, group):
    texts = [None, *ODD, *["the cat sat on a mat " * n for n in (1, 5, 30, 300, 300, 900)]]
    out = rebuilt(spark, texts, group=group)
    for key, text in enumerate(texts):
        ids = encoder([text or ""])[0] + (2).to_bytes(4, "little")
        mine = out[out.doc_id == key].sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine))) and mine.length.sum() == len(ids) // 4
        for row in mine.itertuples():
            assert zlib.crc32(ids[4 * row.start : 4 * (row.start + row.length)]) == row.ids_crc32
    for _, rows in out.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows.length.cumsum() - rows.length == rows.offset).all() and rows.length.sum() <= 1024


def test_empty_table(spark):
    assert len(rebuilt(spark, [])) == 0
